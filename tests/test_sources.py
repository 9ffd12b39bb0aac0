"""Files, resumed work, streams, learning helpers and the registry."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import tidy
from palimpsest.operators import learn
from palimpsest.operators.annotate import clean_category, clean_tags, rule_category
from palimpsest.plans import learning, ranking, relational, snapshot_queries
from palimpsest.sources import trec
from palimpsest.sources.tables import json_strings
from palimpsest.streaming.resume import append_snapshots, done_before, remaining, resume, snapshot_stream

DATA = "/root/testdata/sf0.001"


def test_run_files(spark, tmp_path):
    run = spark.createDataFrame([("q1", 5, 1, 2.5, "s"), ("q1", 7, 2, -1.0, "s")], "qid string, docid bigint, rank int, score double, name string")
    for sep in (" ", "\t"):
        path = str(tmp_path / f"run{ord(sep)}")
        trec.write_run(run, path, sep=sep, prefix="doc", one_file=True)
        assert len([f for f in os.listdir(path) if f.endswith(".gz")]) == 1
        got = sorted(map(tuple, trec.read_run(spark, path).collect()))
        assert got == [("q1", "Q0", "doc5", 1, 2.5, "s"), ("q1", "Q0", "doc7", 2, -1.0, "s")]


def test_malformed_files(spark, tmp_path):
    (tmp_path / "qrels").write_text("q 0 d 2\nq 0 d x\n\nq 0 e 1\n q  0\tf 2\n")
    assert [(r.docid, r.relevance) for r in trec.read_qrels(spark, str(tmp_path / "qrels"), keep=2).orderBy("docid").collect()] == [("d", 2), ("f", 2)]
    (tmp_path / "queries").write_text("1\teau \n2\ta\tb\nno tab\n")
    assert {r.qid: r.query for r in trec.read_queries(spark, str(tmp_path / "queries")).collect()} == {"1": "eau", "2": "a\tb"}


def test_json_dates(spark):
    df = spark.createDataFrame([('["a", "b", "b"]',), ("[]",), (None,), ('["a", "',), ("['a']",)], "c string")
    assert [r.x for r in df.select(json_strings("c").alias("x")).collect()][:4] == [["a", "b", "b"], [], [], []]


def test_materialize(spark):
    from palimpsest.operators.lineage import drop_materialized, materialize

    drop_materialized(spark)
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    kept = materialize(df, "t")
    assert sorted(map(tuple, kept.collect())) == [(1, None), (2, "x")] and kept.schema == df.schema
    assert materialize(df.limit(0), "empty").count() == 0
    assert drop_materialized(spark) == 2 and drop_materialized(spark) == 0


def test_resume(spark, tmp_path):
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    out = str(tmp_path / "out")
    assert done_before(spark, out, "query", "answer") is None
    resume(todo.filter("query = 'a'"), out, "query", "answer", lambda d: d.withColumn("answer", F.lit("x")))
    resume(todo.filter("query <> 'c'"), out, "query", "answer", lambda d: d.withColumn("answer", F.lit(None).cast("string")))
    assert {r.query for r in remaining(todo, done_before(spark, out, "query", "answer"), "query").collect()} == {"b", "c"}


def test_snapshot_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    write = lambda s, rows: spark.createDataFrame(rows, "docid int").withColumn("sub_collection", F.lit(s)).write.mode("append").partitionBy("sub_collection").parquet(src)
    for s, rows in (("2023-01", [(1,), (2,)]), ("2023-02", [(3,)])):
        write(s, rows)
        append_snapshots(snapshot_stream(spark, src, "docid int, sub_collection string"), lambda d: d.withColumn("twice", F.col("docid") * 2), out, check).awaitTermination()
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [2, 4, 6]


def test_annotation(spark):
    q = spark.createDataFrame([("roman 2023",), ("concert à Lyon",), ("prix du pain",), ("pain",), (None,)], "query string")
    assert [r.x for r in q.select(rule_category(F.col("query")).alias("x")).collect()] == ["explicit-time", "event", "timeliness", "time-independent", None]
    a = spark.createDataFrame([(" Event.",), ("not sure",), (None,)], "a string")
    assert [r.x for r in a.select(clean_category(F.col("a")).alias("x")).collect()] == ["event", None, None]
    t = clean_tags(spark.createDataFrame([("0.7",), ("1.5",), (None,)], "tag string")).collect()
    assert [(r.tag, r.changed) for r in t] == [(0.7, False), (0.0, True), (0.0, True)]


def test_split_and_sample(spark):
    df = spark.range(200).withColumn("s", F.col("id") % 2)
    parts = {(r.s, r.part): r["count"] for r in learn.stratified_split(df, "id", ["s"]).groupBy("s", "part").count().collect()}
    assert parts == {(s, p): n for s in (0, 1) for p, n in (("train", 70), ("validation", 15), ("test", 15))}
    one = learn.seeded_sample(df, "id", 10)
    assert {r.id for r in one.collect()} == {r.id for r in learn.seeded_sample(df.repartition(7), "id", 10).collect()}


def test_vocabulary_and_gate(spark):
    t = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "c"), (2, None)], "docid int, term string")
    v = learn.vocabulary(t, 2)
    assert [(r.term, r["count"], r["index"]) for r in v.orderBy("index").collect()] == [("a", 2, 0), ("b", 1, 1)]
    assert {r.docid: r.term_idx for r in learn.multi_hot(t, v, ["docid"]).collect()} == {1: [0, 1], 2: [0]}
    run = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 2.0), ("q", 3, 2.0)], "qid string, docid int, score double")
    p = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.9)], "docid int, cluster int, p_rel double")
    c = spark.createDataFrame([("q", 0)], "qid string, cluster int")
    assert {r.docid: round(r.score, 6) for r in learn.gate(run, p, c).collect()} == {1: 3.6, 2: 2.0, 3: 2.0}


def test_models_round_trip(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    rows = [(i, ["a", "b"] if i % 2 else ["c"], i % 2) for i in range(40)] + [(99, [], 0)]
    df = learn.hashed_vectors(spark.createDataFrame(rows, "id int, tokens array<string>, label int"), size=16)
    lengths = {round(sum(v * v for v in r.embedding), 6) for r in df.collect()}
    assert lengths == {0.0, 1.0}
    m = learn.fit_relevance(learn.vectors(df, "embedding"), weight=None)
    learn.save_model(m, str(tmp_path / "m"))
    again = LogisticRegressionModel.load(str(tmp_path / "m")).transform(learn.vectors(df, "embedding"))
    assert learn.classification_metrics(again).first().accuracy == 1.0
    assert again.select(learn.positive_probability().alias("p")).filter("p > 0.5").count() == 20


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


CORE = {**snapshot_queries.ORACLE, **relational.ORACLE, **ranking.ORACLE, **learning.ORACLE}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, con, name):
    assert tidy(entry.queries()[name](spark, DATA).toPandas()) == tidy(con.execute(CORE[name]).df())


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["name", "qid", "docid", "score", "rank"]
