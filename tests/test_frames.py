"""Descriptions, lookups, splits, adapters and files, on small frames with nulls, ties and empty tables."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import adapters, frames, learn
from palimpsest.operators.lineage import shared_folder
from palimpsest.sources import trec
from palimpsest.sources.tables import jdbc_table, python_numbers, python_strings, reachable, register


def test_descriptions(spark):
    df = spark.createDataFrame([(1, None, 300), (2, "x", None)], "a bigint, `b c` string, n int")
    assert {r.column: (r.type, r.rows, r.filled) for r in frames.describe_columns(df).collect()} == {"a": ("bigint", 2, 2), "b c": ("string", 2, 1), "n": ("int", 2, 1)}
    assert dict(frames.shrink(df).dtypes) == {"a": "tinyint", "b c": "string", "n": "smallint"}
    assert [tuple(r) for r in frames.shrink(df).orderBy("a").collect()] == [(1, None, 300), (2, "x", None)]
    assert dict(frames.shrink(df.limit(0)).dtypes)["a"] == "tinyint"
    assert frames.columns_like(df, "b.*") == ["b c"]


def test_lookup_and_shares(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    table = spark.createDataFrame([("a", 7)], "k string, v int")
    assert {(r.k, r.v) for r in frames.lookup(df, table, "k", "v").collect()} == {("a", 7), ("z", -1), (None, -1)}
    frames.check_shares(0.7, 0.15, 0.15)
    for bad in ((0.5, 0.6), (1.2, -0.2)):
        with pytest.raises(ValueError):
            frames.check_shares(*bad)
    assert frames.cosine_rate(0, 10) == 1e-3 and abs(frames.cosine_rate(5, 10) - 5e-4) < 1e-12 and frames.cosine_rate(99, 10) < 1e-12


def test_splits(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("label"))
    parts = {r.part: r.n for r in frames.random_split(df, "key").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(parts.values()) == 5000 and abs(parts["train"] - 3500) < 150
    one, two = ({(r.key, r.part) for r in learn.stratified_split(d, "key", ["label"]).collect()} for d in (df, df.repartition(7)))
    assert one == two
    exact = {(r.label, r.part): r.n for r in learn.stratified_split(df, "key", ["label"]).groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    for label, n in (("x", 1667), ("y", 1667), (None, 1666)):
        assert exact[label, "train"] == int(n * 0.7) and exact[label, "validation"] == int(n * 0.85) - int(n * 0.7)


def test_encoder_retries_and_zeros(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as f:
            f.write("x")
        if os.path.getsize(log) == 1:
            raise OSError("busy")
        if "bad" in texts:
            return [[1.0]]
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), (None,), (" ",), ("x" * 50,)], "t string").coalesce(1)
    out = [r.embedding for r in adapters.encode(df, "t", model, 2, retries=3, pause=0.0, longest=40).collect()]
    assert out == [[2.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    bad = spark.createDataFrame([("bad",), ("z",)], "t string").coalesce(1)
    assert [r.embedding for r in adapters.encode(bad, "t", model, 2, retries=2, pause=0.0).collect()] == [[0.0, 0.0], [0.0, 0.0]]


def test_annotator(spark):
    def model(prompts):
        if any("fail" in p for p in prompts):
            raise ValueError
        return ["0.8" if "prix" in p else "often" for p in prompts]

    df = spark.createDataFrame([("prix", 1), ("mont", 2), ("prix", 3), (None, 4), ("fail", 5)], "query string, answer int")
    got = {r["query"]: r.score for r in adapters.time_scores(df, "query", model, "How timely is {query}?", batch=1, retries=2, pause=0.0).collect()}
    assert got == {"prix": 0.8, "mont": 0.0, "fail": None}
    assert adapters.annotate(df.limit(0), "query", model, "a").count() == 0


def test_printed_lists(spark):
    df = spark.createDataFrame([("['a', \"b's\", 'c\\'d']",), ("[]",), ("no list",), (None,), ("[1.0, 2e-3]",)], "t string")
    rows = df.select(python_strings("t").alias("s"), python_numbers("t").alias("n")).collect()
    assert [r.s for r in rows][:4] == [["a", "b's", "c'd"], [], [], None] and rows[4].n == [1.0, 0.002]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "un, deux", None), ("2", 'dit "oui"', "x")], "qid string, query string, note string")
    trec.write_csv(df, f"{tmp_path}/csv")
    assert {tuple(r) for r in trec.read_csv(spark, f"{tmp_path}/csv", "qid string, query string, note string").collect()} == {("1", "un, deux", None), ("2", 'dit "oui"', "x")}
    trec.append(df.coalesce(1), f"{tmp_path}/grown")
    trec.append(df.coalesce(1), f"{tmp_path}/grown")
    assert spark.read.parquet(f"{tmp_path}/grown").count() == 4
    os.makedirs(f"{tmp_path}/wide")
    with open(f"{tmp_path}/wide/w.csv", "w") as f:
        f.write("query,z_1_term,z_1_tf_idf,z_2_term,z_2_tf_idf,z_3_term\na,vent,0.5,,,pluie\n")
    assert [tuple(r) for r in trec.read_wide_expansions(spark, f"{tmp_path}/wide/w.csv").collect()] == [("a", "1", "vent", 0.5)]
    with open(f"{tmp_path}/2023-01.csv", "w") as f:
        f.write("qid,query,term,score\n1,a,vent,0.5\n")
    assert [tuple(r) for r in trec.read_expansions(spark, f"{tmp_path}/2023-01.csv").select("qid", "term", "score", "period").collect()] == [("1", "vent", 0.5, "2023-01")]


def test_databases_and_views(spark, tmp_path):
    assert not reachable(spark, "jdbc:none://nowhere/x", "t")
    with pytest.raises(Exception, match="(?i)driver|jdbc"):
        jdbc_table(spark, "jdbc:none://nowhere/x", "t", "id", 0, 10, 2)
    spark.createDataFrame([("a", "b", "c")], "qid string, query string, answer string").write.parquet(f"{tmp_path}/query_category.parquet")
    register(spark, str(tmp_path), ["query_category"])
    assert spark.sql("select answer from query_category").first().answer == "c"


def test_a_cluster_must_name_its_folder(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    assert shared_folder(spark).startswith(("file:", "/"))


def test_heads(spark):
    df = spark.createDataFrame([(float(k % 2), float(k % 3 == 0), [float(k % 2), float(k % 3 == 0), 1.0]) for k in range(60)], "c double, r double, a array<double>")
    x = learn.vectors(df, "a")
    out = learn.predict_heads(x, *learn.fit_heads(x, "c", "r")).collect()
    assert all(r.cluster == int(r.c) and (r.p_rel > 0.5) == (r.r == 1.0) for r in out)
    m = learn.binary_metrics(learn.fit_relevance(x, label="r", weight=None).transform(x), label="r").first()
    assert (m.precision, m.recall, m.auc) == (1.0, 1.0, 1.0)
