"""Ranks, boosts, metrics, agreement and retrieval on frames worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.config import SIMILARITY_FACTORS
from palimpsest.operators.evaluate import agreement, class_report, experiment, query_metrics
from palimpsest.operators.index import build_index
from palimpsest.operators.rank import boost_pairs, grid, ranked, recency_score, similarity_factor, top_k, with_configs
from palimpsest.operators.retrieve import bm25, expand, inverse_frequencies
from palimpsest.operators.similarity import cosine, jaccard, similarity_bucket


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame([("q1", "a", 2.0), ("q1", "b", 2.0), ("q1", "c", 3.0), ("q2", "a", None)], "qid string, docid string, score double")


def test_ranks_and_ties(run):
    order = lambda df: [(r.docid, r["rank"]) for r in df.filter("qid = 'q1'").orderBy("rank").collect()]
    assert order(ranked(run, ["qid"])) == [("c", 1), ("a", 2), ("b", 3)]
    assert order(ranked(run, ["qid"], base=0)) == [("c", 0), ("a", 1), ("b", 2)]
    assert order(top_k(run, ["qid"], 2)) == [("c", 1), ("a", 2)]
    assert "WindowGroupLimit" in top_k(run, ["qid"], 2)._jdf.queryExecution().toString()


def test_boost(spark, run):
    pairs = spark.createDataFrame([("q1", "b"), ("q1", "b"), ("q9", "a")], "qid string, docid string")
    out = {(r.qid, r.docid): r.score for r in boost_pairs(run, pairs, ["qid", "docid"], 2.0).collect()}
    assert out == {("q1", "a"): 2.0, ("q1", "b"): 4.0, ("q1", "c"): 3.0, ("q2", "a"): None}
    same = boost_pairs(run, pairs, ["qid", "docid"], 1.0)
    assert sorted(map(tuple, same.select("qid", "docid", "score").dropna().collect())) == sorted(map(tuple, run.dropna().collect()))


def test_buckets(spark):
    sims = [1.0, 1.00000003, 0.95, 0.8999, 0.8, 0.79]
    df = spark.createDataFrame([(s,) for s in sims], "s double").select("s", similarity_factor(F.col("s"), SIMILARITY_FACTORS).alias("f"), similarity_bucket(F.col("s")).alias("b"))
    assert [r.f for r in df.collect()] == [2.0, 2.0, 1.75, 1.25, 1.25, 1.0]
    assert [r.b for r in df.collect()] == ["100%", "100%", "95-99%", "85-89%", "80-84%", None]


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], ["a", "a"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [pytest.approx(1 / 3), 0.0, 1.0]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.x for r in v.select(cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [pytest.approx(math.sqrt(0.5)), None]


def test_recency(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (1.0, None, 5), (1.0, 1.0, None), (1.0, 1.0, 99)], "s double, t double, n int")
    got = [r.x for r in df.select(recency_score(F.col("s"), F.col("t"), F.col("n"), 1.0, 15).alias("x")).collect()]
    assert got == [pytest.approx(1 + 1 / (1 + math.log(2))), 1.0, pytest.approx(1 + 1 / (1 + math.log(2))), pytest.approx(1 + 1 / (1 + math.log(16)))]


def test_grid(spark, run):
    g = grid(spark, a=[1.0, 2.0], b=[0.5, 1.5, 2.5])
    assert g.count() == 6 and g.select("config").distinct().count() == 6
    assert with_configs(run, g).count() == 6 * run.count()


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("s", "q", d, s) for d, s in (("d1", 4.0), ("d2", 3.0), ("d3", 3.0), ("d4", 1.0))] + [("s", "none", "d1", 1.0)], "name string, qid string, docid string, score double")
    qrels = spark.createDataFrame([("q", "d1", 0), ("q", "d3", 2), ("q", "d4", 1), ("q", "d9", 1), ("none", "d1", 0)], "qid string, docid string, label int")
    # order: d1 (0), d3 (2; the greater docid first on a tie), d2 (unjudged), d4 (1); R = 3, one judged nonrelevant
    m = query_metrics(run, qrels, ["name"], k=2, recall_k=4).collect()
    assert len(m) == 1
    m = m[0]
    dcg, ideal = 2 / math.log2(3) + 1 / math.log2(5), 2 + 1 / math.log2(3) + 1 / math.log2(4)
    assert (m.p_k, m.recall_k) == (0.5, pytest.approx(2 / 3, abs=1e-6))
    assert m.ap == pytest.approx((1 / 2 + 2 / 4) / 3, abs=1e-6)
    assert m.ndcg == pytest.approx(dcg / ideal, abs=1e-6)
    assert m.ndcg_k == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3)), abs=1e-6)
    assert m.bpref == pytest.approx(0.0, abs=1e-6)
    assert experiment(run, qrels, ["name"]).first().queries == 1


def test_ideal_run_has_ndcg_one(spark):
    qrels = spark.createDataFrame([("q", f"d{i}", i % 3) for i in range(9)], "qid string, docid string, label int")
    run = qrels.select(F.lit("s").alias("name"), "qid", "docid", F.col("label").cast("double").alias("score"))
    m = query_metrics(run, qrels, ["name"]).first()
    assert m.ndcg == 1.0 and m.ap == 1.0 and m.bpref == 1.0


def test_agreement_by_hand(spark):
    pairs = spark.createDataFrame([("x", "x"), ("x", "x"), ("y", "y"), ("x", "y"), (None, "x")], "a1 string, a2 string")
    r = agreement(pairs).first()
    po, pe = 3 / 4, (3 * 2 + 1 * 2) / 16
    assert r.n == 4 and r.agreement == po and r.kappa == pytest.approx((po - pe) / (1 - pe), abs=1e-6)
    assert r.alpha == pytest.approx(1 - 7 * 2 / (64 - 25 - 9), abs=1e-6)
    rep = {x.label: x for x in class_report(pairs).collect()}
    assert rep["x"].precision == 1.0 and rep["x"].recall == pytest.approx(2 / 3, abs=1e-6) and rep["y"].precision == 0.5 and rep["y"].support == 1
    never = class_report(spark.createDataFrame([("x", "z")], "a1 string, a2 string"))
    assert all(r.f1 == 0.0 for r in never.collect())


def test_bm25_and_idf(spark):
    docs = spark.createDataFrame([("s", 1, "chat chien"), ("s", 2, "chat"), ("s", 3, "lapin"), ("s", 4, None), ("s", 5, "")], "sub_collection string, docid bigint, text string")
    index = build_index(docs, ["sub_collection"])
    assert index.stats.first().n == 5 and index.docs.filter("dl = 0").count() == 2
    topics = spark.createDataFrame([("s", "q", "Chat chien !"), ("s", "e", ""), ("t", "x", "chat")], "sub_collection string, qid string, query string")
    out = bm25(topics, index).orderBy("rank").collect()
    assert [(r.qid, r.docid, r["rank"]) for r in out] == [("q", 1, 1), ("q", 2, 2)]
    idf = {r.term: r.idf for r in inverse_frequencies(index).collect()}
    assert idf["chat"] == pytest.approx(math.log10(5 / 3)) and idf["lapin"] == pytest.approx(math.log10(5 / 2))


def test_expansion_without_terms(spark):
    topics = spark.createDataFrame([("1", "eau"), ("2", "feu")], "qid string, query string")
    terms = spark.createDataFrame([("a", "1", t, s) for t, s in (("pluie", 0.5), ("neige", 0.5), ("vent", 0.1))] + [("b", "1", "vent", 0.3)], "period string, qid string, term string, score double")
    assert {r.qid: r.query for r in expand(topics, terms, 2).collect()} == {"1": "eau neige pluie", "2": "feu"}
