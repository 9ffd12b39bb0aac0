"""The registered searches have the sizes of the reference."""

from pyspark.sql import functions as F

from palimpsest.plans import learning, ranking


def test_full_grids(spark, monkeypatch):
    """Every configuration of a grid that is evaluated in parts has the metrics of that configuration evaluated alone."""
    run = spark.createDataFrame([("s", "q", 1, 2.0), ("s", "q", 2, 2.1), ("s", "r", 1, 1.0), ("s", "r", 3, 1.15), ("s", "u", 2, 1.0)], "name string, qid string, docid bigint, score double")
    qrels = spark.createDataFrame([("q", 1, 1), ("r", 1, 2), ("u", 2, 1)], "qid string, docid bigint, label int")
    cats = spark.createDataFrame([("q", "event"), ("r", "timeliness")], "qid string, category string")
    monkeypatch.setattr(ranking, "_dates", lambda *_: spark.createDataFrame([(1, 1), (2, 9)], "docid bigint, n_dates int"))
    monkeypatch.setattr(ranking, "_tagged", lambda *_: run.withColumn("tag", F.lit(1.0)).withColumn("occurrences", F.lit(3)))
    for n, f in (("runs", run), ("qrels_any", qrels), ("categories", cats)):
        monkeypatch.setattr(ranking.b, n, lambda *_, f=f: f)
    boosts = ranking.boost_sweep(spark, "").collect()
    assert len(boosts) == 110 and {round(r.boost, 2) for r in boosts if r.ap == 1.0} == {round(1 + i / 100, 2) for i in range(16, 110)}
    grid = ranking.category_grid(spark, "").collect()
    assert len(grid) == 625 and {r.queries for r in grid} == {3}
    for r in grid:
        want = (1.0 if r.w_event > 1.05 else 0.5) + (1.0 if r.w_timeliness > 1.15 else 0.5) + 1.0
        assert abs(r.ap - want / 3) < 1e-5, r
    assert ranking.weight_grid(spark, "").count() == 64


def test_silhouettes_of_every_k(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(learning, "_vectors", lambda *_: None)
    monkeypatch.setattr(learning.learn, "silhouettes", lambda _, ks: seen.extend(ks) or spark.createDataFrame([(2, 0.5)], "k int, silhouette double"))
    learning.silhouette_sweep(spark, "")
    assert seen == list(range(2, 100))
