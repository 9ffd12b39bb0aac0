"""The key domain reaches as far as the reference's."""

from palimpsest.plans import relational


def test_bound(spark, monkeypatch):
    rows = [("1", 1), ("24999", 1), ("27004", 1), ("81999", 1), ("82000", 1), ("27004", 0)]
    monkeypatch.setattr(relational.b, "qrels", lambda *_: spark.createDataFrame(rows, "qid string, label int"))
    assert [r.qid for r in relational.key_domain_filter(spark, "").collect()] == ["1", "24999", "27004", "81999"]
