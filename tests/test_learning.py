"""Registered learning queries on small tables written for the test."""

from palimpsest.plans import learning


def test_vocabulary_keeps_rare_terms(snapshot, tmp_path, spark):
    words = [f"w{i}" for i in range(700)]
    rows = [("doc1", "2023-01", " ".join(words), "a.example", 1), ("doc2", "2023-01", " ".join(words[:2]), "a.example", 1)]
    snapshot(rows).write.parquet(str(tmp_path / "document_snapshot.parquet"))
    got = {r.term: r["count"] for r in learning.vocabulary_topn(spark, str(tmp_path)).collect()}
    assert len(got) == 700 and got["w0"] == 2 and got["w699"] == 1
    hot = {r.docid: r.term_idx for r in learning.multi_hot(spark, str(tmp_path)).collect()}
    assert len(hot[1].split(",")) == 700
