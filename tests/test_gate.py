"""The gated re-ranking uses every vector."""

from palimpsest.plans import learning


def test_vectors_above_500_take_part(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, [0.0 if i == 600 else 9.0], 3) for i in range(700)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(learning.b, "runs", lambda *_: spark.createDataFrame([("s", "q", 600, 2.0), ("s", "q", 1300, 1.0)], "name string, qid string, docid bigint, score double"))
    monkeypatch.setattr(learning, "_clusters", lambda *_: spark.createDataFrame([("q", 3)], "qid string, cluster int"))
    assert [(r.docid, r.score) for r in learning.cluster_gated_rerank(spark, str(tmp_path)).orderBy("rank").collect()] == [(600, 2.0), (1300, 1.0)]
