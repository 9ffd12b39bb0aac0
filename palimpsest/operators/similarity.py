"""Similarity of the same document at two snapshots, and of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import word_tokens


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays taken as sets; 0.0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null if one has length 0."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def snapshot_pairs(docs: DataFrame, earlier: str, later: str) -> DataFrame:
    """docid, text_a, text_b of documents with a text in both snapshots (sub_collection, docid, text)."""
    side = lambda s, c: docs.filter((F.col("sub_collection") == s) & F.col("text").isNotNull()).select("docid", F.col("text").alias(c))
    return side(earlier, "text_a").join(side(later, "text_b"), "docid")


def text_similarity(docs: DataFrame, earlier: str, later: str) -> DataFrame:
    """docid, similarity: Jaccard similarity of the word sets of a document's two texts, rounded to 6 places."""
    pairs = snapshot_pairs(docs, earlier, later)
    return pairs.select("docid", F.round(jaccard(word_tokens(F.col("text_a")), word_tokens(F.col("text_b"))), 6).alias("similarity"))


def similarity_bucket(sim: Column) -> Column:
    """Label of the similarity bucket, null below 0.80."""
    s = F.least(F.round(sim, 6), F.lit(1.0))
    return F.when(s >= 1.0, "100%").when(s >= 0.95, "95-99%").when(s >= 0.90, "90-94%").when(s >= 0.85, "85-89%").when(s >= 0.80, "80-84%")
