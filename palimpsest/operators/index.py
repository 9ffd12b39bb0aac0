"""An inverted index as DataFrames: postings, document statistics, lexicon and collection statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import word_tokens
from palimpsest.operators.lineage import materialize


@dataclass(frozen=True)
class Index:
    """postings (part, docid, term, tf, dl), docs (part, docid, dl), lexicon (part, term, df, cf), stats (part, n, avdl).

    ``part`` columns name the collection a document belongs to, such as its snapshot; statistics are per collection. Postings carry the length of
    their document, so that scoring joins nothing but the query.
    """

    part: list[str]
    postings: DataFrame
    docs: DataFrame
    lexicon: DataFrame
    stats: DataFrame


def build_index(docs: DataFrame, part: list[str], docid: str = "docid", text: str = "text", tokens: Column | None = None) -> Index:
    """Postings are written once to the shared folder and read by all parts of the index.

    Null texts are documents of length 0: they count in n and avdl and have no postings.
    """
    return _parts(part, materialize(_postings(docs, part, docid, text, tokens), "postings"))


def _postings(docs: DataFrame, part: list[str], docid: str, text: str, tokens: Column | None) -> DataFrame:
    tokens = word_tokens(F.col(text)) if tokens is None else tokens
    split = docs.select(*part, F.col(docid).alias("docid"), tokens.alias("_t"))
    flat = split.select(*part, "docid", F.coalesce(F.size("_t"), F.lit(0)).cast("bigint").alias("dl"), F.explode_outer("_t").alias("term"))
    return flat.groupBy(*part, "docid", "dl", "term").agg(F.count("term").alias("tf"))


def _parts(part: list[str], postings: DataFrame) -> Index:
    lengths = postings.groupBy(*part, "docid").agg(F.max("dl").alias("dl"))
    real = postings.filter("term is not null")
    lexicon = real.groupBy(*part, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = lengths.groupBy(*part).agg(F.count("*").alias("n"), F.avg("dl").alias("avdl"))
    return Index(part, real, lengths, lexicon, stats)


def save_index(docs: DataFrame, part: list[str], path: str, docid: str = "docid", text: str = "text", tokens: Column | None = None) -> None:
    """Writes an index to a folder: postings in one folder per collection, sorted by term within files so that a query's terms skip row groups; lexicon, docs and stats beside them."""
    _postings(docs, part, docid, text, tokens).repartition(*part, "term").sortWithinPartitions(*part, "term", "docid").write.mode("overwrite").partitionBy(*part).parquet(f"{path}/postings")
    spark = docs.sparkSession
    index = _parts(part, spark.read.parquet(f"{path}/postings"))
    for name in ("docs", "lexicon", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def open_index(spark: SparkSession, part: list[str], path: str) -> Index:
    """An index written by ``save_index``; nothing is computed again."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(part, read("postings").filter("term is not null"), read("docs"), read("lexicon"), read("stats"))
