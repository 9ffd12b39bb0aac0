"""BM25, TF-IDF and query expansion over an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.config import Bm25
from palimpsest.functions.text import word_tokens
from palimpsest.operators.index import Index
from palimpsest.operators.rank import top_k


def bm25(topics: DataFrame, index: Index, p: Bm25 = Bm25()) -> DataFrame:  # noqa: B008
    """part, qid, docid, score, rank: the best documents of each topic (part, qid, query) within its collection.

    idf = log2((n - df + .5) / (df + .5)), negative for terms in more than half of the documents. Scores are rounded to 6 places
    before ranking; ties go to the smaller docid. Topics without terms of the collection give no rows.
    Only the postings of query terms are joined; postings carry their document's length. The query side is small and Spark broadcasts it if it is. Partial sums per
    query and document are made before the shuffle.
    """
    part = index.part
    q = topics.select(*part, "qid", F.explode(word_tokens(F.col("query"))).alias("term")).groupBy(*part, "qid", "term").agg(F.count("*").alias("qtf"))
    q = q.join(index.lexicon.select(*part, "term", "df"), [*part, "term"]).join(index.stats, part)
    idf = F.log2((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = q.select(*part, "qid", "term", "avdl", (idf * (p.k3 + 1) * F.col("qtf") / (p.k3 + F.col("qtf"))).alias("w"))
    hits = index.postings.join(q, [*part, "term"])
    tf = (p.k1 + 1) * F.col("tf") / (p.k1 * ((1 - p.b) + p.b * F.col("dl") / F.col("avdl")) + F.col("tf"))
    scores = hits.groupBy(*part, "qid", "docid").agg(F.round(F.sum(F.col("w") * tf), 6).alias("score"))
    return top_k(scores, [*part, "qid"], p.depth)


def term_frequencies(index: Index) -> DataFrame:
    """part, docid, term, tf: each term's share of its document's length."""
    return index.postings.select(*index.part, "docid", "term", (F.col("tf") / F.col("dl")).alias("tf"))


def inverse_frequencies(index: Index) -> DataFrame:
    """part, term, df, idf = log10(n / (1 + df))."""
    x = index.lexicon.join(index.stats, index.part)
    return x.select(*index.part, "term", "df", F.log10(F.col("n") / (1 + F.col("df"))).alias("idf"))


def tfidf(index: Index, min_length: int = 5, stop: list[str] | None = None) -> DataFrame:
    """part, docid, term, tfidf of candidate terms: letters only, ``min_length`` or more, no stop word."""
    idf = inverse_frequencies(index).filter(F.col("term").rlike("^\\p{L}+$") & (F.length("term") >= min_length))
    if stop:
        idf = idf.filter(~F.col("term").isin(stop))
    tf = term_frequencies(index)
    return tf.join(idf.drop("df"), [*index.part, "term"]).select(*index.part, "docid", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("tfidf"))


def top_terms(scores: DataFrame, group: list[str], n: int, score: str = "tfidf") -> DataFrame:
    """The n best terms of each group with their rank, ties to the smaller term."""
    return top_k(scores, group, n, score, "term")


def expansion_terms(judged: DataFrame, weights: DataFrame, part: str) -> DataFrame:
    """part, qid, term, score: for each query and period the best term of each relevant document, each term once with its best score."""
    best = top_terms(weights, [part, "docid"], 1).select(part, "docid", "term", "tfidf")
    return judged.select(part, "qid", "docid").distinct().join(best, [part, "docid"]).groupBy(part, "qid", "term").agg(F.max("tfidf").alias("score"))


def expand(topics: DataFrame, terms: DataFrame, n: int = 9) -> DataFrame:
    """qid, query: the query followed by its n best terms over all periods (mean score of a term); as it is without terms."""
    mean = terms.groupBy("qid", "term").agg(F.round(F.avg("score"), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("term").asc())
    best = mean.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    added = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("x"))
    out = topics.join(added, "qid", "left")
    return out.select("qid", F.concat_ws(" ", "query", F.array_join(F.transform("x", lambda s: s["term"]), " ")).alias("query"))
