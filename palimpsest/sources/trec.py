"""Readers and writers of run, judgment and query files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ").alias("f"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, iter, docno, rank, score, name of a run file separated by blanks or tabs, gzip or plain; lines of other than six fields fall out."""
    x = _fields(spark, path).filter(F.size("f") == 6)
    return x.select(F.col("f")[0].alias("qid"), F.col("f")[1].alias("iter"), F.col("f")[2].alias("docno"), F.col("f")[3].try_cast("int").alias("rank"), F.col("f")[4].try_cast("double").alias("score"), F.col("f")[5].alias("name"))


def read_qrels(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """qid, docid, relevance of a judgment file; lines whose last field is no whole number fall out; ``keep`` leaves one grade only."""
    x = _fields(spark, path).filter(F.size("f") >= 4).select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("docid"), F.element_at("f", -1).try_cast("int").alias("relevance"))
    x = x.filter("relevance is not null")
    return x if keep is None else x.filter(F.col("relevance") == keep)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, query of a file with a tab after the id; further tabs belong to the query; both are trimmed, lines without a tab fall out."""
    x = spark.read.text(path).select(F.split("value", "\t", 2).alias("f")).filter(F.size("f") == 2)
    return x.select(F.trim(F.col("f")[0]).alias("qid"), F.trim(F.col("f")[1]).alias("query"))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV file under a declared schema; names come from the schema, with a header line or without."""
    return spark.read.csv(path, schema=schema, header=header, enforceSchema=True, escape='"')


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """qid, query, period, term, score of all files of a folder (CSV with header); the period is the file's name up to its extension."""
    x = spark.read.csv(path, schema="qid string, query string, term string, score double", header=True)
    return x.withColumn("period", F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.[^/]*)?$", 1))


def read_wide_expansions(spark: SparkSession, path: str) -> DataFrame:
    """query, period, term, score of one wide CSV file with columns z_<n>_term and z_<n>_tf_idf, found by their names; null terms fall out.

    A file without a pair of such columns gives no rows.
    """
    x = spark.read.csv(path, header=True)
    terms = {m[1]: c for c in x.columns if (m := re.fullmatch(r"z_(.+)_term", c))}
    pairs = [(n, c, f"z_{n}_tf_idf") for n, c in terms.items() if f"z_{n}_tf_idf" in x.columns]
    if not pairs:
        return spark.createDataFrame([], "query string, period string, term string, score double")
    rows = F.array(*(F.struct(F.lit(n).alias("period"), F.col(f"`{t}`").alias("term"), F.col(f"`{s}`").try_cast("double").alias("score")) for n, t, s in pairs))
    return x.select("query", F.inline(rows)).filter("term is not null")


def write_run(run: DataFrame, path: str, sep: str = " ", prefix: str = "", iteration: str = "Q0", one_file: bool = False) -> None:
    """Writes qid iter docno rank score name, gzip, ordered by qid and rank. One file only if asked for: a sort across the cluster otherwise."""
    docno = F.concat(F.lit(prefix), F.col("docid").cast("string"))
    rows = run.select("qid", F.lit(iteration).alias("iter"), docno.alias("docno"), "rank", "score", "name")
    rows = rows.coalesce(1).sortWithinPartitions("name", "qid", "rank") if one_file else rows.orderBy("name", "qid", "rank")
    rows.write.mode("overwrite").csv(path, sep=sep, compression="gzip", header=False, quote="")


def write_snapshots(df: DataFrame, path: str, key: str = "sub_collection") -> None:
    """One folder per snapshot."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet folder; the first call makes it."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """CSV with a header line in each part, null as an empty field; with a tab as ``sep`` it is TSV."""
    df.write.mode("overwrite").csv(path, sep=sep, header=header, quote='"', escape='"', nullValue="", emptyValue='""')


def copy_lines(spark: SparkSession, source: str, target: str) -> None:
    """Writes the lines of text files as they are."""
    spark.read.text(source).write.mode("overwrite").text(target)
