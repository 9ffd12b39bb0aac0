"""Readers for the Parquet tables, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "document_snapshot": "docid string, sub_collection string, text_fr string, url string, crawl_dates string, delivered_at timestamp_ntz",
    "topic": "id bigint, queryid string, text_fr string, text_en string, sub_collection string, split string",
    "query_category": "qid string, query string, answer string",
    "qrel": "queryid string, docid string, relevance string, sub_collection string",
    "run_result": "qid string, iter string, docno string, rank int, score double, name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, sub_collection string, fetched_at timestamp_ntz",
    "heldout_item": "item_id bigint, queryid string, text string",
    "mix_target": "source string, target_share double, max_repeat int",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``root/name.parquet``; the schema is declared where SCHEMAS has it, so that no footer is read to infer it."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{root}/{name}.parquet")


def register(spark: SparkSession, root: str, names: list[str]) -> None:
    """Temporary views of the tables, for queries written in SQL."""
    for n in names:
        table(spark, root, n).createOrReplaceTempView(n)


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table of a database read in ``parts`` ranges of a numeric column, one connection each."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options)
        .load()
    )


def json_strings(column: str) -> F.Column:
    """A text column that holds a JSON array of strings; null and text that is no valid JSON give an empty array.

    Validity is checked on its own, as ``from_json`` keeps the part of a broken array that it could read.
    """
    read = F.from_json(F.col(column), T.ArrayType(T.StringType()))
    return F.coalesce(F.when(F.try_parse_json(F.col(column)).isNotNull(), read), F.array().cast("array<string>"))


def python_strings(column: str) -> F.Column:
    """A text column that holds a printed list of strings (['a', "b"]); null gives null, text that is no list an empty array.

    Quotes are single or double; a backslash keeps the next character.
    """
    quoted = "'((?:[^'\\\\]|\\\\.)*)'|\"((?:[^\"\\\\]|\\\\.)*)\""
    items = F.regexp_extract_all(F.col(column), F.lit(f"({quoted})"), F.lit(1))
    plain = F.transform(items, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), "\\\\(.)", "$1"))
    return F.when(F.col(column).isNull(), None).when(F.col(column).rlike("^\\s*\\[.*\\]\\s*$"), plain).otherwise(F.array().cast("array<string>"))


def python_numbers(column: str) -> F.Column:
    """A text column that holds a printed list of numbers ([1.0, 2e-3]) as array<double>; null and text that is no list give null."""
    return F.from_json(F.col(column), T.ArrayType(T.DoubleType()))


def reachable(spark: SparkSession, url: str, name: str, **options: str) -> bool:
    """Whether a database answers: one row is asked for, no more."""
    try:
        spark.read.format("jdbc").options(url=url, query=f"select * from {name} limit 1", **options).load().take(1)
    except Exception:  # whatever the driver raises, the answer is no
        return False
    return True
