"""Cleaned views of the tables that most queries start from, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.ids import bare_docid
from palimpsest.functions.text import is_blank
from palimpsest.operators.annotate import clean_category
from palimpsest.operators.snapshots import current_rows, latest
from palimpsest.plans.sqltext import CURRENT
from palimpsest.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries with their SQL; ``@r.query(sql)`` registers a function under its name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return keep


def docs(spark: SparkSession, root: str) -> DataFrame:
    """docid, sub_collection, text, host of the current rows."""
    return current_rows(table(spark, root, "document_snapshot"))


def qrels(spark: SparkSession, root: str) -> DataFrame:
    """qid, docid, sub_collection, label: one judgment per key, the highest of conflicting ones; bad values fall out."""
    q = table(spark, root, "qrel").select(F.trim("queryid").alias("qid"), bare_docid(F.col("docid")).alias("docid"), "sub_collection", F.trim("relevance").try_cast("int").alias("label"))
    return q.dropna().filter("label >= 0").groupBy("qid", "docid", "sub_collection").agg(F.max("label").alias("label"))


def qrels_any(spark: SparkSession, root: str) -> DataFrame:
    """qid, docid, label: the highest judgment over all snapshots."""
    return qrels(spark, root).groupBy("qid", "docid").agg(F.max("label").alias("label"))


def topics(spark: SparkSession, root: str) -> DataFrame:
    """qid, sub_collection, query, id: the first row of each topic in each snapshot that has a text."""
    t = table(spark, root, "topic").select(F.trim("queryid").alias("qid"), "sub_collection", F.trim("text_fr").alias("query"), "id")
    t = t.filter(~is_blank(F.col("query"))).filter("qid is not null and sub_collection is not null")
    return latest(t, ["qid", "sub_collection"], [F.col("id").asc(), F.col("query").asc()])


def topics_once(spark: SparkSession, root: str) -> DataFrame:
    """qid, query: each topic once."""
    return latest(topics(spark, root), ["qid"], [F.col("id").asc(), F.col("query").asc()]).select("qid", "query")


def categories(spark: SparkSession, root: str) -> DataFrame:
    """qid, category: the most frequent known answer, ties to the first in the alphabet."""
    c = table(spark, root, "query_category").select(F.trim("qid").alias("qid"), clean_category(F.col("answer")).alias("category")).dropna()
    c = c.groupBy("qid", "category").agg(F.count("*").alias("n"))
    return latest(c, ["qid"], [F.col("n").desc(), F.col("category").asc()]).select("qid", "category")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """name, qid, docid, score: each document of a list once with its best score; null and NaN scores fall out."""
    r = table(spark, root, "run_result").select("name", F.trim("qid").alias("qid"), bare_docid(F.col("docno")).alias("docid"), "score")
    return r.dropna().filter(~F.isnan("score")).groupBy("name", "qid", "docid").agg(F.max("score").alias("score"))


QRELS = """
qrels as (
  select qid, docid, sub_collection, max(label) as label from (
    select trim(queryid) as qid, try_cast(regexp_replace(docid, '[^0-9]', '', 'g') as bigint) as docid, sub_collection, try_cast(trim(relevance) as int) as label from qrel
  ) where qid is not null and docid is not null and sub_collection is not null and label >= 0 group by all
)"""
QRELS_ANY = QRELS + ", qrels_any as (select qid, docid, max(label) as label from qrels group by all)"
TOPICS = """
topics as (
  select qid, sub_collection, query, id from (
    select trim(queryid) as qid, sub_collection, trim(text_fr) as query, id, row_number() over (partition by trim(queryid), sub_collection order by id, trim(text_fr)) as rn
    from topic where regexp_replace(coalesce(text_fr, ''), '[ \\t\\r\\n\\x{00A0}]+', '', 'g') <> '' and queryid is not null and sub_collection is not null
  ) where rn = 1
)"""
TOPICS_ONCE = TOPICS + ", topics_once as (select qid, query from topics qualify row_number() over (partition by qid order by id, query) = 1)"
CATEGORIES = """
categories as (
  select qid, category from (
    select qid, category, row_number() over (partition by qid order by count(*) desc, category) as rn
    from (select trim(qid) as qid, rtrim(lower(trim(answer)), '.') as category from query_category)
    where qid is not null and category in ('time-independent', 'timeliness', 'event', 'explicit-time') group by qid, category
  ) where rn = 1
)"""
RUNS = """
runs as (
  select name, qid, docid, max(score) as score from (
    select name, trim(qid) as qid, try_cast(regexp_replace(docno, '[^0-9]', '', 'g') as bigint) as docid, score from run_result
  ) where name is not null and qid is not null and docid is not null and score is not null and not isnan(score) group by all
)"""
DOCS = CURRENT
#: Word tokens of a column in SQL: Unicode letters, numbers, underscore.
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def tokens_sql(c: str) -> str:
    return TOKENS.format(c)
