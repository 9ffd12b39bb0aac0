"""Descriptions of tables, readers and writers, lookups and splits as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import Bm25
from palimpsest.functions.text import word_tokens
from palimpsest.operators import frames
from palimpsest.operators.index import open_index, save_index
from palimpsest.operators.lineage import shared_folder
from palimpsest.plans import base as b
from palimpsest.plans.base import DOCS, QRELS, RUNS, TOPICS, TOPICS_ONCE, Registry, tokens_sql
from palimpsest.plans.ranking import INDEX
from palimpsest.sources import trec
from palimpsest.sources.tables import python_strings, table

R = Registry()
_RUN = ("qid", "iter", "docno", "rank", "score", "name")


@R.query(" union all ".join(f"select '{c}' as \"column\", count(*) as rows, count({c}) as filled from run_result" for c in _RUN))
def table_shape(spark: SparkSession, root: str) -> DataFrame:
    return frames.describe_columns(table(spark, root, "run_result")).select("column", "rows", "filled")


@R.query("select o_orderkey, o_custkey, year(o_orderdate)::int as year from orders")
def shrunk_types(spark: SparkSession, root: str) -> DataFrame:
    """Keys and years of orders in the smallest types; values stay."""
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    small = frames.shrink(o)
    return small.select(*(F.col(c).cast(t) for c, t in o.dtypes))


@R.query("select 'l_quantity' as name union all select 'l_discount' union all select 'l_extendedprice' union all select 'l_tax'")
def discovered_columns(spark: SparkSession, root: str) -> DataFrame:
    """The measures of lineitem by the pattern of their names."""
    names = frames.columns_like(table(spark, root, "lineitem"), "l_(quantity|extendedprice|discount|tax)")
    return spark.createDataFrame([(n,) for n in names], "name string")


@R.query(f"with {DOCS}, {RUNS}, n as (select docid, row_number() over (order by docid) - 1 as index from current_row where sub_collection = '2023-03') select name, qid, docid, coalesce(index, -1)::int as index from runs left join n using (docid)")
def id_lookup(spark: SparkSession, root: str) -> DataFrame:
    """The number of each listed page in the snapshot of 2023-03, -1 for pages that are not in it.

    Numbers follow docids: pages are ranged and counted per range first, so no task numbers them all.
    """
    d = b.docs(spark, root).filter("sub_collection = '2023-03'").select("docid")
    return frames.lookup(b.runs(spark, root), numbered(d, "docid"), "docid", "index").select("name", "qid", "docid", F.col("index").cast("int").alias("index"))


def numbered(df: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """key, index: distinct keys numbered from 0 in their order. Runs of ``width`` values are counted, the counts summed up, and each run numbered for itself."""
    from pyspark.sql.window import Window

    k = df.select(key).distinct().withColumn("_r", F.floor(F.col(key) / width))
    upto = k.groupBy("_r").agg(F.count("*").alias("_n"))
    before = upto.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_b")
    return k.join(before, "_r").select(key, (F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy(key)) - 1).alias("index"))


@R.query(f"with {TOPICS_ONCE} select qid, len({tokens_sql('query')}) as n, array_to_string({tokens_sql('query')}, ' ') as joined from topics_once")
def stringified_list(spark: SparkSession, root: str) -> DataFrame:
    """Token lists printed as text and read back."""
    t = b.topics_once(spark, root).select("qid", word_tokens(F.col("query")).alias("t"))
    printed = F.concat(F.lit("['"), F.array_join("t", "', '"), F.lit("']"))
    back = t.select("qid", F.when(F.size("t") == 0, "[]").otherwise(printed).alias("text")).select("qid", python_strings("text").alias("t"))
    return back.select("qid", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("joined"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@R.query(f"with {QRELS} select qid, docid, sub_collection, label from qrels")
def csv_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Judgments as CSV with a header, first one snapshot, then the others appended, read under a declared schema."""
    path, q = _folder(spark, "csv"), b.qrels(spark, root).select("qid", "docid", "sub_collection", "label")
    trec.write_csv(q.filter("sub_collection = '2022-10'"), path)
    q.filter("sub_collection <> '2022-10'").write.mode("append").csv(path, header=True)
    return trec.read_csv(spark, path, "qid string, docid bigint, sub_collection string, label int")


@R.query(f"with {TOPICS_ONCE} select qid, query from topics_once")
def tsv_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Queries as TSV without a header, copied line by line, read as a query file."""
    path, copy = _folder(spark, "tsv"), _folder(spark, "lines")
    t = b.topics_once(spark, root).select("qid", "query")
    t.select(F.concat_ws("\t", "qid", "query").alias("value")).write.text(path)
    trec.copy_lines(spark, path, copy)
    return trec.read_queries(spark, copy)


@R.query(f"with {DOCS} select sub_collection, count(*) as pages from current_row where sub_collection >= '2023-01' group by sub_collection")
def snapshot_folders(spark: SparkSession, root: str) -> DataFrame:
    """Pages written as one folder per snapshot; later months are read by pruning folders."""
    path = _folder(spark, "snapshots")
    trec.write_snapshots(b.docs(spark, root).select("docid", "sub_collection"), path)
    return spark.read.parquet(path).filter("sub_collection >= '2023-01'").groupBy("sub_collection").agg(F.count("*").alias("pages"))


@R.query(f"with {TOPICS}, w as (select query, max(case when sub_collection = '2022-10' then qid end) as a, max(case when sub_collection = '2022-11' then qid end) as b, max(case when sub_collection = '2022-12' then qid end) as c, max(case when sub_collection = '2023-01' then qid end) as d, max(case when sub_collection = '2023-02' then qid end) as e, max(case when sub_collection = '2023-03' then qid end) as f from (select lower(query) as query, sub_collection, qid from topics) group by query) select query, a, b, c, d, e, f, coalesce(a, b, c, d, e, f) as first from w")
def outer_merge_all(spark: SparkSession, root: str) -> DataFrame:
    """Full outer merge of the topics of all six snapshots on their text: one grouping of the long form, one column per snapshot."""
    t = b.topics(spark, root).select(F.lower("query").alias("query"), "sub_collection", "qid")
    names = dict(zip(("2022-10", "2022-11", "2022-12", "2023-01", "2023-02", "2023-03"), "abcdef"))
    wide = t.groupBy("query").agg(*(F.max(F.when(F.col("sub_collection") == s, F.col("qid"))).alias(n) for s, n in names.items()))
    return wide.withColumn("first", F.coalesce(*names.values()))


@R.query(f"with {TOPICS_ONCE} select qid, replace(replace(query, ' ', chr(10)), chr(10), ' ') as one_line, 'boost=' || printf('%.2f', length(query) / 100.0) as tag from topics_once")
def name_formats(spark: SparkSession, root: str) -> DataFrame:
    """Line ends as blanks, and numbers in names with two places."""
    q = F.replace(F.replace("query", F.lit(" "), F.lit("\n")), F.lit("\n"), F.lit(" "))
    return b.topics_once(spark, root).select("qid", q.alias("one_line"), F.format_string("boost=%.2f", F.length("query") / 100.0).alias("tag"))


@R.query(f"with {RUNS} select name, qid, docid, score, cast(row_number() over (partition by name, qid order by score desc, docid) - 1 as int) as rank, cast(row_number() over (order by name, qid desc, score desc, docid) as bigint) as line from runs")
def run_lines(spark: SparkSession, root: str) -> DataFrame:
    """The place of each row in a file ordered by name, qid descending and rank from 0: rows per list are counted, summed up, and numbered in their list."""
    from pyspark.sql.window import Window

    from palimpsest.operators.rank import ranked

    r = ranked(b.runs(spark, root), ["name", "qid"], base=0)
    lists = r.groupBy("name", "qid").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col("name").asc(), F.col("qid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = lists.select("name", "qid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return r.join(before, ["name", "qid"]).select("name", "qid", "docid", "score", "rank", (F.col("before") + F.col("rank") + 1).cast("bigint").alias("line"))


@R.query(
    f"with {QRELS}, u as (select ('0x' || substr(md5(qid || '|' || docid || '|' || sub_collection || '|42'), 1, 8))::bigint / 4294967296.0::double as u from qrels) "
    "select case when u < 0.7::double then 'train' when u < 0.7::double + 0.15::double then 'validation' else 'test' end as part, count(*) as n from u group by 1"
)
def random_parts(spark: SparkSession, root: str) -> DataFrame:
    q = b.qrels(spark, root).withColumn("key", F.concat_ws("|", "qid", "docid", "sub_collection"))
    return frames.random_split(q, "key").groupBy("part").agg(F.count("*").alias("n"))


@R.query(f"with {INDEX} select sub_collection, term, sum(tf) as tf, max(dl) as longest from post join dl using (sub_collection, docid) where term in ('maison', 'vent', 'musée') group by all")
def stored_index(spark: SparkSession, root: str) -> DataFrame:
    """An index saved to a folder and opened again; three terms are read from its postings."""
    path = _folder(spark, "index")
    save_index(b.docs(spark, root), ["sub_collection"], path)
    p = open_index(spark, ["sub_collection"], path).postings.filter(F.col("term").isin("maison", "vent", "musée"))
    return p.groupBy("sub_collection", "term").agg(F.sum("tf").alias("tf"), F.max("dl").alias("longest"))


@R.query(f"select i as epoch, round(0.001 * (1 + cos(pi() * i / 99)) / 2, 9) as rate, {Bm25().depth} as depth from range(100) t(i)")
def learning_rates(spark: SparkSession, root: str) -> DataFrame:
    """A cosine schedule over 100 epochs, beside the depth of runs."""
    rows = [(e, round(frames.cosine_rate(e, 99), 9), Bm25().depth) for e in range(100)]
    return spark.createDataFrame(rows, "epoch bigint, rate double, depth int")


QUERIES, ORACLE = R.queries, R.oracle
