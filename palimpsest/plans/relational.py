"""Projections, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.config import SPAM_QIDS
from palimpsest.functions.ids import add_prefix, bare_docid, source_name, strip_chars, strip_prefix
from palimpsest.functions.text import clean_query, drop_punctuation, fold_accents, safe_unit, split_elisions, word_tokens
from palimpsest.operators.rank import factor_map, ranked, top_k
from palimpsest.operators.snapshots import latest
from palimpsest.plans import base as b
from palimpsest.plans.base import CATEGORIES, DOCS, QRELS, QRELS_ANY, RUNS, TOPICS, TOPICS_ONCE, Registry, tokens_sql
from palimpsest.sources.tables import json_strings, table

R = Registry()
_SPAM = ", ".join(f"'{q}'" for q in SPAM_QIDS)


@R.query("select event_id, user_id, upper(event_type) as kind, cast(value as decimal(12, 2)) as value, 'e' as tag from events where event_type <> 'view' and value > 10 and user_id between 5 and 100 and props is not null")
def scan_filter_project(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").filter("event_type <> 'view' and value > 10 and user_id between 5 and 100 and props is not null")
    return e.select("event_id", "user_id", F.upper("event_type").alias("kind"), F.col("value").cast("decimal(12,2)").alias("value"), F.lit("e").alias("tag"))


@R.query("select queryid, docid, sub_collection, relevance, case when try_cast(relevance as double) between 0 and 1 then try_cast(relevance as double) else 0.0 end as unit from qrel")
def safe_numeric_clean(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "qrel").select("queryid", "docid", "sub_collection", "relevance", safe_unit(F.col("relevance")).alias("unit"))


@R.query(f"with {QRELS} select qid, docid, sub_collection, label from qrels where try_cast(qid as bigint) between 1 and 81999 and label > 0")
def key_domain_filter(spark: SparkSession, root: str) -> DataFrame:
    """Relevant judgments of the queries 1 to 81 999."""
    return b.qrels(spark, root).filter(F.col("qid").try_cast("bigint").between(1, 81_999) & (F.col("label") > 0))


@R.query(f"with {TOPICS} select qid, sub_collection, query from topics where sub_collection in ('2023-02', '2023-03') and qid not in ({_SPAM})")
def in_and_not_in(spark: SparkSession, root: str) -> DataFrame:
    return b.topics(spark, root).filter(F.col("sub_collection").isin("2023-02", "2023-03") & ~F.col("qid").isin(*SPAM_QIDS)).select("qid", "sub_collection", "query")


@R.query(
    f"with {RUNS}, {CATEGORIES} select name, qid, docid, score, category, case category when 'time-independent' then 1.2 when 'timeliness' then 1.15 when 'event' then 1.15 when 'explicit-time' then 1.2 else 1.0 end as factor "
    "from runs left join categories using (qid)"
)
def conditional_map(spark: SparkSession, root: str) -> DataFrame:
    from palimpsest.config import CATEGORY_FACTORS

    x = b.runs(spark, root).join(b.categories(spark, root), "qid", "left")
    return x.select("name", "qid", "docid", "score", "category", factor_map(F.col("category"), CATEGORY_FACTORS).alias("factor"))


@R.query(
    "select sub_collection, count(*) as n, count(*) filter (sub_collection <= '2023-01') as n_text, count(*) filter (cast(substr(sub_collection, 1, 4) as int) < 2023 or (cast(substr(sub_collection, 1, 4) as int) = 2023 and cast(substr(sub_collection, 6, 2) as int) <= 1)) as n_split "
    "from document_snapshot group by sub_collection"
)
def month_window_predicate(spark: SparkSession, root: str) -> DataFrame:
    """Rows up to 2023-01 in every snapshot, by comparing the text and by comparing year and month: the same for zero-padded months."""
    year, month = F.substring("sub_collection", 1, 4).cast("int"), F.substring("sub_collection", 6, 2).cast("int")
    inside = (year < 2023) | ((year == 2023) & (month <= 1))
    d = table(spark, root, "document_snapshot")
    return d.groupBy("sub_collection").agg(F.count("*").alias("n"), F.count(F.when(F.col("sub_collection") <= "2023-01", 1)).alias("n_text"), F.count(F.when(inside, 1)).alias("n_split"))


@R.query(f"with {DOCS}, {QRELS} select qid, docid, sub_collection, label, length(coalesce(text, '')) as chars from qrels join current_row using (docid, sub_collection)")
def inner_multi_key(spark: SparkSession, root: str) -> DataFrame:
    return b.qrels(spark, root).join(b.docs(spark, root), ["docid", "sub_collection"]).select("qid", "docid", "sub_collection", "label", F.length(F.coalesce("text", F.lit(""))).alias("chars"))


@R.query(f"with {DOCS}, {QRELS}, {TOPICS} select q.qid, q.docid, q.sub_collection, q.label, t.query from qrels q join current_row d using (docid, sub_collection) join topics t on t.qid = q.qid and t.sub_collection = q.sub_collection where q.label <> 0")
def three_way_join(spark: SparkSession, root: str) -> DataFrame:
    q = b.qrels(spark, root).filter("label <> 0").join(b.docs(spark, root).select("docid", "sub_collection"), ["docid", "sub_collection"])
    return q.join(b.topics(spark, root), ["qid", "sub_collection"]).select("qid", "docid", "sub_collection", "label", "query")


@R.query(
    "select n_name, count(*) as lines, sum(cast(l_quantity as decimal(18, 2))) as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey "
    "where o_orderpriority = '1-URGENT' group by n_name"
)
def star_join(spark: SparkSession, root: str) -> DataFrame:
    li, o = table(spark, root, "lineitem"), table(spark, root, "orders").filter("o_orderpriority = '1-URGENT'")
    c, n = table(spark, root, "customer"), table(spark, root, "nation")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return x.groupBy("n_name").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))


@R.query(f"with {QRELS} select qid, docid, sub_collection, label from qrels where qid in (select qid from qrels where label > 0 and sub_collection <= '2022-12')")
def semi_in_subquery(spark: SparkSession, root: str) -> DataFrame:
    q = b.qrels(spark, root)
    return q.join(q.filter("label > 0 and sub_collection <= '2022-12'").select("qid").distinct(), "qid", "left_semi").select("qid", "docid", "sub_collection", "label")


@R.query(f"with {DOCS}, {QRELS} select qid, docid, label from qrels where sub_collection = '2023-03' and exists (select 1 from current_row c where c.docid = qrels.docid and c.sub_collection = '2023-03')")
def semi_exists_distinct(spark: SparkSession, root: str) -> DataFrame:
    have = b.docs(spark, root).filter("sub_collection = '2023-03'").select("docid")
    return b.qrels(spark, root).filter("sub_collection = '2023-03'").join(have, "docid", "left_semi").select("qid", "docid", "label")


@R.query(f"with {TOPICS_ONCE}, {QRELS}, n as (select qid, count(*) as n from qrels group by qid) select qid, query, coalesce(n, 0) as judged from topics_once left join n using (qid)")
def left_merge_fill(spark: SparkSession, root: str) -> DataFrame:
    n = b.qrels(spark, root).groupBy("qid").agg(F.count("*").alias("n"))
    return b.topics_once(spark, root).join(n, "qid", "left").select("qid", "query", F.coalesce("n", F.lit(0)).alias("judged"))


@R.query(
    f"with {TOPICS}, a as (select lower(query) as query, min(qid) as qid_a from topics where sub_collection = '2022-10' group by 1), b as (select lower(query) as query, min(qid) as qid_b from topics where sub_collection = '2022-11' group by 1) "
    "select query, qid_a, qid_b, coalesce(qid_a, qid_b) as qid from a full join b using (query)"
)
def full_outer_by_text(spark: SparkSession, root: str) -> DataFrame:
    t = b.topics(spark, root)
    side = lambda s, c: t.filter(F.col("sub_collection") == s).groupBy(F.lower("query").alias("query")).agg(F.min("qid").alias(c))
    x = side("2022-10", "qid_a").join(side("2022-11", "qid_b"), "query", "full")
    return x.select("query", "qid_a", "qid_b", F.coalesce("qid_a", "qid_b").alias("qid"))


@R.query(f"with {RUNS}, {QRELS_ANY} select name, qid, runs.docid as run_doc, score, q.docid as judged_doc, label, runs.docid = q.docid as same from runs join qrels_any q using (qid) where label > 0")
def fanout_join(spark: SparkSession, root: str) -> DataFrame:
    """Each listed page beside each relevant page of its query: the many-to-many join on the query alone.

    The judged side of a query is small; a listed query of a tenth of all rows is split by AQE, as nothing but a projection follows the join.
    """
    q = b.qrels_any(spark, root).filter("label > 0").select("qid", F.col("docid").alias("judged_doc"), "label")
    x = b.runs(spark, root).select("name", "qid", F.col("docid").alias("run_doc"), "score").join(q, "qid")
    return x.select("name", "qid", "run_doc", "score", "judged_doc", "label", (F.col("run_doc") == F.col("judged_doc")).alias("same"))


@R.query(f"with {TOPICS_ONCE}, {CATEGORIES} select qid, query from topics_once anti join categories using (qid)")
def anti_resume(spark: SparkSession, root: str) -> DataFrame:
    from palimpsest.streaming.resume import remaining

    return remaining(b.topics_once(spark, root), b.categories(spark, root).select("qid"), "qid").select("qid", "query")


_DATES = (
    "dates as (select try_cast(regexp_replace(docid, '[^0-9]', '', 'g') as bigint) as docid, unnest(from_json(crawl_dates, '[\"varchar\"]')) as day from document_snapshot "
    "where sub_collection <= '2023-02' and try_cast(crawl_dates as json) is not null and json_type(try_cast(crawl_dates as json)) = 'ARRAY')"
)


@R.query(f"with {_DATES} select docid, count(distinct day) as n_dates from dates where docid is not null and day is not null group by docid")
def lateral_json_distinct_dates(spark: SparkSession, root: str) -> DataFrame:
    return _dates(spark, root)


def _dates(spark: SparkSession, root: str, upto: str = "2023-02") -> DataFrame:
    d = table(spark, root, "document_snapshot").filter(F.col("sub_collection") <= upto)
    x = d.select(bare_docid(F.col("docid")).alias("docid"), F.explode(json_strings("crawl_dates")).alias("day")).filter("docid is not null and day is not null")
    return x.groupBy("docid").agg(F.countDistinct("day").alias("n_dates"))


@R.query(f"with {_DATES} select docid from dates where docid is not null and day is not null group by docid having count(distinct day) <= 3")
def rare_date_documents(spark: SparkSession, root: str) -> DataFrame:
    return _dates(spark, root).filter("n_dates <= 3").select("docid")


@R.query(f"with {DOCS} select a.docid, length(a.text) as chars_a, length(b.text) as chars_b from current_row a join current_row b on a.docid = b.docid where a.sub_collection = '2023-02' and b.sub_collection = '2023-03' and a.text is not null and b.text is not null")
def snapshot_pair(spark: SparkSession, root: str) -> DataFrame:
    from palimpsest.operators.similarity import snapshot_pairs

    return snapshot_pairs(b.docs(spark, root), "2023-02", "2023-03").select("docid", F.length("text_a").alias("chars_a"), F.length("text_b").alias("chars_b"))


@R.query("select round(1 + 0.05 * a.i, 2) as w_a, round(1 + 0.05 * b.i, 2) as w_b, round(1 + 0.05 * c.i, 2) as w_c, round(1 + 0.05 * d.i, 2) as w_d from range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i)")
def param_grid(spark: SparkSession, root: str) -> DataFrame:
    """The 625 points of a grid of four axes."""
    from palimpsest.operators.rank import grid

    steps = [round(1 + 0.05 * i, 2) for i in range(5)]
    return grid(spark, w_a=steps, w_b=steps, w_c=steps, w_d=steps).select("w_a", "w_b", "w_c", "w_d")


@R.query("select sub_collection, count(*) as n_rows, count(distinct docid) as docids, count(*) filter (text_fr is null) as no_text from document_snapshot group by sub_collection")
def counts_by_snapshot(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "document_snapshot")
    return d.groupBy("sub_collection").agg(F.count("*").alias("n_rows"), F.countDistinct("docid").alias("docids"), F.count(F.when(F.col("text_fr").isNull(), 1)).alias("no_text"))


@R.query(f"with {DOCS} select docid, count(*) as occurrences from current_row group by docid")
def docs_occurrence_count(spark: SparkSession, root: str) -> DataFrame:
    return b.docs(spark, root).groupBy("docid").agg(F.count("*").alias("occurrences"))


@R.query(f"with {DOCS}, h as (select host, count(*) as n from current_row where sub_collection = '2023-03' group by host) select d.docid, d.host, h.n from current_row d join h using (host) where sub_collection = '2023-03'")
def host_counts_joined(spark: SparkSession, root: str) -> DataFrame:
    d = b.docs(spark, root).filter("sub_collection = '2023-03'").select("docid", "host")
    return d.join(d.groupBy("host").agg(F.count("*").alias("n")), "host").select("docid", "host", "n")


@R.query(f"with {DOCS}, {QRELS}, {TOPICS} select count(*) as n from qrels q join current_row d using (docid, sub_collection) join topics t on t.qid = q.qid and t.sub_collection = q.sub_collection")
def judged_size(spark: SparkSession, root: str) -> DataFrame:
    q = b.qrels(spark, root).join(b.docs(spark, root).select("docid", "sub_collection"), ["docid", "sub_collection"])
    return q.join(b.topics(spark, root), ["qid", "sub_collection"]).agg(F.count("*").alias("n"))


@R.query(
    "select docid, sub_collection, cast(avg(label) as decimal(5, 2)) as relevance from (select try_cast(regexp_replace(docid, '[^0-9]', '', 'g') as bigint) as docid, sub_collection, try_cast(trim(relevance) as int) as label from qrel) "
    "where docid is not null and label is not null group by docid, sub_collection"
)
def avg_decimal(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "qrel").select(bare_docid(F.col("docid")).alias("docid"), "sub_collection", F.trim("relevance").try_cast("int").alias("label")).filter("docid is not null and label is not null")
    return q.groupBy("docid", "sub_collection").agg(F.avg("label").cast("decimal(5,2)").alias("relevance"))


@R.query("select distinct queryid, text_fr, text_en from topic")
def dedup_all(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "topic").select("queryid", "text_fr", "text_en").dropDuplicates()


@R.query("select qid, query, answer from (select *, row_number() over (partition by qid order by query nulls last, answer nulls last) as rn from query_category) where rn = 1")
def dedup_keep_first(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "query_category")
    return latest(c, ["qid"], [F.col("query").asc_nulls_last(), F.col("answer").asc_nulls_last()]).select("qid", "query", "answer")


@R.query(f"with {DOCS}, t as (select unnest({tokens_sql('text')}) as term from current_row) select term, count(*) as n from t group by term")
def term_frequency(spark: SparkSession, root: str) -> DataFrame:
    d = b.docs(spark, root)
    return d.select(F.explode(word_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@R.query(
    f"with {TOPICS_ONCE}, t as (select qid, unnest({tokens_sql('query')}) as term from topics_once), c as (select term, count(*) as n from t group by term) "
    "select qid, term from (select qid, term, row_number() over (partition by qid order by n desc, term) as rn from (select distinct qid, term from t) join c using (term)) where rn = 1"
)
def topic_category(spark: SparkSession, root: str) -> DataFrame:
    """Each topic's term that is the most frequent among all topics."""
    t = b.topics_once(spark, root).select("qid", F.explode(word_tokens(F.col("query"))).alias("term"))
    c = t.groupBy("term").agg(F.count("*").alias("n"))
    return latest(t.distinct().join(c, "term"), ["qid"], [F.col("n").desc(), F.col("term").asc()]).select("qid", "term")


@R.query(f"with {TOPICS_ONCE}, t as (select unnest({tokens_sql('query')}) as term from topics_once), c as (select term, count(*) as n from t group by term) select n as term_count, count(*) as terms from c group by n")
def count_histogram(spark: SparkSession, root: str) -> DataFrame:
    c = b.topics_once(spark, root).select(F.explode(word_tokens(F.col("query"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return c.groupBy(F.col("n").alias("term_count")).agg(F.count("*").alias("terms"))


@R.query(f"with {RUNS} select name, qid, docid, score from runs qualify row_number() over (partition by name, qid order by score desc, docid) = 1")
def argmax_per_group(spark: SparkSession, root: str) -> DataFrame:
    return top_k(b.runs(spark, root), ["name", "qid"], 1).select("name", "qid", "docid", "score")


@R.query(
    f"with {RUNS}, m as (select qid, docid, round(avg(score), 6) as score, count(*) as periods from runs group by all) select qid, docid, score, periods from m qualify row_number() over (partition by qid order by score desc, docid) = 1"
)
def period_terms_mean_clean(spark: SparkSession, root: str) -> DataFrame:
    """The mean score over lists in long form, and the best row of each query."""
    m = b.runs(spark, root).groupBy("qid", "docid").agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("periods"))
    return top_k(m, ["qid"], 1).select("qid", "docid", "score", "periods")


@R.query("select count(*) as n, count(*) - count(score) as null_scores, count(*) filter (isnan(score)) as nan_scores, count(*) - count(rank) as null_ranks, count(*) - count(distinct (name, trim(qid), docno)) as repeated from run_result")
def null_dup_counts(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "run_result")
    return r.agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count("score")).alias("null_scores"),
        F.count(F.when(F.isnan("score"), 1)).alias("nan_scores"),
        (F.count("*") - F.count("rank")).alias("null_ranks"),
        (F.count("*") - F.countDistinct(F.struct("name", F.trim("qid"), "docno"))).alias("repeated"),
    )


@R.query("select count(*) filter (answer is distinct from rtrim(lower(trim(answer)), '.')) as changed, count(*) filter (answer is not distinct from rtrim(lower(trim(answer)), '.')) as same from query_category")
def changed_values(spark: SparkSession, root: str) -> DataFrame:
    same = F.col("answer").eqNullSafe(F.rtrim(F.lower(F.trim("answer")), F.lit(".")))
    return table(spark, root, "query_category").agg(F.count(F.when(~same, 1)).alias("changed"), F.count(F.when(same, 1)).alias("same"))


@R.query("select relevance, count(*) as n from qrel group by relevance")
def value_table(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "qrel").groupBy("relevance").agg(F.count("*").alias("n"))


@R.query(f"with {RUNS} select name, qid, docid, score, cast(row_number() over (partition by name, qid order by score desc, docid) as int) as rank from runs")
def rank_one_based(spark: SparkSession, root: str) -> DataFrame:
    return ranked(b.runs(spark, root), ["name", "qid"]).select("name", "qid", "docid", "score", "rank")


@R.query(f"with {RUNS} select name, qid, docid, score, cast(row_number() over (partition by name, qid order by score desc, docid) - 1 as int) as rank from runs")
def rank_zero_based(spark: SparkSession, root: str) -> DataFrame:
    return ranked(b.runs(spark, root), ["name", "qid"], base=0).select("name", "qid", "docid", "score", "rank")


@R.query(f"with {RUNS} select name, qid, docid, cast(row_number() over (partition by name, qid order by score desc, docid) as int) as rank from runs qualify row_number() over (partition by name, qid order by score desc, docid) <= 1000")
def topk_per_query(spark: SparkSession, root: str) -> DataFrame:
    return top_k(b.runs(spark, root), ["name", "qid"], 1000).select("name", "qid", "docid", "rank")


@R.query(f"with {RUNS}, {QRELS_ANY} select name, count(*) as run_docs, count(q.docid) as judged from (select distinct name, qid, docid from runs) r left join qrels_any q using (qid, docid) group by name")
def set_overlap(spark: SparkSession, root: str) -> DataFrame:
    q = b.qrels_any(spark, root).select("qid", "docid", F.lit(1).alias("hit"))
    return b.runs(spark, root).join(q, ["qid", "docid"], "left").groupBy("name").agg(F.count("*").alias("run_docs"), F.count("hit").alias("judged"))


@R.query(
    f"with {TOPICS}, a as (select distinct qid from topics where sub_collection = '2022-10'), z as (select distinct qid from topics where sub_collection = '2023-03') select 'union' as part, count(*) as n from (select * from a union select * from z) "
    "union all select 'both', count(*) from (select * from a intersect select * from z) union all select 'first only', count(*) from (select * from a except select * from z)"
)
def set_operations(spark: SparkSession, root: str) -> DataFrame:
    t = b.topics(spark, root)
    a, z = (t.filter(F.col("sub_collection") == s).select("qid").distinct() for s in ("2022-10", "2023-03"))
    count = lambda d, n: d.agg(F.lit(n).alias("part"), F.count("*").alias("n"))
    return count(a.union(z).distinct(), "union").union(count(a.intersect(z), "both")).union(count(a.exceptAll(z), "first only"))


@R.query(f"with {TOPICS_ONCE} select qid, trim(translate(query, '''*/:?)(+', '')) as query from topics_once where qid not in ({_SPAM})")
def query_clean(spark: SparkSession, root: str) -> DataFrame:
    return b.topics_once(spark, root).filter(~F.col("qid").isin(*SPAM_QIDS)).select("qid", clean_query(F.col("query")).alias("query"))


@R.query(
    "select distinct docno, try_cast(regexp_replace(docno, '[^0-9]', '', 'g') as bigint) as bare, regexp_replace(docno, '^doc', '') as no_prefix, trim(docno, 'doc') as no_chars, substr(docno, 4) as sliced, "
    "'doc' || try_cast(regexp_replace(docno, '[^0-9]', '', 'g') as bigint) as prefixed from run_result"
)
def normalize_ids(spark: SparkSession, root: str) -> DataFrame:
    c = F.col("docno")
    bare = bare_docid(c)
    x = table(spark, root, "run_result").select("docno").distinct()
    return x.select("docno", bare.alias("bare"), strip_prefix(c).alias("no_prefix"), strip_chars(c).alias("no_chars"), F.substring("docno", 4, 1 << 20).alias("sliced"), add_prefix(bare).alias("prefixed"))


@R.query(f"select doc_id, len({tokens_sql('text')}) as n, {tokens_sql('text')}[1] as first, array_to_string({tokens_sql('text')}, ' ') as joined from documents")
def tokenize_words(spark: SparkSession, root: str) -> DataFrame:
    t = word_tokens(F.col("text"))
    d = table(spark, root, "documents")
    return d.select("doc_id", F.size(t).cast("bigint").alias("n"), F.try_element_at(t, F.lit(1)).alias("first"), F.array_join(t, " ").alias("joined"))


@R.query(f"with {TOPICS_ONCE} select qid, replace(replace(replace(strip_accents(nfc_normalize(query)), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss') as folded from topics_once")
def accent_fold(spark: SparkSession, root: str) -> DataFrame:
    return b.topics_once(spark, root).select("qid", fold_accents(F.col("query")).alias("folded"))


@R.query("select replace(lower(trim(source)), '-', '_') as source, count(*) as n, sum(length(text)) as chars, count(*) filter (n_chars is distinct from length(text)) as stale from documents group by 1")
def source_table(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    stale = F.count(F.when(~F.col("n_chars").eqNullSafe(F.length("text")), 1))
    return d.groupBy(source_name(F.col("source")).alias("source")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), stale.alias("stale"))


@R.query(f"with {TOPICS} select sub_collection, qid, count(*) over (partition by qid) as snapshots, cast(row_number() over (partition by qid order by sub_collection) as int) as nth from topics")
def topic_history(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("qid")
    return b.topics(spark, root).select("sub_collection", "qid", F.count("*").over(w).alias("snapshots"), F.row_number().over(w.orderBy("sub_collection")).alias("nth"))


@R.query("select event_id, user_id, cast(json_extract_string(props, '$.k') as int) as k from events where cast(json_extract_string(props, '$.k') as int) >= 50")
def json_path(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, root, "events").select("event_id", "user_id", k.alias("k")).filter("k >= 50")


@R.query(
    f"with {TOPICS_ONCE} select qid, lower(query) as lowered, replace(replace(query, 'l''', 'l '), 'd''', 'd ') as elided, regexp_replace(query, '[^\\p{{L}}\\p{{N}}_\\s]|\\p{{Nd}}', '', 'g') as bare, "
    "len(string_split(trim(query), ' ')) as parts, substr(query, 1, 8) as cut, 'q' || qid as named, replace(query, ' ', chr(10)) as lines, query like 'c%' as starts, query like '%s' as ends, "
    "regexp_full_match(query, '\\p{L}+') as letters, length(query) as chars, round(log10(length(query)), 6) as log_10, round(1 / (1 + ln(1 + length(query))), 6) as damped, lpad(qid, 8, '0') as padded from topics_once"
)
def scalar_functions(spark: SparkSession, root: str) -> DataFrame:
    q, n = F.col("query"), F.length("query").cast("double")
    return b.topics_once(spark, root).select(
        "qid",
        F.lower(q).alias("lowered"),
        split_elisions(q).alias("elided"),
        drop_punctuation(q, digits=True).alias("bare"),
        F.size(F.split(F.trim(q), " ")).alias("parts"),
        F.substring(q, 1, 8).alias("cut"),
        F.concat(F.lit("q"), "qid").alias("named"),
        F.replace(q, F.lit(" "), F.lit("\n")).alias("lines"),
        F.startswith(q, F.lit("c")).alias("starts"),
        F.endswith(q, F.lit("s")).alias("ends"),
        q.rlike("^\\p{L}+$").alias("letters"),
        F.length(q).alias("chars"),
        F.round(F.log10(n), 6).alias("log_10"),
        F.round(1 / (1 + F.log1p(n)), 6).alias("damped"),
        F.lpad("qid", 8, "0").alias("padded"),
    )


QUERIES, ORACLE = R.queries, R.oracle
