"""Retrieval, similarity, re-ranking, grids and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import CATEGORY_FACTORS, EXTRA_STOP_WORDS, SIMILARITY_FACTORS, Recency
from palimpsest.functions.text import clean_query
from palimpsest.operators import evaluate as ev
from palimpsest.operators.index import Index, build_index
from palimpsest.operators.rank import boost_pairs, factor_map, grid, ranked, recency_score, similarity_factor, with_configs
from palimpsest.operators.retrieve import bm25 as bm25_run
from palimpsest.operators.retrieve import expand, expansion_terms, inverse_frequencies, term_frequencies, tfidf, top_terms
from palimpsest.operators.similarity import cosine, similarity_bucket, text_similarity
from palimpsest.plans import base as b
from palimpsest.plans.base import CATEGORIES, DOCS, QRELS, QRELS_ANY, RUNS, TOPICS, TOPICS_ONCE, Registry, tokens_sql
from palimpsest.plans.relational import _DATES, _dates
from palimpsest.sources.tables import table

R = Registry()

INDEX = f"""
{DOCS},
tok as (select sub_collection, docid, unnest({tokens_sql('text')}) as term from current_row),
post as (select sub_collection, docid, term, count(*) as tf from tok group by all),
dl as (select c.sub_collection, c.docid, coalesce(s.dl, 0) as dl from current_row c left join (select sub_collection, docid, sum(tf) as dl from post group by all) s using (sub_collection, docid)),
stats as (select sub_collection, count(*) as n, avg(dl) as avdl from dl group by 1),
lex as (select sub_collection, term, count(*) as df, sum(tf) as cf from post group by all)"""


def bm25_sql(topics: str, name: str, depth: int = 1000) -> str:
    """CTEs that end in ``name`` (sub_collection, qid, docid, score, rank); ``topics`` has sub_collection, qid, query."""
    return f"""
{name}_q as (select sub_collection, qid, term, count(*) as qtf from (select sub_collection, qid, unnest({tokens_sql('query')}) as term from {topics}) group by all),
{name} as (
  select sub_collection, qid, docid, score, row_number() over (partition by sub_collection, qid order by score desc, docid) as rank from (
    select p.sub_collection, q.qid, p.docid, round(sum(
      log2((s.n - l.df + 0.5) / (l.df + 0.5)) * 9 * q.qtf / (8 + q.qtf) * (2.2 * p.tf / (1.2 * (0.25 + 0.75 * d.dl / s.avdl) + p.tf))), 6) as score
    from {name}_q q join post p using (sub_collection, term) join lex l using (sub_collection, term) join dl d on d.sub_collection = p.sub_collection and d.docid = p.docid
    join stats s on s.sub_collection = p.sub_collection group by all
  ) qualify row_number() over (partition by sub_collection, qid order by score desc, docid) <= {depth}
)"""


def _index(spark: SparkSession, root: str) -> Index:
    return build_index(b.docs(spark, root), ["sub_collection"])


@R.query(f"with {INDEX}, {TOPICS}, {bm25_sql('topics', 'r')} select sub_collection, qid, docid, score, cast(rank as int) as rank from r")
def bm25(spark: SparkSession, root: str) -> DataFrame:
    """Each topic against the pages of its own snapshot."""
    return bm25_run(b.topics(spark, root).select("sub_collection", "qid", "query"), _index(spark, root))


@R.query(f"with {INDEX} select sub_collection, docid, dl from dl")
def document_lengths(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).docs


@R.query(f"with {INDEX} select sub_collection, n, round(avdl, 6) as avdl from stats")
def collection_stats(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).stats.select("sub_collection", "n", F.round("avdl", 6).alias("avdl"))


@R.query(f"with {INDEX} select sub_collection, term, df, cf from lex")
def lexicon(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).lexicon


@R.query(f"with {INDEX} select sub_collection, docid, term, round(tf / dl, 6) as tf from post join dl using (sub_collection, docid)")
def tf(spark: SparkSession, root: str) -> DataFrame:
    return term_frequencies(_index(spark, root)).select("sub_collection", "docid", "term", F.round("tf", 6).alias("tf"))


@R.query(f"with {INDEX} select sub_collection, term, df, round(log10(n / (1 + df)), 6) as idf from lex join stats using (sub_collection)")
def idf(spark: SparkSession, root: str) -> DataFrame:
    return inverse_frequencies(_index(spark, root)).select("sub_collection", "term", "df", F.round("idf", 6).alias("idf"))


_TFIDF = (
    "w as (select p.sub_collection, p.docid, p.term, round((p.tf / d.dl) * log10(s.n / (1 + l.df)), 6) as tfidf from post p join dl d using (sub_collection, docid) join lex l using (sub_collection, term) "
    "join stats s using (sub_collection) where regexp_full_match(p.term, '\\p{L}+') and length(p.term) >= 5), "
    "top as (select sub_collection, docid, term, tfidf from w qualify row_number() over (partition by sub_collection, docid order by tfidf desc, term) = 1)"
)


@R.query(f"with {INDEX}, {_TFIDF} select sub_collection, docid, term, tfidf from top")
def tfidf_top_term(spark: SparkSession, root: str) -> DataFrame:
    return top_terms(tfidf(_index(spark, root)), ["sub_collection", "docid"], 1).select("sub_collection", "docid", "term", "tfidf")


_STOP = ", ".join(f"'{w}'" for w in sorted(EXTRA_STOP_WORDS))


@R.query(f"with {INDEX}, {_TFIDF} select sub_collection, docid, count(*) as candidates, max(tfidf) as best from w where term not in ({_STOP}) group by all")
def candidate_terms(spark: SparkSession, root: str) -> DataFrame:
    """Candidate terms of each page: letters only, five or more, no stop word."""
    w = tfidf(_index(spark, root), stop=sorted(EXTRA_STOP_WORDS))
    return w.groupBy("sub_collection", "docid").agg(F.count("*").alias("candidates"), F.max("tfidf").alias("best"))


_EXPANSION = (
    f"{QRELS}, {TOPICS_ONCE}, e as (select sub_collection, qid, term, max(tfidf) as score from (select distinct sub_collection, qid, docid from qrels where label > 0 and sub_collection <= '2023-02') join top using (sub_collection, docid) group by all), "
    "m as (select qid, term, round(avg(score), 6) as score from e group by all), "
    "x as (select qid, string_agg(term, ' ' order by score desc, term) as added from (select * from m qualify row_number() over (partition by qid order by score desc, term) <= 9) group by qid), "
    "expanded as (select qid, case when added is null then query else query || ' ' || added end as query from (select qid, trim(translate(query, '''*/:?)(+', '')) as query from topics_once) left join x using (qid))"
)


def _expanded(spark: SparkSession, root: str, index: Index) -> DataFrame:
    judged = b.qrels(spark, root).filter("label > 0 and sub_collection <= '2023-02'").select("sub_collection", "qid", "docid")
    t = b.topics_once(spark, root).select("qid", clean_query(F.col("query")).alias("query"))
    return expand(t, expansion_terms(judged, tfidf(index), "sub_collection"))


@R.query(f"with {INDEX}, {_TFIDF}, {_EXPANSION} select qid, query from expanded")
def expand_queries(spark: SparkSession, root: str) -> DataFrame:
    """Topics with the terms of relevant pages of the snapshots up to 2023-02."""
    return _expanded(spark, root, _index(spark, root))


@R.query(f"with {INDEX}, {_TFIDF}, {_EXPANSION}, t as (select '2023-03' as sub_collection, qid, query from expanded), {bm25_sql('t', 'r')} select qid, docid, score, cast(rank as int) as rank from r")
def bm25_expanded(spark: SparkSession, root: str) -> DataFrame:
    """The expanded topics against the pages of 2023-03."""
    index = _index(spark, root)
    t = _expanded(spark, root, index).select(F.lit("2023-03").alias("sub_collection"), "qid", "query")
    return bm25_run(t, index).select("qid", "docid", "score", "rank")


_SIM = (
    f"{DOCS}, pair as (select a.docid, list_distinct({tokens_sql('a.text')}) as x, list_distinct({tokens_sql('b.text')}) as y from current_row a join current_row b on a.docid = b.docid "
    "where a.sub_collection = '2023-02' and b.sub_collection = '2023-03' and a.text is not null and b.text is not null), "
    "sim as (select docid, case when len(x) + len(y) = 0 then 0.0 else round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) end as similarity from pair)"
)


@R.query(f"with {_SIM} select docid, similarity from sim where similarity >= 0.9")
def jaccard_unchanged(spark: SparkSession, root: str) -> DataFrame:
    return text_similarity(b.docs(spark, root), "2023-02", "2023-03").filter("similarity >= 0.9")


_BUCKET = "case when similarity >= 1 then '100%' when similarity >= 0.95 then '95-99%' when similarity >= 0.9 then '90-94%' when similarity >= 0.85 then '85-89%' when similarity >= 0.8 then '80-84%' end"


@R.query(f"with {_SIM} select docid, {_BUCKET} as bucket from sim where similarity >= 0.8")
def similarity_buckets(spark: SparkSession, root: str) -> DataFrame:
    s = text_similarity(b.docs(spark, root), "2023-02", "2023-03").filter("similarity >= 0.8")
    return s.select("docid", similarity_bucket(F.col("similarity")).alias("bucket"))


@R.query("select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Each vector with the one of the next id, as a document's vectors at two snapshots."""
    e = table(spark, root, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


_KNOWN = "known as (select distinct qid, docid from qrels where label > 0 and sub_collection <= '2023-02')"


def _known(spark: SparkSession, root: str) -> DataFrame:
    return b.qrels(spark, root).filter("label > 0 and sub_collection <= '2023-02'").select("qid", "docid").distinct()


@R.query(
    f"with {_SIM}, {QRELS}, {_KNOWN}, {RUNS}, x as (select name, qid, docid, score * case when k.docid is not null then 2.0 else 1.0 end as score from runs left join (select known.* from known join sim using (docid) where similarity >= 0.9) k using (qid, docid)) "
    "select name, qid, docid, round(score, 6) as score, cast(row_number() over (partition by name, qid order by score desc, docid) as int) as rank from x"
)
def boost_known_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Doubles the score of pairs known as relevant whose page has kept its text."""
    same = text_similarity(b.docs(spark, root), "2023-02", "2023-03").filter("similarity >= 0.9").select("docid")
    pairs = _known(spark, root).join(same, "docid", "left_semi")
    out = ranked(boost_pairs(b.runs(spark, root), pairs, ["qid", "docid"], 2.0), ["name", "qid"])
    return out.select("name", "qid", "docid", F.round("score", 6).alias("score"), "rank")


@R.query(
    f"with {_SIM}, {QRELS}, {_KNOWN}, {RUNS}, f as (select known.qid, known.docid, case when similarity >= 1 then 2.0 when similarity >= 0.95 then 1.75 when similarity >= 0.9 then 1.5 when similarity >= 0.8 then 1.25 else 1.0 end as factor from known join sim using (docid)), "
    "x as (select name, qid, docid, cast(score as double) * coalesce(factor, 1.0)::double as score from runs left join f using (qid, docid)) select name, qid, docid, round(score, 6) as score, cast(row_number() over (partition by name, qid order by score desc, docid) as int) as rank from x"
)
def boost_buckets(spark: SparkSession, root: str) -> DataFrame:
    s = text_similarity(b.docs(spark, root), "2023-02", "2023-03")
    pairs = _known(spark, root).join(s, "docid").withColumn("factor", similarity_factor(F.col("similarity"), SIMILARITY_FACTORS))
    out = ranked(boost_pairs(b.runs(spark, root), pairs, ["qid", "docid"], F.col("factor")), ["name", "qid"])
    return out.select("name", "qid", "docid", F.round("score", 6).alias("score"), "rank")


_RARE = f"{_DATES}, rare as (select docid from dates where docid is not null and day is not null group by docid having count(distinct day) <= 3)"


@R.query(
    f"with {RUNS}, {CATEGORIES}, {_RARE}, x as (select name, qid, docid, score * case when r.docid is not null and coalesce(category, '') <> 'time-independent' then 1.03 else 1.0 end as score from runs left join categories using (qid) left join rare r using (docid)) "
    "select name, qid, docid, round(score, 6) as score, cast(row_number() over (partition by name, qid order by score desc, docid) - 1 as int) as rank from x"
)
def boost_rare_docs(spark: SparkSession, root: str) -> DataFrame:
    """Raises pages of few crawl dates for queries of all categories but one; ranks from 0."""
    rare = _dates(spark, root).filter("n_dates <= 3").select("docid", F.lit(1).alias("rare"))
    x = b.runs(spark, root).join(b.categories(spark, root), "qid", "left").join(rare, "docid", "left")
    hit = F.col("rare").isNotNull() & (F.coalesce("category", F.lit("")) != "time-independent")
    out = ranked(x.withColumn("score", F.col("score") * F.when(hit, 1.03).otherwise(1.0)), ["name", "qid"], base=0)
    return out.select("name", "qid", "docid", F.round("score", 6).alias("score"), "rank")


_FACTOR = "case category when 'time-independent' then 1.2 when 'timeliness' then 1.15 when 'event' then 1.15 when 'explicit-time' then 1.2 else 1.0 end::double"


@R.query(
    f"with {RUNS}, {CATEGORIES}, {_RARE}, x as (select name, qid, docid, score * case when r.docid is not null then {_FACTOR} else 1.0::double end as score from runs left join categories using (qid) left join rare r using (docid)) "
    "select name, qid, docid, round(score, 6) as score, cast(row_number() over (partition by name, qid order by score desc, docid) as int) as rank from x"
)
def boost_by_category(spark: SparkSession, root: str) -> DataFrame:
    rare = _dates(spark, root).filter("n_dates <= 3").select("docid", F.lit(1).alias("rare"))
    x = b.runs(spark, root).join(b.categories(spark, root), "qid", "left").join(rare, "docid", "left")
    f = F.when(F.col("rare").isNotNull(), factor_map(F.col("category"), CATEGORY_FACTORS)).otherwise(1.0)
    out = ranked(x.withColumn("score", F.col("score") * f), ["name", "qid"])
    return out.select("name", "qid", "docid", F.round("score", 6).alias("score"), "rank")


_TAGS = "tags as (select qid, case category when 'timeliness' then 1.0 when 'event' then 0.7 when 'explicit-time' then 0.5 else 0.0 end::double as tag from categories)"
#: A time-dependence score for each category, where no score per query is at hand.
TAG_OF = {"timeliness": 1.0, "event": 0.7, "explicit-time": 0.5, "time-independent": 0.0}


def _tagged(spark: SparkSession, root: str) -> DataFrame:
    tags = b.categories(spark, root).select("qid", factor_map(F.col("category"), TAG_OF).alias("tag"))
    n = b.docs(spark, root).groupBy("docid").agg(F.count("*").alias("occurrences"))
    return b.runs(spark, root).join(tags, "qid", "left").join(n, "docid", "left")


@R.query(
    f"with {DOCS}, {RUNS}, {CATEGORIES}, {_TAGS}, o as (select docid, count(*) as occurrences from current_row group by docid), "
    "x as (select name, qid, docid, round(score + 1.0 * coalesce(tag, 0) / (1 + ln(1 + least(coalesce(occurrences, 1), 15))), 6) as score from runs left join tags using (qid) left join o using (docid)) "
    "select name, qid, docid, score, cast(row_number() over (partition by name, qid order by score desc, docid) as int) as rank from x"
)
def clip_log_recency(spark: SparkSession, root: str) -> DataFrame:
    p = Recency()
    s = F.round(recency_score(F.col("score"), F.col("tag"), F.col("occurrences"), p.weight, p.clip), 6)
    return ranked(_tagged(spark, root).withColumn("score", s), ["name", "qid"]).select("name", "qid", "docid", "score", "rank")


def metric_sql(run: str, keys: str, k: int = 10, recall_k: int = 100) -> str:
    """CTEs ideal, pq, jr, qm: metrics per system and query; ``run`` has the key columns, qid, docid, score; needs qrels_any."""
    return f"""
ideal as (select qid, label, greatest(label, 0) / log2(1 + row_number() over (partition by qid order by label desc, docid)) as g, row_number() over (partition by qid order by label desc, docid) as i from qrels_any),
pq as (select qid, count(*) filter (label > 0) as r, count(*) filter (label <= 0) as nr, sum(g) as idcg, sum(g) filter (i <= {k}) as idcg_k from ideal group by qid having count(*) filter (label > 0) > 0),
jr as (
  select {keys}, t.qid, label, row_number() over w as i, (coalesce(label, 0) > 0)::int as rel,
         sum((coalesce(label, 0) > 0)::int) over (w rows between unbounded preceding and current row) as rels,
         sum(coalesce((label <= 0)::int, 0)) over (w rows between unbounded preceding and current row) as nonrels
  from {run} t left join qrels_any q on q.qid = t.qid and q.docid = t.docid window w as (partition by {keys}, t.qid order by score desc, t.docid desc)
),
qm as (
  select {keys}, qid,
    round(coalesce(sum(rel) filter (i <= {k}), 0) / {k}, 6) as p_k,
    round(coalesce(sum(rel) filter (i <= {recall_k}), 0) / max(r), 6) as recall_k,
    round(coalesce(sum(rels / i) filter (rel = 1), 0) / max(r), 6) as ap,
    round(coalesce(sum(greatest(coalesce(label, 0), 0) / log2(i + 1)), 0) / max(idcg), 6) as ndcg,
    round(coalesce(sum(greatest(coalesce(label, 0), 0) / log2(i + 1)) filter (i <= {k}), 0) / max(idcg_k), 6) as ndcg_k,
    round(coalesce(sum(case when nonrels = 0 or least(r, nr) = 0 then 1.0::double else 1 - least(nonrels, r) / least(r, nr) end) filter (rel = 1), 0) / max(r), 6) as bpref
  from jr join pq using (qid) group by all
)"""


_MEANS = "count(*) as queries, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in ev.METRICS)


def _per_query(spark: SparkSession, root: str) -> DataFrame:
    return ev.query_metrics(b.runs(spark, root), b.qrels_any(spark, root), ["name"])


@R.query(f"with {RUNS}, {QRELS_ANY}, {metric_sql('runs', 'name')} select name, qid, p_k as p_10, recall_k as recall_100 from qm")
def precision_recall_at_k(spark: SparkSession, root: str) -> DataFrame:
    return _per_query(spark, root).select("name", "qid", F.col("p_k").alias("p_10"), F.col("recall_k").alias("recall_100"))


@R.query(f"with {RUNS}, {QRELS_ANY}, {metric_sql('runs', 'name')} select name, qid, ap from qm")
def average_precision(spark: SparkSession, root: str) -> DataFrame:
    return _per_query(spark, root).select("name", "qid", "ap")


@R.query(f"with {RUNS}, {QRELS_ANY}, {metric_sql('runs', 'name')} select name, qid, ndcg, ndcg_k as ndcg_cut_10 from qm")
def ndcg(spark: SparkSession, root: str) -> DataFrame:
    return _per_query(spark, root).select("name", "qid", "ndcg", F.col("ndcg_k").alias("ndcg_cut_10"))


@R.query(f"with {RUNS}, {QRELS_ANY}, {metric_sql('runs', 'name')} select name, qid, bpref from qm")
def bpref(spark: SparkSession, root: str) -> DataFrame:
    return _per_query(spark, root).select("name", "qid", "bpref")


@R.query(f"with {RUNS}, {QRELS_ANY}, {metric_sql('runs', 'name')} select name, {_MEANS} from qm group by name")
def experiment_table(spark: SparkSession, root: str) -> DataFrame:
    return ev.experiment(b.runs(spark, root), b.qrels_any(spark, root), ["name"])


@R.query(f"with {INDEX}, {TOPICS}, {QRELS}, qrels_any as (select qid, docid, max(label) as label from qrels group by all), {bm25_sql('topics', 'r')}, b as (select sub_collection as name, qid, docid, score from r), {metric_sql('b', 'name')} select name, {_MEANS} from qm group by name")
def bm25_by_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """BM25 measured on each snapshot: how stable retrieval is over time."""
    r = bm25(spark, root).select(F.col("sub_collection").alias("name"), "qid", "docid", "score")
    return ev.experiment(r, b.qrels_any(spark, root), ["name"])


def _sweep(run: DataFrame, configs: DataFrame, score: F.Column, qrels: DataFrame) -> DataFrame:
    """Metrics of every configuration in one job: rows get their labels first and are multiplied last."""
    axes = configs.columns
    rows = with_configs(ev.labelled(run, qrels), configs).select(*axes, "name", "qid", "docid", "label", F.round(score, 6).alias("score"))
    return ev.experiment(rows, qrels, [*axes, "name"])


def _rare(spark: SparkSession, root: str) -> DataFrame:
    return _dates(spark, root).filter("n_dates <= 3").select("docid", F.lit(1).alias("rare"))


@R.query(
    f"with {RUNS}, {QRELS_ANY}, {_RARE}, g as (select i::int as config, round(1 + 0.01 * i, 2)::double as boost from range(110) t(i)), "
    "x as (select config, boost, name, qid, docid, round(score * case when r.docid is not null then boost else 1.0 end, 6) as score from runs left join rare r using (docid), g), "
    f"{metric_sql('x', 'config, boost, name')} select config, boost, name, {_MEANS} from qm group by all"
)
def boost_sweep(spark: SparkSession, root: str) -> DataFrame:
    """110 factors from 1.00 to 2.09 for pages of few crawl dates."""
    g = grid(spark, boost=[round(1 + 0.01 * i, 2) for i in range(110)])
    run = b.runs(spark, root).join(_rare(spark, root), "docid", "left")
    return _sweep(run, g, F.col("score") * F.when(F.col("rare").isNotNull(), F.col("boost")).otherwise(1.0), b.qrels_any(spark, root))


#: Axis of each category in the grid, and the values of every axis.
_AXES = {"time-independent": "w_independent", "timeliness": "w_timeliness", "event": "w_event", "explicit-time": "w_explicit"}
_FACTORS = [1.0, 1.05, 1.1, 1.15, 1.2]
_PARTS = ", ".join(f"sum({m}::decimal(12, 6)) as {m}" for m in ev.METRICS)
_OF_PARTS = "sum(n)::bigint as queries, " + ", ".join(f"round(sum({m})::double / sum(n), 6) as {m}" for m in ev.METRICS)


@R.query(
    f"with {RUNS}, {QRELS_ANY}, {CATEGORIES}, {_RARE}, s as (select unnest([{', '.join(map(str, _FACTORS))}]::double[]) as v), "
    f"g as (select (row_number() over (order by a.v, b.v, c.v, d.v) - 1)::int as config, a.v as w_independent, b.v as w_timeliness, c.v as w_event, d.v as w_explicit from s a, s b, s c, s d), "
    "x as (select coalesce(category, '') as category, v, name, qid, docid, round(score * case when r.docid is not null then v else 1.0 end, 6) as score from runs left join categories using (qid) left join rare r using (docid) join s on category is not null or v = 1.0), "
    f"{metric_sql('x', 'category, v, name')}, part as (select category, v, name, count(*) as n, {_PARTS} from qm group by all), "
    "e as (select *, '' as category, 1.0::double as v from g " + " ".join(f"union all select *, '{c}', {a} from g" for c, a in _AXES.items()) + ") "
    f"select config, w_independent, w_timeliness, w_event, w_explicit, name, {_OF_PARTS} from e join part using (category, v) group by config, w_independent, w_timeliness, w_event, w_explicit, name"
)
def category_grid(spark: SparkSession, root: str) -> DataFrame:
    """625 configurations: a factor from 1.00 to 1.20 for each category, on pages of few crawl dates.

    A query has one category, so only one axis concerns it: its metrics are computed once per value of that axis (five times, not 625), summed up by
    category and value, and each configuration adds up its four sums and that of the queries without a category. Sums are exact decimals.
    """
    run = b.runs(spark, root).join(b.categories(spark, root), "qid", "left").join(_rare(spark, root), "docid", "left").withColumn("category", F.coalesce("category", F.lit("")))
    qrels = b.qrels_any(spark, root)
    values = F.when(F.col("category") == "", F.array(F.lit(1.0))).otherwise(F.array(*map(F.lit, _FACTORS)))
    rows = ev.labelled(run, qrels).withColumn("v", F.explode(values))
    rows = rows.withColumn("score", F.round(F.col("score") * F.when(F.col("rare").isNotNull(), F.col("v")).otherwise(1.0), 6))
    q = ev.query_metrics(rows.select("category", "v", "name", "qid", "docid", "label", "score"), qrels, ["category", "v", "name"])
    parts = q.groupBy("category", "v", "name").agg(F.count("*").alias("n"), *(F.sum(F.col(m).cast("decimal(12,6)")).alias(m) for m in ev.METRICS))
    g = grid(spark, **{a: _FACTORS for a in _AXES.values()})
    own = F.array(F.struct(F.lit("").alias("category"), F.lit(1.0).alias("v")), *(F.struct(F.lit(c).alias("category"), F.col(a).alias("v")) for c, a in _AXES.items()))
    x = g.select("*", F.inline(own)).join(parts, ["category", "v"])
    means = (F.round(F.sum(m).cast("double") / F.sum("n"), 6).alias(m) for m in ev.METRICS)
    return x.groupBy("config", *_AXES.values(), "name").agg(F.sum("n").alias("queries"), *means)


#: Values of the three weights.
_WEIGHT_VALUES = [1e3, 3e3, 1e4, 1e8]
_WEIGHTS = (
    f"with {DOCS}, {RUNS}, {QRELS_ANY}, {CATEGORIES}, {_TAGS}, o as (select docid, count(*) as occurrences from current_row group by docid), s as (select unnest({_WEIGHT_VALUES}::double[]) as v), "
    "g as (select (row_number() over (order by a.v, b.v, c.v) - 1)::int as config, a.v as w_score, b.v as w_count, c.v as w_tag from s a, s b, s c), "
    "x as (select config, w_score, w_count, w_tag, name, qid, docid, round(w_score * score + w_count * coalesce(occurrences, 1) + w_tag * coalesce(tag, 0), 6) as score from runs left join tags using (qid) left join o using (docid), g), "
    f"{metric_sql('x', 'config, w_score, w_count, w_tag, name')}, t as (select config, w_score, w_count, w_tag, name, {_MEANS} from qm group by all) "
)


@R.query(_WEIGHTS + "select * from t")
def weight_grid(spark: SparkSession, root: str) -> DataFrame:
    """64 configurations of the weights of score, occurrences and tag."""
    g = grid(spark, w_score=_WEIGHT_VALUES, w_count=_WEIGHT_VALUES, w_tag=_WEIGHT_VALUES)
    s = F.col("w_score") * F.col("score") + F.col("w_count") * F.coalesce("occurrences", F.lit(1)) + F.col("w_tag") * F.coalesce("tag", F.lit(0.0))
    return _sweep(_tagged(spark, root), g, s, b.qrels_any(spark, root))


@R.query(_WEIGHTS + "select config, name, ap from t order by ap desc, config, name limit 1")
def best_configuration(spark: SparkSession, root: str) -> DataFrame:
    """The best of the 64 configurations of weight_grid."""
    return ev.best(weight_grid(spark, root), "ap", ["config", "name"]).select("config", "name", "ap")


QUERIES, ORACLE = R.queries, R.oracle
