"""Vocabularies, training sets, clusters, models, annotation and export."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import CATEGORIES as CATEGORY_NAMES
from palimpsest.config import EXTRA_STOP_WORDS
from palimpsest.functions.stem import analyze, index_terms, stem_table
from palimpsest.functions.text import word_tokens
from palimpsest.operators import annotate, learn
from palimpsest.operators.evaluate import agreement, class_report
from palimpsest.operators.lineage import materialize, shared_folder
from palimpsest.operators.rank import ranked
from palimpsest.operators.similarity import cosine
from palimpsest.plans import base as b
from palimpsest.plans.base import DOCS, QRELS, RUNS, TOPICS, TOPICS_ONCE, Registry, tokens_sql
from palimpsest.sources.tables import table
from palimpsest.sources.trec import read_run, write_run

R = Registry()

#: Size of the vocabulary that documents are encoded with.
VOCABULARY = 10_000

_TERMS = f"{DOCS}, terms as (select docid, sub_collection, unnest({tokens_sql('text')}) as term from current_row)"
_VOCAB = f"{_TERMS}, vocab as (select term, count(*) as count, row_number() over (order by count(*) desc, term) - 1 as idx from terms group by term order by count(*) desc, term limit {VOCABULARY})"
_HOT = f"{_VOCAB}, hot as (select docid, sub_collection, string_agg(idx::varchar, ',' order by idx) as term_idx from (select distinct docid, sub_collection, term from terms) join vocab using (term) group by all)"


def _terms(spark: SparkSession, root: str) -> DataFrame:
    return b.docs(spark, root).select("docid", "sub_collection", F.explode(word_tokens(F.col("text"))).alias("term"))


@R.query(f"with {_VOCAB} select term, count from vocab")
def vocabulary_topn(spark: SparkSession, root: str) -> DataFrame:
    return learn.vocabulary(_terms(spark, root), VOCABULARY).select("term", "count")


@R.query(f"with {_VOCAB} select term, idx::int as index from vocab")
def term_index(spark: SparkSession, root: str) -> DataFrame:
    return learn.vocabulary(_terms(spark, root), VOCABULARY).select("term", "index")


def _hot(spark: SparkSession, root: str) -> DataFrame:
    t = _terms(spark, root)
    return learn.multi_hot(t, learn.vocabulary(t, VOCABULARY), ["docid", "sub_collection"])


@R.query(f"with {_HOT} select docid, sub_collection, term_idx from hot")
def multi_hot(spark: SparkSession, root: str) -> DataFrame:
    return _hot(spark, root).select("docid", "sub_collection", F.array_join("term_idx", ",").alias("term_idx"))


_LABELS = "select qid, (try_cast(qid as bigint) % 10)::int as cluster from topics_once"


def _clusters(spark: SparkSession, root: str) -> DataFrame:
    """A stand-in for a table of topic clusters: the last figure of the topic's id."""
    return b.topics_once(spark, root).select("qid", (F.col("qid").try_cast("bigint") % 10).cast("int").alias("cluster"))


@R.query(
    f"with {_HOT}, {QRELS}, {TOPICS_ONCE}, c as ({_LABELS}), a as (select qid, docid, sub_collection, cast(avg(label) as decimal(5, 2)) as relevance from qrels group by all) "
    "select distinct docid, sub_collection, term_idx, cluster, relevance from a join hot using (docid, sub_collection) join c using (qid)"
)
def training_set(spark: SparkSession, root: str) -> DataFrame:
    """Encoded judged pages with the cluster of the topic and the mean relevance; each combination once."""
    a = b.qrels(spark, root).groupBy("qid", "docid", "sub_collection").agg(F.avg("label").cast("decimal(5,2)").alias("relevance"))
    x = a.join(multi_hot(spark, root), ["docid", "sub_collection"]).join(_clusters(spark, root), "qid")
    return x.select("docid", "sub_collection", "term_idx", "cluster", "relevance").distinct()


@R.query(f"with {QRELS}, c as (select label, count(*) as n from qrels group by label) select label, n, round((select sum(n) from c) / ((select count(*) from c) * n) * case when label = 2 then 1.5 else 1.0 end::double, 6) as weight from c")
def class_weights(spark: SparkSession, root: str) -> DataFrame:
    return learn.class_weights(b.qrels(spark, root), "label", 2, 1.5)


@R.query(f"with {TOPICS_ONCE} select qid, query from topics_once order by md5(qid || '|42'), qid limit 100")
def seeded_sample(spark: SparkSession, root: str) -> DataFrame:
    return learn.seeded_sample(b.topics_once(spark, root), "qid", 100)


@R.query(
    f"with {QRELS}, k as (select *, qid || '|' || docid || '|' || sub_collection as key from qrels), r as (select *, row_number() over (partition by label order by md5(key || '|42'), key) as r, count(*) over (partition by label) as c from k) "
    "select label, case when r <= floor(c * 0.7::double) then 'train' when r <= floor(c * (0.7::double + 0.15::double)) then 'validation' else 'test' end as part, count(*) as n from r group by all"
)
def stratified_split(spark: SparkSession, root: str) -> DataFrame:
    q = b.qrels(spark, root).withColumn("key", F.concat_ws("|", "qid", "docid", "sub_collection"))
    return learn.stratified_split(q, "key", ["label"]).groupBy("label", "part").agg(F.count("*").alias("n"))


_PAIRS = (
    "k as (select trim(qid) as qid, rtrim(lower(trim(answer)), '.') as label from query_category where rtrim(lower(trim(answer)), '.') in ('time-independent', 'timeliness', 'event', 'explicit-time')), "
    "g as (select qid, min(label) as a1, max(label) as a2 from k group by qid)"
)


def _annotators(spark: SparkSession, root: str) -> DataFrame:
    """The first and the last known answer of each query in the alphabet, as two annotators."""
    k = table(spark, root, "query_category").select(F.trim("qid").alias("qid"), annotate.clean_category(F.col("answer")).alias("label")).dropna()
    return k.groupBy("qid").agg(F.min("label").alias("a1"), F.max("label").alias("a2"))


@R.query(
    f"with {_PAIRS}, n as (select count(*) as n, count(*) filter (a1 = a2) as same from g), l as (select label, sum(ca) as ca, sum(cb) as cb from (select a1 as label, 1 as ca, 0 as cb from g union all select a2, 0, 1 from g) group by label), "
    "p as (select sum(ca * cb)::double as ab, sum((ca + cb) * (ca + cb))::double as sq from l) select n, round(same / n, 6) as agreement, round((same / n - ab / (n * n)) / (1 - ab / (n * n)), 6) as kappa, "
    "round(1 - (2 * n - 1) * (2 * (n - same)) / (4 * n * n - sq), 6) as alpha from n, p"
)
def annotator_agreement(spark: SparkSession, root: str) -> DataFrame:
    return agreement(_annotators(spark, root))


@R.query(
    f"with {_PAIRS}, l as (select label, sum(t) as support, sum(p) as g, sum(h) as h from (select a1 as label, 1 as t, 0 as p, (a1 = a2)::int as h from g union all select a2, 0, 1, 0 from g) group by label), "
    "x as (select label, support, case when g > 0 then h / g else 0 end as p, case when support > 0 then h / support else 0 end as r from l) "
    "select label, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, support from x"
)
def annotator_report(spark: SparkSession, root: str) -> DataFrame:
    return class_report(_annotators(spark, root))


_RULE = f"case when regexp_matches(q, '{annotate.YEAR_PATTERN}') then 'explicit-time' when regexp_matches(q, '{annotate.EVENT_PATTERN}') then 'event' when regexp_matches(q, '{annotate.CURRENT_PATTERN.replace(chr(39), chr(39) * 2)}') then 'timeliness' else 'time-independent' end"


@R.query(f"with {TOPICS_ONCE} select qid, query, {_RULE} as answer from (select qid, query, lower(query) as q from topics_once)")
def rule_annotator(spark: SparkSession, root: str) -> DataFrame:
    return annotate.rule_annotator(b.topics_once(spark, root))


@R.query(f"with {TOPICS_ONCE} select ([{', '.join(repr(c) for c in CATEGORY_NAMES)}])[1 + floor(('0x' || substr(md5(qid || '|42'), 1, 8))::bigint / 4294967296.0 * {len(CATEGORY_NAMES)})::int] as answer, count(*) as n from topics_once group by 1")
def random_annotator(spark: SparkSession, root: str) -> DataFrame:
    return annotate.random_annotator(b.topics_once(spark, root), "qid").groupBy("answer").agg(F.count("*").alias("n"))


@R.query(f"with {TOPICS}, {_PAIRS.replace('g as', 'gg as')} select sub_collection, qid, query, a1 as answer from topics join gg using (qid) where sub_collection = '2023-03'")
def annotated_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The annotated queries of one snapshot."""
    t = b.topics(spark, root).filter("sub_collection = '2023-03'")
    return t.join(_annotators(spark, root), "qid").select("sub_collection", "qid", "query", F.col("a1").alias("answer"))


@R.query()
def stem_terms(spark: SparkSession, root: str) -> DataFrame:
    return stem_table(_terms(spark, root))


@R.query()
def bow_stems(spark: SparkSession, root: str) -> DataFrame:
    """Stems of all current rows by frequency."""
    d = b.docs(spark, root)
    return learn.vocabulary(analyze(d, ["docid", "sub_collection"], "text", "bow"), 10_000, "stem").select("term", "count", "index")


@R.query()
def train_stems(spark: SparkSession, root: str) -> DataFrame:
    """Stems of the judged pages as a training set encodes them: without the extra stop words."""
    q = b.qrels(spark, root).select("docid", "sub_collection").distinct()
    d = b.docs(spark, root).join(q, ["docid", "sub_collection"], "left_semi")
    return analyze(d, ["docid", "sub_collection"], "text", "bow", extended=False).groupBy("docid", "sub_collection").agg(F.countDistinct("stem").alias("stems"))


@R.query()
def predict_stems(spark: SparkSession, root: str) -> DataFrame:
    """Stems of the pages to rank, with the extra stop words left out."""
    d = b.docs(spark, root).filter("sub_collection = '2023-03'")
    return analyze(d, ["docid"], "text", "bow").groupBy("docid").agg(F.countDistinct("stem").alias("stems"))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(EXTRA_STOP_WORDS)) + "]"


@R.query(f"with {DOCS}, t as (select docid, list_filter({tokens_sql('text')}, lambda w: length(w) > 1 and not list_contains({_STOP}, w)) as t from current_row where sub_collection = '2023-03') select docid, len(t)::int as terms, len(list_distinct(t))::int as kinds from t")
def index_analyzer(spark: SparkSession, root: str) -> DataFrame:
    """Terms of each page as an index makes them."""
    t = index_terms(F.col("text"), sorted(EXTRA_STOP_WORDS))
    return b.docs(spark, root).filter("sub_collection = '2023-03'").select("docid", t.alias("t")).select("docid", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("kinds"))


@R.query()
def topic_stems(spark: SparkSession, root: str) -> DataFrame:
    x = analyze(b.topics_once(spark, root), ["qid"], "query", "topic").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("x"))
    return x.select("qid", F.array_join(F.transform("x", lambda s: s["stem"]), " ").alias("stems"))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return learn.vectors(table(spark, root, "embeddings"), "embedding")


@R.query()
def embedding_unchanged(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose vectors at two snapshots have a cosine of 0.9 or more; vectors are hashed TF-IDF."""
    d = b.docs(spark, root).filter("text is not null and sub_collection in ('2023-02', '2023-03')")
    v = learn.hashed_vectors(d.select("docid", "sub_collection", word_tokens(F.col("text")).alias("tokens"))).drop("tokens")
    side = lambda s, c: v.filter(F.col("sub_collection") == s).select("docid", F.col("embedding").alias(c))
    pairs = side("2023-02", "x").join(side("2023-03", "y"), "docid")
    return pairs.select("docid", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity")).filter("similarity >= 0.9")


@R.query()
def topic_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Topics clustered by hashed vectors of their stems."""
    t = analyze(b.topics_once(spark, root), ["qid"], "query", "topic").groupBy("qid").agg(F.array_sort(F.collect_list("stem")).alias("tokens"))
    return learn.kmeans(learn.vectors(learn.hashed_vectors(t, size=64), "embedding"), 10).select("qid", "cluster")


@R.query()
def kmeans_clusters(spark: SparkSession, root: str) -> DataFrame:
    return learn.kmeans(_vectors(spark, root), 10).select("vec_id", "cluster")


@R.query()
def silhouette_sweep(spark: SparkSession, root: str) -> DataFrame:
    t = learn.silhouettes(_vectors(spark, root), list(range(2, 100)))
    return t.withColumn("best", F.col("k") == learn.best_k(t)).withColumn("silhouette", F.round("silhouette", 6))


@R.query()
def pca_2d(spark: SparkSession, root: str) -> DataFrame:
    return learn.plane(_vectors(spark, root)).select("vec_id", F.round(F.abs("x"), 6).alias("abs_x"), F.round(F.abs("y"), 6).alias("abs_y"))


@R.query()
def cluster_model(spark: SparkSession, root: str) -> DataFrame:
    """The cluster head, trained on a split of the labelled vectors and measured on the rest."""
    v = learn.stratified_split(_vectors(spark, root), "vec_id", ["label"])
    m = learn.fit_cluster(v.filter("part = 'train'"), [64, 32, 10])
    return learn.classification_metrics(m.transform(v.filter("part = 'test'")))


def _relevance(spark: SparkSession, root: str) -> DataFrame:
    q = b.qrels(spark, root).join(b.docs(spark, root).filter("text is not null"), ["docid", "sub_collection"])
    x = q.select("docid", "sub_collection", "qid", (F.col("label") > 0).cast("int").alias("label"), word_tokens(F.col("text")).alias("tokens"))
    w = learn.class_weights(x, "label", 1, 1.5).select("label", "weight")
    x = x.join(w, "label").withColumn("key", F.concat_ws("|", "qid", "docid", "sub_collection"))
    x = materialize(learn.stratified_split(x, "key", ["label"]), "relevance")
    return CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=VOCABULARY, binary=True).fit(x).transform(x)


@R.query()
def relevance_model(spark: SparkSession, root: str) -> DataFrame:
    """The relevance head on multi-hot pages, class-weighted, measured on the held-out part."""
    x = _relevance(spark, root)
    m = learn.fit_relevance(x.filter("part = 'train'"))
    return learn.binary_metrics(m.transform(x.filter("part = 'test'")))


@R.query(
    f"with {RUNS}, {TOPICS_ONCE}, c as ({_LABELS}), x as (select name, r.qid, r.docid, score * case when c.cluster = e.label then 2 * round(1 / (1 + exp(-embedding[1]::double)), 6) else 1.0::double end as score "
    "from runs r left join embeddings e on e.vec_id = r.docid % (select count(*) from embeddings) left join c on c.qid = r.qid) "
    "select name, qid, docid, round(score, 6) as score, cast(row_number() over (partition by name, qid order by round(score, 6) desc, docid) as int) as rank from x"
)
def cluster_gated_rerank(spark: SparkSession, root: str) -> DataFrame:
    """Scores times twice the probability of relevance where a page's cluster is the topic's.

    The gate on predictions that SQL can state: a page takes the label and the first coordinate of one of all vectors of the table, whose vec_id counts from 0. Predictions of
    fitted models are gated the same way in ``model_gated_rerank``.
    """
    run, e = b.runs(spark, root), table(spark, root, "embeddings")
    p = e.select(F.col("vec_id").alias("_v"), F.col("label").alias("cluster"), F.round(1 / (1 + F.exp(-F.col("embedding")[0].cast("double"))), 6).alias("p_rel"))
    predictions = run.select("docid").distinct().join(p, F.col("docid") % e.count() == F.col("_v")).select("docid", "cluster", "p_rel")
    return _gated(run, predictions, _clusters(spark, root))


def _gated(run: DataFrame, predictions: DataFrame, clusters: DataFrame) -> DataFrame:
    x = learn.gate(run, predictions, clusters).withColumn("score", F.round("score", 6))
    return ranked(x, ["name", "qid"]).select("name", "qid", "docid", "score", "rank")


@R.query()
def model_gated_rerank(spark: SparkSession, root: str) -> DataFrame:
    """Runs re-ranked by two heads on one encoding of the pages: the cluster of the topics a page serves, and its relevance.

    Both heads learn from the judged pages of the snapshots up to 2023-02 and predict all pages of 2023-03; the clusters are those of ``topic_clusters``.
    """
    clusters = topic_clusters(spark, root)
    d = b.docs(spark, root).filter("text is not null").select("docid", "sub_collection", word_tokens(F.col("text")).alias("tokens"))
    q = b.qrels(spark, root).filter("sub_collection <= '2023-02'").join(clusters, "qid")
    train = d.join(q, ["docid", "sub_collection"]).select("tokens", F.col("cluster").cast("double").alias("cluster_label"), (F.col("label") > 0).cast("double").alias("label"))
    train = materialize(train, "judged-pages")
    encoder = learn.count_vectors(train, size=VOCABULARY)
    x = encoder.transform(train)
    heads = learn.fit_heads(x, "cluster_label", "label")
    predictions = learn.predict_heads(encoder.transform(d.filter("sub_collection = '2023-03'")), *heads).select("docid", "cluster", "p_rel")
    return _gated(b.runs(spark, root), predictions, clusters)


@R.query(f"with {RUNS} select name, qid, 'doc' || docid as docno, round(score, 4) as score, cast(row_number() over (partition by name, qid order by score desc, docid) as int) as rank from runs qualify row_number() over (partition by name, qid order by score desc, docid) <= 1000")
def export_run_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Writes the runs as run files and reads them again."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    run = ranked(b.runs(spark, root), ["name", "qid"]).filter("rank <= 1000").withColumn("score", F.round("score", 4))
    write_run(run, path, prefix="doc")
    return read_run(spark, path).select("name", "qid", "docno", "score", "rank")


@R.query("select a as category from (values " + ", ".join(f"('{c}')" for c in CATEGORY_NAMES) + ") t(a)")
def category_names(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CATEGORY_NAMES], "category string")


QUERIES, ORACLE = R.queries, R.oracle
