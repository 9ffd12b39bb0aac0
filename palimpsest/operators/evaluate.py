"""Retrieval metrics as trec_eval defines them, and agreement of annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def labelled(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The rows of a run with their label, null where there is none; queries without a relevant document fall out."""
    relevant = qrels.filter("label > 0").select("qid").distinct()
    return run.join(relevant, "qid", "left_semi").join(qrels.select("qid", "docid", "label"), ["qid", "docid"], "left")


def judged_run(run: DataFrame, qrels: DataFrame, system: list[str], ideal_cut: int = 10) -> DataFrame:
    """Each row of the run with its label and the running sums that metrics need.

    The order is score descending, docid descending; the run's rank is ignored. Queries without a relevant document fall out.
    One window per (system, qid) serves all metrics. A run that has its labels already (column ``label``, see ``labelled``) is not joined again:
    a sweep labels its rows once, before configurations multiply them.
    """
    ideal = Window.partitionBy("qid").orderBy(F.col("label").desc(), F.col("docid").asc())
    gain = F.greatest(F.col("label"), F.lit(0)) / F.log2(F.col("_i") + 1)
    per_query = (
        qrels.withColumn("_i", F.row_number().over(ideal))
        .groupBy("qid")
        .agg(
            F.sum((F.col("label") > 0).cast("int")).alias("R"),
            F.sum((F.col("label") <= 0).cast("int")).alias("NR"),
            F.sum(gain).alias("idcg"),
            F.sum(F.when(F.col("_i") <= ideal_cut, gain)).alias("idcg_cut"),
        )
        .filter("R > 0")
    )
    w = Window.partitionBy(*system, "qid").orderBy(F.col("score").desc(), F.col("docid").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = run if "label" in run.columns else labelled(run, qrels)
    x = joined.withColumn("i", F.row_number().over(w))
    x = x.withColumn("rel", (F.coalesce("label", F.lit(0)) > 0).cast("int"))
    x = x.withColumn("rels", F.sum("rel").over(upto)).withColumn("nonrels", F.sum(F.coalesce((F.col("label") <= 0).cast("int"), F.lit(0))).over(upto))
    return x.join(per_query, "qid")


def query_metrics(run: DataFrame, qrels: DataFrame, system: list[str], k: int = 10, recall_k: int = 100) -> DataFrame:
    """system, qid, p_k, recall_k, ap, ndcg, ndcg_k, bpref of each query of the run that has a relevant document; rounded to 6 places."""
    x = judged_run(run, qrels, system, k)
    gain = F.greatest(F.coalesce("label", F.lit(0)), F.lit(0)) / F.log2(F.col("i") + 1)
    bound = F.least("R", "NR")
    bpref = F.when(F.col("rel") == 1, F.when((F.col("nonrels") == 0) | (bound == 0), 1.0).otherwise(1 - F.least("nonrels", "R") / bound))
    r6 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    first = lambda c: F.max(c)
    return x.groupBy(*system, "qid").agg(
        r6(F.sum(F.when(F.col("i") <= k, F.col("rel"))) / k).alias("p_k"),
        r6(F.sum(F.when(F.col("i") <= recall_k, F.col("rel"))) / first("R")).alias("recall_k"),
        r6(F.sum(F.when(F.col("rel") == 1, F.col("rels") / F.col("i"))) / first("R")).alias("ap"),
        r6(F.sum(gain) / first("idcg")).alias("ndcg"),
        r6(F.sum(F.when(F.col("i") <= k, gain)) / first("idcg_cut")).alias("ndcg_k"),
        r6(F.sum(bpref) / first("R")).alias("bpref"),
    )


METRICS = ("p_k", "recall_k", "ap", "ndcg", "ndcg_k", "bpref")


def experiment(run: DataFrame, qrels: DataFrame, system: list[str], k: int = 10, recall_k: int = 100) -> DataFrame:
    """Means over queries per system, with the number of queries."""
    q = query_metrics(run, qrels, system, k, recall_k)
    return q.groupBy(*system).agg(F.count("*").alias("queries"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def best(table: DataFrame, metric: str, tie: list[str]) -> DataFrame:
    """The row of the highest metric, ties to the smaller key."""
    return table.orderBy(F.col(metric).desc(), *(F.col(t).asc() for t in tie)).limit(1)


def agreement(pairs: DataFrame, a: str = "a1", b: str = "a2") -> DataFrame:
    """n, agreement, kappa (Cohen), alpha (Krippendorff, nominal) of two annotators from their confusion matrix.

    Rows with a null label fall out. Where expected agreement is 1, kappa and alpha are null.
    """
    m = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    sides = m.select(F.inline(F.array(F.struct(F.col("a").alias("label"), F.col("c").alias("ca"), F.lit(0).cast("bigint").alias("cb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("ca"), F.col("c").alias("cb")))))
    margins = sides.groupBy("label").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    s = margins.agg(F.sum("ca").alias("n"), F.sum(F.col("ca") * F.col("cb")).alias("ab"), F.sum((F.col("ca") + F.col("cb")) * (F.col("ca") + F.col("cb"))).alias("sq"))
    d = m.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    x = s.withColumn("_k", F.lit(1)).join(d.withColumn("_k", F.lit(1)), "_k")
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    total = 2 * F.col("n")
    do, de = 2 * (F.col("n") - F.col("same")), total * total - F.col("sq")
    return x.select(
        "n",
        F.round(po, 6).alias("agreement"),
        F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"),
        F.round(F.when(de > 0, 1 - (total - 1) * do / de), 6).alias("alpha"),
    )


def class_report(pairs: DataFrame, truth: str = "a1", guess: str = "a2") -> DataFrame:
    """label, precision, recall, f1, support per class; a zero denominator gives 0."""
    rows = pairs.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    hit = (F.col(truth) == F.col(guess)).cast("int")
    flat = rows.select(F.inline(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g"), hit.alias("h")), F.struct(F.col(guess).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("h")))))
    s = flat.groupBy("label").agg(F.sum("t").alias("support"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    s = s.withColumn("precision", div(F.col("h"), F.col("g"))).withColumn("recall", div(F.col("h"), F.col("support")))
    f1 = div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return s.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")
