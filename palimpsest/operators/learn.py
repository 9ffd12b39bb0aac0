"""Training sets, splits, weights, clusters and models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier, MultilayerPerceptronClassificationModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, CountVectorizerModel, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def vocabulary(terms: DataFrame, n: int = 10_000, term: str = "term") -> DataFrame:
    """term, count, index of the n most frequent terms: count descending, term ascending; index from 0."""
    counts = terms.filter(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.count("*").alias("count"))
    top = counts.orderBy(F.col("count").desc(), F.col("term").asc()).limit(n)
    return top.withColumn("index", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("term").asc())) - 1)


def multi_hot(terms: DataFrame, vocab: DataFrame, key: list[str], term: str = "term") -> DataFrame:
    """key, term_idx: the sorted distinct vocabulary indexes of each document; documents without vocabulary terms fall out."""
    hits = terms.select(*key, F.col(term).alias("term")).distinct().join(vocab.select("term", "index"), "term")
    return hits.groupBy(*key).agg(F.array_sort(F.collect_list("index")).alias("term_idx"))


def count_vectors(docs: DataFrame, tokens: str = "tokens", size: int = 10_000, out: str = "features") -> CountVectorizerModel:
    """A fitted encoder of token arrays as sparse 0/1 vectors."""
    return CountVectorizer(inputCol=tokens, outputCol=out, vocabSize=size, binary=True).fit(docs)


def hashed_order(key: Column, seed: int = 42) -> Column:
    """Hex digits by which rows are in an order that depends on the key and the seed alone."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def hashed_unit(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) drawn from the key and the seed."""
    return F.conv(F.substring(hashed_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same whatever the partitioning."""
    return df.orderBy(hashed_order(F.col(key), seed), F.col(key)).limit(n)


def stratified_split(df: DataFrame, key: str, strata: list[str], train: float = 0.70, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``part``: train, validation or test, in exact shares within each stratum (rounded down).

    A row's place in its stratum is its place in a bucket (the first four digits of its hash) plus the rows of the buckets before: counts of at most 65 536 buckets
    per stratum are summed up, and no stratum is sorted in one task.
    """
    x = df.withColumn("_h", hashed_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 4))
    counts = x.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*strata)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(w))
    same = [F.col(f"x.{s}").eqNullSafe(F.col(f"c.{s}")) for s in strata] + [F.col("x._b") == F.col("c._b")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    x = x.alias("x").join(counts.alias("c"), on).select("x.*", "c._before", "c._n")
    x = x.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key)))
    part = F.when(F.col("_r") <= F.floor(F.col("_n") * train), "train").when(F.col("_r") <= F.floor(F.col("_n") * (train + validation)), "validation").otherwise("test")
    return x.withColumn("part", part).drop("_r", "_n", "_h", "_b", "_before")


def class_weights(df: DataFrame, label: str, positive: str | int | None = None, factor: float = 1.5) -> DataFrame:
    """label, n, weight = rows / (classes * n), times ``factor`` for the positive class; null labels fall out."""
    c = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")).withColumn("_k", F.lit(1))
    w = F.col("rows") / (F.col("classes") * F.col("n"))
    if positive is not None:
        w = w * F.when(F.col("label") == positive, factor).otherwise(1.0)
    return c.withColumn("_k", F.lit(1)).join(total, "_k").select("label", "n", F.round(w, 6).alias("weight"))


def vectors(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    """Adds an ML vector of an array column; rows with a null array fall out."""
    return df.filter(F.col(array).isNotNull()).withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def hashed_vectors(df: DataFrame, tokens: str = "tokens", size: int = 256, out: str = "embedding") -> DataFrame:
    """Adds a vector of length 1 for each token array: hashed term frequencies times idf. A stand-in where no encoder is at hand.

    Texts without tokens have a vector of zeros. Vectors of an encoder are used the same way: as an array column.
    """
    tf = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=size).transform(df)
    x = IDF(inputCol="_tf", outputCol="_tfidf").fit(tf).transform(tf)
    return Normalizer(inputCol="_tfidf", outputCol="_unit").transform(x).withColumn(out, vector_to_array("_unit")).drop("_tf", "_tfidf", "_unit")


def save_model(model, path: str) -> None:
    """Stores a fitted model, replacing what is there."""
    model.write().overwrite().save(path)


def kmeans(df: DataFrame, k: int, seed: int = 42, features: str = "features") -> DataFrame:
    """Adds ``cluster``."""
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df)


def silhouettes(df: DataFrame, ks: list[int], seed: int = 42, features: str = "features") -> DataFrame:
    """k, silhouette (cosine) for each k; all values are kept, also negative ones. One distributed fit per k."""
    judge = ClusteringEvaluator(predictionCol="cluster", featuresCol=features, distanceMeasure="cosine")
    df = df.persist()
    try:
        rows = [(k, float(judge.evaluate(kmeans(df, k, seed, features)))) for k in ks]
    finally:
        df.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def best_k(table: DataFrame) -> int:
    """The k of the highest silhouette, the smaller one on a tie."""
    return table.orderBy(F.col("silhouette").desc(), F.col("k").asc()).first().k


def plane(df: DataFrame, features: str = "features") -> DataFrame:
    """Adds x and y: the first two principal components, up to their sign."""
    out = PCA(k=2, inputCol=features, outputCol="_pca").fit(df).transform(df).withColumn("_xy", vector_to_array("_pca"))
    return out.withColumn("x", F.col("_xy")[0]).withColumn("y", F.col("_xy")[1]).drop("_pca", "_xy")


def fit_relevance(df: DataFrame, features: str = "features", label: str = "label", weight: str | None = "weight") -> LogisticRegressionModel:
    """The relevance head: weighted logistic regression."""
    m = LogisticRegression(featuresCol=features, labelCol=label, maxIter=50, regParam=0.01, predictionCol="prediction")
    return (m.setWeightCol(weight) if weight else m).fit(df)


def fit_cluster(df: DataFrame, layers: list[int], features: str = "features", label: str = "label", seed: int = 42) -> MultilayerPerceptronClassificationModel:
    """The cluster head: a multilayer perceptron."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, seed=seed, maxIter=100).fit(df)


def fit_heads(df: DataFrame, cluster: str, relevance: str, features: str = "features") -> tuple[LogisticRegressionModel, LogisticRegressionModel]:
    """Two heads on one encoding: the cluster of a page (multinomial) and its relevance (binary)."""
    head = lambda label, out: LogisticRegression(featuresCol=features, labelCol=label, maxIter=30, regParam=0.01, predictionCol=out, probabilityCol=f"{out}_p", rawPredictionCol=f"{out}_raw")
    return head(cluster, "_cluster").fit(df), head(relevance, "_relevant").fit(df)


def predict_heads(df: DataFrame, cluster: LogisticRegressionModel, relevance: LogisticRegressionModel) -> DataFrame:
    """Adds ``cluster`` (the class of the highest probability) and ``p_rel`` (the probability of class 1; 0 if the head knows no class 1)."""
    x = relevance.transform(cluster.transform(df))
    p = vector_to_array("_relevant_p")
    return x.withColumn("cluster", F.col("_cluster").cast("int")).withColumn("p_rel", F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))).drop(*(c for c in x.columns if c.startswith(("_cluster", "_relevant"))))


def positive_probability(c: str = "probability") -> Column:
    """The probability of class 1."""
    return vector_to_array(c)[1]


def gate(run: DataFrame, predictions: DataFrame, topic_clusters: DataFrame) -> DataFrame:
    """Multiplies the score by 2 * p_rel where the document's predicted cluster is the topic's; else by 1.

    run (qid, docid, score, ...), predictions (docid, cluster, p_rel), topic_clusters (qid, cluster); keys of the latter two must be unique.
    Documents without a prediction and topics without a cluster keep their scores.
    """
    x = run.join(predictions.select("docid", F.col("cluster").alias("_c"), "p_rel"), "docid", "left").join(topic_clusters.select("qid", F.col("cluster").alias("_t")), "qid", "left")
    factor = F.when(F.col("_c") == F.col("_t"), 2 * F.col("p_rel"))
    return x.withColumn("score", F.col("score") * F.coalesce(factor, F.lit(1.0))).drop("_c", "_t", "p_rel")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy, f1_macro, f1_weighted from the confusion matrix."""
    from palimpsest.operators.evaluate import class_report

    p = df.select(F.col(label).cast("double").alias("a1"), F.col(prediction).cast("double").alias("a2"))
    r = class_report(p)
    n = F.sum("support")
    return r.agg(F.round(F.sum(F.col("recall") * F.col("support")) / n, 6).alias("accuracy"), F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 6).alias("f1_macro"), F.round(F.sum(F.col("f1") * F.col("support")) / n, 6).alias("f1_weighted"))


def binary_metrics(df: DataFrame, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1_macro, f1_weighted at a threshold on the probability of class 1, and the area under the ROC curve (auc)."""
    x = df.select(F.col(label).cast("double").alias("label"), positive_probability().alias("p"), "rawPrediction").withColumn("prediction", (F.col("p") >= threshold).cast("double"))
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(x)
    hit = F.sum(F.when((F.col("label") == 1) & (F.col("prediction") == 1), 1).otherwise(0))
    one = x.agg(F.round(hit / F.sum("prediction"), 6).alias("precision"), F.round(hit / F.sum("label"), 6).alias("recall")).first()
    return classification_metrics(x).select("*", F.lit(one.precision).cast("double").alias("precision"), F.lit(one.recall).cast("double").alias("recall"), F.round(F.lit(auc), 6).alias("auc"))
