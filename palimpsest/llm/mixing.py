"""Mixing sources to target shares of tokens by weighted sampling without replacement (Efraimidis and Spirakis)."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.ids import source_name
from palimpsest.operators.lineage import materialize

#: Fixed value: how byte-level BPE vocabularies of this family cut a text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(path: str, pattern: str = PATTERN) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``tokens`` to batches with a column ``text`` and drops the text; null and '' have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            rest = [i for i, name in enumerate(b.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(n, pa.int64())], [*(b.schema.names[i] for i in rest), "tokens"])

    return run


def quality_weight(text: Column) -> Column:
    """A weight in [0.05, 1]: the share of letters and blanks in the text, halved for texts under 200 characters."""
    kept = F.length(F.regexp_replace(text, "[^\\p{L} ]", ""))
    share = kept / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(share * F.when(F.length(text) < 200, 0.5).otherwise(1.0), F.lit(0.05)), F.lit(0.05))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) drawn from the key alone: the same at any partitioning and after any retry."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def exponential_key(key: Column, weight: Column, seed: int) -> Column:
    """The key -ln(u) / weight: the smaller it is, the earlier a document is drawn. All of its digits count, however small the weight."""
    return -F.log(uniform(key, seed)) / weight


def key_bucket(key: Column, steps: int = 1024) -> Column:
    """Buckets of equal width on a logarithmic scale, ``steps`` to a doubling of the key.

    Whatever the weights are, an exponential key falls into one bucket with a probability of at most ln(2) / (e * steps), 0.025 % for 1024 steps.
    """
    return F.floor(F.log2(key) * steps).cast("int")


def counted(documents: DataFrame, tokenizer: str, seed: int = 42, pattern: str = PATTERN) -> DataFrame:
    """doc_id, name, tokens, key of every document."""
    slim = documents.select("doc_id", source_name(F.col("source")).alias("name"), quality_weight(F.col("text")).alias("w"), "text")
    tok = slim.mapInArrow(token_counter(tokenizer, pattern), "doc_id bigint, name string, w double, tokens bigint")
    return tok.select("doc_id", "name", "tokens", exponential_key(F.col("doc_id"), F.col("w"), seed).alias("key"))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 42, steps: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Draws documents so that each source holds its target share of the tokens of all documents used once.

    Gives the plan per target (source, name, budget, available, epochs, rest, ...) and the drawn documents (doc_id,
    name, tokens, times). A source is used in as many complete epochs as fit its budget, up to max_repeat; what is then
    missing is filled, if another repeat is allowed, with documents in the order of their keys as long as their
    running sum stays within the budget. The running sum has two levels: sums over logarithmic buckets of the key per
    source (see ``key_bucket``), then a sort inside the one bucket where the budget ends; no source is ever sorted in one task. Sources are compared
    trimmed, in lower case, - as _. Documents of a null source or of no target count in the total and are not drawn;
    null text has 0 tokens; a target without documents stays with 0 tokens; repeated targets keep the first in order.
    """
    docs = materialize(counted(documents, tokenizer, seed), "p8-counted").withColumn("bucket", key_bucket(F.col("key"), steps))
    hist = materialize(docs.groupBy("name", "bucket").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "p8-buckets")
    total = hist.agg(F.coalesce(F.sum("t"), F.lit(0))).scalar()
    have = hist.groupBy("name").agg(F.sum("t").alias("available"), F.sum("n").alias("documents"))
    one = Window.partitionBy("name").orderBy("source")
    goal = (
        targets.select("source", "target_share", "max_repeat")
        .filter("source is not null and target_share is not null")
        .withColumn("name", source_name(F.col("source")))
        .withColumn("_k", F.row_number().over(one))
        .filter("_k = 1")
        .join(have, "name", "left")
        .select(
            "source",
            "name",
            "target_share",
            F.coalesce("max_repeat", F.lit(1)).alias("max_repeat"),
            F.coalesce("available", F.lit(0)).alias("available"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            (F.col("target_share") * total).alias("budget"),
        )
    )
    goal = goal.withColumn("epochs", F.when(F.col("available") > 0, F.least(F.col("max_repeat").cast("bigint"), F.floor(F.col("budget") / F.col("available")))).otherwise(F.lit(0)))
    goal = goal.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeat"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(F.lit(0.0)))
    goal = materialize(goal, "p8-goal")
    run = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = hist.filter("name is not null").withColumn("upto", F.sum("t").over(run)).select("name", "bucket", "upto", "t")
    edges = (
        upto.join(goal.select("name", "rest"), "name")
        .filter("upto > rest")
        .groupBy("name")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before")), "bucket").alias("edge"))
    )
    plan = goal.select("name", "epochs", "rest").join(edges, "name", "left")
    named = docs.join(plan, "name")
    whole = named.filter("edge is null or bucket <> edge.bucket").withColumn("extra", F.when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge.bucket")), (F.col("rest") > 0).cast("int")).otherwise(0))
    inside = Window.partitionBy("name").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = named.filter("bucket = edge.bucket").withColumn("extra", (F.col("edge.before") + F.sum("tokens").over(inside) <= F.col("rest")).cast("int"))
    drawn = whole.unionByName(split).select("doc_id", "name", "tokens", (F.col("epochs") + F.col("extra")).alias("times")).filter("times > 0")
    return goal, drawn


def mix_report(goal: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per target what was asked for and what the drawn documents reach.

    source, target_share, max_repeat, documents, available, budget, used_tokens, actual_share, short. ``short`` says that the
    source falls short of its budget though every document is used max_repeat times.
    """
    used = drawn.groupBy("name").agg(F.sum(F.col("tokens") * F.col("times")).alias("used"))
    out = goal.join(used, "name", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    everything = used.agg(F.coalesce(F.sum("used"), F.lit(0))).scalar()
    spent = F.col("used") == F.col("available") * F.col("max_repeat")
    return out.select(
        "source",
        "target_share",
        "max_repeat",
        "documents",
        "available",
        "budget",
        F.col("used").alias("used_tokens"),
        F.when(everything > 0, F.col("used") / everything).otherwise(0.0).alias("actual_share"),
        ((F.col("target_share") > 0) & spent & (F.col("used") < F.col("budget"))).alias("short"),
    )
