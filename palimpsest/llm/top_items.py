"""The N best items of every group, by heaps of bounded size built before the shuffle and merged after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def top_items(df: DataFrame, group: list[str], item: str, score: str, n: int = 10) -> DataFrame:
    """group columns, item, score, pos: the n best distinct items of each group, score descending, smaller item first.

    ``item`` is a whole number. It counts once, with its highest score: maxima of (group, item) are combined before they are shuffled, so a group of a third of all
    rows is spread over its items. Each task then keeps one bounded heap of n entries per group (Spark's ``collect_top_k``: an aggregate whose state is a priority
    queue), ordered by score, then by the complement of the item, which grows as the item falls; heaps merge after the shuffle, and a task sends at
    most n entries per group. Rows with a null in a group column, the item or the score and scores that are NaN fall out. Groups smaller than n give all they have;
    an empty table gives no rows.
    """
    cols = [*group, item, score]
    clean = df.select(*cols).dropna(subset=cols).filter(~F.isnan(score))
    best = clean.groupBy(*group, item).agg(F.max(score).alias(score))
    entry = F.struct(F.col(score).alias("_s"), F.bitwise_not(F.col(item)).alias("_i"))
    heaps = best.groupBy(*group).agg(InternalFunction.collect_top_k(entry, n, False).alias("_heap"))
    flat = heaps.select(*group, F.posexplode("_heap").alias("_p", "_e"))
    return flat.select(*group, F.bitwise_not(F.col("_e._i")).alias(item), F.col("_e._s").alias(score), (F.col("_p") + 1).alias("pos"))
