"""Ranks, top-k and re-ranking of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(run: DataFrame, group: list[str], score: str = "score", tie: str = "docid", base: int = 1, name: str = "rank") -> DataFrame:
    """A rank by score descending within the group, ties by ``tie`` ascending; counts from ``base``. Null scores come last."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc())
    return run.withColumn(name, F.row_number().over(w) + (base - 1)) if base != 1 else run.withColumn(name, F.row_number().over(w))


def top_k(run: DataFrame, group: list[str], k: int, score: str = "score", tie: str = "docid") -> DataFrame:
    """The k best of each group with their rank from 1. The filter is on the raw row number, so that Spark limits groups before the shuffle."""
    return ranked(run, group, score, tie).filter(F.col("rank") <= k)


def boost_pairs(run: DataFrame, pairs: DataFrame, on: list[str], factor: float | Column = 1.0) -> DataFrame:
    """Multiplies the score of rows whose keys stand in ``pairs``; pairs count once however often they are listed.

    ``factor`` may be a column of ``pairs``, whose keys must then be unique.
    """
    known = pairs.select(*on).distinct().withColumn("_f", F.lit(float(factor))) if not isinstance(factor, Column) else pairs.select(*on, factor.alias("_f"))
    return run.join(known, on, "left").withColumn("score", F.col("score") * F.coalesce("_f", F.lit(1.0))).drop("_f")


def factor_map(key: Column, factors: dict[str, float]) -> Column:
    """The factor of a key, 1.0 for keys that are null or not listed."""
    pairs = [x for k, v in factors.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(1.0))


def similarity_factor(sim: Column, steps: tuple[tuple[float, float], ...]) -> Column:
    """The factor of the first border that the similarity (rounded to 6 places, at most 1) reaches; 1.0 below all."""
    s = F.least(F.round(sim, 6), F.lit(1.0))
    out = None
    for low, factor in steps:
        out = F.when(s >= low, factor) if out is None else out.when(s >= low, factor)
    return F.lit(1.0) if out is None else out.otherwise(1.0)


def recency_score(score: Column, tag: Column, occurrences: Column, weight: float, clip: int) -> Column:
    """score + weight * tag / (1 + log1p(min(occurrences, clip))); occurrences null count as 1, tag null as 0."""
    n = F.least(F.coalesce(occurrences, F.lit(1)), F.lit(clip))
    return score + F.lit(weight) * F.coalesce(tag, F.lit(0.0)) / (1 + F.log1p(n.cast("double")))


def grid(spark, **axes: list[float]) -> DataFrame:
    """All combinations of parameter values, one row each with a number ``config``.

    The size is the product of the axes, given in code and known before anything runs; it is no join of data.
    """
    from itertools import product

    rows = [(i, *map(float, c)) for i, c in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, "config int, " + ", ".join(f"{n} double" for n in axes))


def with_configs(run: DataFrame, configs: DataFrame) -> DataFrame:
    """Each row of the run once per configuration, by an array of the (few, driver-made) configurations, not by a join."""
    rows = configs.collect()
    structs = [F.struct(*(F.lit(r[c]).alias(c) for c in configs.columns)) for r in rows]
    return run.select("*", F.inline(F.array(*structs)))
