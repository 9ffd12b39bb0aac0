"""What can be said of a whole frame, and lookups and splits that any frame can take."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.learn import hashed_unit


def describe_columns(df: DataFrame) -> DataFrame:
    """column, type, rows, filled: name and type of each column, the number of rows and of its non-null values. One pass."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, type string, rows bigint, filled bigint")
    counts = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.col(f"`{f.name}`")).alias("filled")) for f in df.schema.fields))
    return df.agg(F.count("*").alias("rows"), counts.alias("x")).select("rows", F.inline("x")).select("column", "type", "rows", "filled")


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that match a pattern in full, in their order."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


_WHOLE = (("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31))


def shrink(df: DataFrame) -> DataFrame:
    """Whole-number columns in the smallest type that holds all their values; other columns stay as they are.

    One pass for all ranges. Columns without values get the smallest type. Doubles are not shortened, as that would change values.
    """
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))]
    if not whole:
        return df
    r = df.agg(*(F.struct(F.min(f"`{c}`").alias("a"), F.max(f"`{c}`").alias("z")).alias(c) for c in whole)).first()
    types = {}
    for c in whole:
        a, z = r[c].a or 0, r[c].z or 0
        types[c] = next((t for t, n in _WHOLE if -n <= a and z < n), "bigint")
    return df.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, missing: int = -1) -> DataFrame:
    """Adds ``value`` of the row of ``table`` with the same key, ``missing`` where there is none. Keys of the table must be unique."""
    return df.join(table.select(key, F.col(value).alias("_v")), key, "left").withColumn(value, F.coalesce("_v", F.lit(missing))).drop("_v")


def check_shares(*shares: float) -> None:
    """Raises unless the shares are in [0, 1] and add up to 1."""
    if any(not 0 <= s <= 1 for s in shares) or not math.isclose(sum(shares), 1.0, abs_tol=1e-9):
        raise ValueError(f"shares must add up to 1: {shares}")


def random_split(df: DataFrame, key: str, train: float = 0.70, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``part`` by a number drawn from the key: no shuffle, shares met in expectation, the same at any partitioning."""
    check_shares(train, validation, test)
    u = hashed_unit(F.col(key), seed)
    return df.withColumn("part", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def cosine_rate(epoch: int, epochs: int, start: float = 1e-3, end: float = 0.0) -> float:
    """The learning rate of an epoch on half a cosine from ``start`` to ``end``."""
    return end + (start - end) * (1 + math.cos(math.pi * min(epoch, epochs) / epochs)) / 2
