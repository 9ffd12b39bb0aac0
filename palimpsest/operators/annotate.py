"""Annotation of queries: an interface for annotators, a rule-based default, cleaning of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.config import CATEGORIES
from palimpsest.functions.text import safe_unit
from palimpsest.operators.learn import hashed_unit

#: An annotator takes a frame with a column ``query`` and adds a column ``answer``; a remote model is one, called in mapInPandas.
Annotator = Callable[[DataFrame], DataFrame]

#: Patterns of the rules, tried in this order, for both Spark and SQL.
YEAR_PATTERN = "(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)"
EVENT_PATTERN = "(^| )(festival|coupe|concert|exposition|tournoi|match|fête|marathon|salon|guerre|élection|élections)( |$)"
CURRENT_PATTERN = "(^| )(aujourd'hui|prix|météo|horaires|avis|près|acheter|gratuit|promotion|pas cher|direct)( |$)"


def rule_category(query: Column) -> Column:
    """A category from words in the query: a year, an event, current information; else time-independent. Null stays null."""
    q = F.lower(query)
    out = F.when(q.rlike(YEAR_PATTERN), "explicit-time").when(q.rlike(EVENT_PATTERN), "event").when(q.rlike(CURRENT_PATTERN), "timeliness").otherwise("time-independent")
    return F.when(query.isNotNull(), out)


def rule_annotator(df: DataFrame) -> DataFrame:
    """The rules as an annotator."""
    return df.withColumn("answer", rule_category(F.col("query")))


def random_annotator(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A baseline: a category drawn from the key and the seed."""
    return df.withColumn("answer", F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.floor(hashed_unit(F.col(key), seed) * len(CATEGORIES)) + 1).cast("int")))


def clean_category(answer: Column) -> Column:
    """A known category, trimmed, in lower case, without a full stop; null for any other answer."""
    a = F.rtrim(F.lower(F.trim(answer)), F.lit("."))
    return F.when(a.isin(*CATEGORIES), a)


def clean_tags(df: DataFrame, tag: str = "tag") -> DataFrame:
    """Reads tags as numbers in [0, 1], 0.0 for all else, and says which changed (column ``changed``)."""
    clean = safe_unit(F.col(tag))
    return df.withColumn("changed", ~clean.cast("string").eqNullSafe(F.col(tag).cast("string"))).withColumn(tag, clean)
