"""Identifiers: one canonical document key, hosts and source names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_docid(c: Column) -> Column:
    """The digits of a docid in any dialect (doc12, 12, doc-12, DOC12) as bigint; null if there are none."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")


def strip_prefix(c: Column, prefix: str = "doc") -> Column:
    """Removes the prefix at the start only."""
    return F.regexp_replace(c, f"^{prefix}", "")


def strip_chars(c: Column, chars: str = "doc") -> Column:
    """Removes any of the characters at both ends (a character set, not a prefix: cod12 gives 12)."""
    return F.btrim(c, F.lit(chars))


def add_prefix(c: Column, prefix: str = "doc") -> Column:
    """The key as a sink wants it."""
    return F.concat(F.lit(prefix), c.cast("string"))


def host(url: Column) -> Column:
    """Lower case, without http(s)://, up to the first / ? or :, without a leading www. or m.; null without url.

    A url that is empty after this gives null.
    """
    h = F.regexp_replace(F.lower(F.trim(url)), "^https?://", "")
    h = F.regexp_replace(F.regexp_extract(h, "^([^/?:]*)", 1), "^(?:www\\.|m\\.)", "")
    return F.when(h != "", h)


def source_name(c: Column) -> Column:
    """Trimmed, lower case, - as _."""
    return F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
