"""Text expressions that stay inside the JVM.

All take and give Columns. Null text gives null unless stated otherwise. Spark has no SQL function for Unicode
normal forms, so ``nfc`` and ``nfd`` call the ICU library that ships with Spark by reflection (no Python worker).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank, tab, CR, LF, U+00A0.
SPACE = "[ \\t\\r\\n\\u00A0]"
_ICU = "com.ibm.icu.text.Normalizer"


def nfc(c: Column) -> Column:
    """Unicode normal form C."""
    return F.when(c.isNotNull(), F.reflect(F.lit(_ICU), F.lit("compose"), c, F.lit(False)))


def nfd(c: Column) -> Column:
    """Unicode normal form D."""
    return F.when(c.isNotNull(), F.reflect(F.lit(_ICU), F.lit("decompose"), c, F.lit(False)))


def squeeze(c: Column) -> Column:
    """Each run of white space as one blank, ends trimmed. Only-blank text gives ''."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """True for null text and text of white space only."""
    return c.isNull() | (F.regexp_replace(c, f"{SPACE}+", "") == "")


def words(c: Column) -> Column:
    """Longest runs of letters and digits in NFC and lower case, in order. '' and null give an empty array."""
    parts = F.split(F.lower(nfc(F.coalesce(c, F.lit("")))), "[^\\p{L}\\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def letter_terms(c: Column) -> Column:
    """Longest runs of letters in NFC and lower case (digits and all else separate)."""
    parts = F.split(F.lower(nfc(F.coalesce(c, F.lit("")))), "[^\\p{L}]+")
    return F.filter(parts, lambda w: w != "")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of ``\\w`` in the Unicode sense: letters, numbers and underscore."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))


#: Characters that the query cleaner removes.
QUERY_NOISE = "'*/:?)(+"


def clean_query(c: Column) -> Column:
    """Removes the characters that a query parser would read as operators, then trims."""
    return F.trim(F.translate(c, QUERY_NOISE, ""))


def fold_accents(c: Column) -> Column:
    """ASCII letters for accented ones; œ, æ and ß become two letters."""
    marks = F.regexp_replace(nfd(c), "\\p{M}+", "")
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss")):
        marks = F.replace(marks, F.lit(a), F.lit(b))
    return marks


def split_elisions(c: Column) -> Column:
    """l'eau -> l eau, d'eau -> d eau."""
    return F.replace(F.replace(c, F.lit("l'"), F.lit("l ")), F.lit("d'"), F.lit("d "))


def drop_punctuation(c: Column, digits: bool = False) -> Column:
    """Removes all but letters, numbers, underscore and white space; with ``digits`` also the digits.

    Nothing is put in the place of what is removed: l'eau gives leau.
    """
    return F.regexp_replace(c, "[^\\p{L}\\p{N}_\\s]" + ("|\\p{Nd}" if digits else ""), "")


def safe_unit(c: Column) -> Column:
    """A number in [0, 1] read from text; 0.0 for null, bad text and numbers out of range."""
    x = c.cast("string").try_cast("double")
    return F.coalesce(F.when(x.between(0.0, 1.0), x), F.lit(0.0))
