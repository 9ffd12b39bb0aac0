"""Current rows of a table delivered in full snapshots, and the changes between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.ids import bare_docid, host
from palimpsest.functions.text import is_blank, nfc, squeeze


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    ``row_number() = 1`` lets Spark limit each key to one row before the shuffle (WindowGroupLimit), so a key that
    holds a third of all rows sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keyed(snapshot: DataFrame) -> DataFrame:
    """Bare docid and fingerprint of the text beside the columns needed later; rows without a docid or snapshot fall out."""
    return snapshot.select(
        bare_docid(F.col("docid")).alias("docid"),
        F.col("sub_collection"),
        F.col("text_fr").alias("text"),
        host(F.col("url")).alias("host"),
        F.col("delivered_at"),
        F.xxhash64("text_fr").alias("fp"),
    ).filter("docid is not null and sub_collection is not null")


def current_keys(rows: DataFrame) -> DataFrame:
    """Of all rows with one docid and one sub_collection the one delivered last: docid, sub_collection, host, fp.

    Null delivered_at comes last; ties go to the smaller fingerprint, then the smaller host. No text is shuffled.
    """
    slim = rows.select("docid", "sub_collection", "host", "fp", "delivered_at")
    order = [F.col("delivered_at").desc_nulls_last(), F.col("fp").asc(), F.col("host").asc()]
    return latest(slim, ["docid", "sub_collection"], order).drop("delivered_at")


def current_texts(snapshot: DataFrame) -> DataFrame:
    """The distinct texts of each page's current rows: docid, fp, text, seen array<struct<sub_collection, host>>.

    One row for each docid and text, with the snapshots in which that text is current (``seen`` holds at most one
    entry per snapshot). Texts are shuffled once, and once for all snapshots that repeat them; which rows are current
    is decided on keys alone. Within one docid texts are told apart by a 64-bit fingerprint. Null text is kept.
    """
    rows = keyed(snapshot)
    seen = current_keys(rows).groupBy("docid", "fp").agg(F.collect_list(F.struct("sub_collection", "host")).alias("seen"))
    texts = latest(rows.select("docid", "fp", "text"), ["docid", "fp"], [F.lit(0).asc()])
    return texts.join(seen, ["docid", "fp"])


def current_rows(snapshot: DataFrame) -> DataFrame:
    """One row for each docid and sub_collection: docid, sub_collection, text, host."""
    return current_texts(snapshot).select("docid", "text", F.inline("seen"))


def comparable_text(c: Column) -> Column:
    """NFC, each run of white space as one blank, trimmed, case kept; null and blank give ''."""
    return F.when(is_blank(c), F.lit("")).otherwise(squeeze(nfc(c)))


def snapshot_cells(df: DataFrame, key: list[str], snapshot: str, fields: dict[str, Column], all_snapshots: DataFrame | None = None) -> DataFrame:
    """Unpivots snapshots into signed cells.

    Each row gives, for its own snapshot, cells of sign +1, and for the next snapshot present in the data cells of
    sign -1: one presence marker (field null) and one cell per field with the value's fingerprint (md5).
    Output: snapshot, key columns, field, value, sign. Rows of the last snapshot give no negative cells, rows
    of the first no positive ones, so only changes between two snapshots come out. The snapshots and their order are read from
    ``all_snapshots`` if given: a frame with the same snapshots that costs less to read than ``df``.
    """
    order = (df if all_snapshots is None else all_snapshots).select(snapshot).distinct()
    steps = order.select(
        F.col(snapshot).alias("_at"),
        F.lead(snapshot).over(Window.orderBy(snapshot)).alias("_next"),
        F.lag(snapshot).over(Window.orderBy(snapshot)).alias("_before"),
    )
    cells = F.array(
        F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("binary").alias("value")),
        *(F.struct(F.lit(n).alias("field"), F.unhex(F.md5(c)).alias("value")) for n, c in fields.items()),
    )
    flat = df.select(F.col(snapshot).alias("_at"), *key, F.inline(cells)).join(steps, "_at")
    signed = F.array(
        F.struct(F.when(F.col("_before").isNotNull(), F.col("_at")).alias(snapshot), F.lit(1).alias("sign")),
        F.struct(F.col("_next").alias(snapshot), F.lit(-1).alias("sign")),
    )
    return flat.select(*key, "field", "value", F.inline(signed)).filter(F.col(snapshot).isNotNull())


def snapshot_changes(cells: DataFrame, key: list[str], snapshot: str) -> DataFrame:
    """Classifies keys from the nonzero sums of signed cells: snapshot, key, change, fields.

    A nonzero presence marker means added (+1) or removed (-1); else nonzero field cells mean changed, and ``fields``
    lists the fields that differ. Unchanged keys give no row. One shuffle on (snapshot, key) serves both sums.
    """
    sums = (
        cells.repartition(F.col(snapshot), *map(F.col, key))
        .groupBy(snapshot, *key, "field", "value")
        .agg(F.sum("sign").alias("sum"))
        .filter("sum <> 0")
    )
    out = sums.groupBy(snapshot, *key).agg(
        F.sum(F.when(F.col("field").isNull(), F.col("sum"))).alias("_present"),
        F.array_sort(F.collect_set("field")).alias("_fields"),
    )
    change = F.when(F.col("_present") > 0, "added").when(F.col("_present") < 0, "removed").otherwise("changed")
    return out.select(snapshot, *key, change.alias("change"), F.when(F.col("_present").isNull(), F.col("_fields")).alias("fields"))


def page_changes(snapshot: DataFrame) -> DataFrame:
    """Added, removed and changed pages of every two consecutive sub_collections: sub_collection, docid, change, fields.

    The text is reduced to its fingerprint before any shuffle, so what moves is keys of fixed size.
    """
    rows = keyed(snapshot.withColumn("text_fr", comparable_text(F.col("text_fr"))))
    slim = rows.select("docid", "sub_collection", "delivered_at", F.unhex(F.md5("text")).alias("text"))
    now = latest(slim, ["docid", "sub_collection"], [F.col("delivered_at").desc_nulls_last(), F.col("text").asc()])
    cells = snapshot_cells(now, ["docid"], "sub_collection", {"text_fr": F.hex("text")}, keyed(snapshot))
    return snapshot_changes(cells, ["docid"], "sub_collection")
