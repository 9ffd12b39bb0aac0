"""Lines repeated across one site's documents: PrefixSpan over line sequences, level by level as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import nfc, squeeze
from palimpsest.operators.lineage import materialize
from palimpsest.operators.snapshots import current_texts


def site_lines(snapshot: DataFrame) -> DataFrame:
    """The lines of current rows with a host: host, docid, fp, subs, line_no, item, line.

    One row for each line of a distinct text of a page under one host; ``subs`` are the snapshots in which it is
    current there. ``line`` is NFC, lower case, white space squeezed and trimmed; empty lines fall out but count in line_no.
    ``item`` is the line's md5.
    """
    t = current_texts(snapshot).filter("text is not null")
    by_host = t.select("docid", "fp", "text", "seen", F.explode(F.array_distinct(F.transform("seen", lambda s: s["host"]))).alias("host"))
    by_host = by_host.filter("host is not null").withColumn(
        "subs", F.transform(F.filter("seen", lambda s: s["host"] == F.col("host")), lambda s: s["sub_collection"])
    )
    lines = by_host.select("host", "docid", "fp", "subs", F.posexplode(F.split(F.lower(nfc(F.col("text"))), "\n")).alias("p", "raw"))
    lines = lines.select("host", "docid", "fp", "subs", (F.col("p") + 1).alias("line_no"), squeeze(F.col("raw")).alias("line"))
    return lines.filter("line <> ''").withColumn("item", F.unhex(F.md5("line")))


def frequent_lines(lines: DataFrame, min_docs: int = 8) -> tuple[DataFrame, DataFrame]:
    """The lines in at least ``min_docs`` distinct pages of a host (host, item, docs), and their rows of ``lines``."""
    single = lines.select("host", "item", "docid").distinct().groupBy("host", "item").agg(F.count("*").alias("docs"))
    single = materialize(single.filter(F.col("docs") >= min_docs), "p5-lines")
    return single, lines.join(single.select("host", "item"), ["host", "item"])


def sequence_graph(lines: DataFrame, min_docs: int = 8, max_length: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PrefixSpan: line sequences (in order, gaps allowed) in at least ``min_docs`` distinct pages of a host, as a graph.

    A node is a projected database, and every path from the node '' is a frequent sequence. Gives the edges (host, node,
    code, docs), where they lead (host, node, code, next) and the frequent lines (host, item, line, docs, code) that the
    numbers stand for.

    The first level counts single lines; as the support of a sequence never exceeds that of its parts, only frequent lines go
    on. The projected database of a sequence is a set of rows (host, node, rest, n): what follows the place where the sequence
    first ends in each text of a page, and the number of pages with just these rests. Rests lose the lines that no longer make
    the sequence frequent, equal ones become one row, and empty ones fall out. Sequences with equal databases grow alike and
    share a node, so that each database is grown once, however many sequences lead to it. Nodes are named by a sum of the md5
    of their rows, which needs no database in one place. Support is summed by (host, node, line), in partial sums first, so
    a host of a third of all rows needs no task of its own. Levels are added until there is no new database, or up
    to ``max_length`` lines if a number is given.
    """
    single, alphabet = frequent_lines(lines, min_docs)
    code = F.row_number().over(Window.partitionBy("host").orderBy("item"))
    names = alphabet.groupBy("host", "item").agg(F.min("line").alias("line")).join(single, ["host", "item"])
    names = materialize(names.withColumn("code", code), "p5-names")
    texts = alphabet.join(names.select("host", "item", "code"), ["host", "item"]).groupBy("host", "docid", "fp")
    texts = texts.agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "code"))), lambda s: s["code"]).alias("text"))
    pages = texts.groupBy("host", "docid").agg(F.sort_array(F.collect_set("text")).alias("rest"))
    pages = pages.groupBy("host", "rest").agg(F.count("*").alias("n"))
    pages = materialize(pages.select("host", F.lit("").alias("node"), "rest", "n"), "p5-projected1")
    edges = names.select("host", F.lit("").alias("node"), "code", "docs")
    leads, known, length = None, None, 1
    while length != max_length:
        step = materialize(_databases(pages).filter(F.col("pages") >= min_docs).drop("pages"), f"p5-leads{length}")
        leads = step if leads is None else leads.unionByName(step)
        fresh = step.groupBy("host", "next").agg(F.min(F.struct("node", "code")).alias("by"))
        fresh = materialize(fresh if known is None else fresh.join(known, ["host", "next"], "left_anti"), f"p5-fresh{length}")
        if fresh.isEmpty():
            break
        known = fresh.select("host", "next") if known is None else known.unionByName(fresh.select("host", "next"))
        fresh = fresh.select("host", "next", "by.*")
        behind = pages.join(fresh, ["host", "node"]).select("host", F.col("next").alias("node"), _behind(F.col("code")).alias("rest"), "n")
        behind = materialize(behind.filter(F.size("rest") > 0).groupBy("host", "node", "rest").agg(F.sum("n").alias("n")), f"p5-behind{length}")
        grown = behind.select("host", "node", "n", F.explode(F.array_distinct(F.flatten("rest"))).alias("code"))
        grown = grown.groupBy("host", "node", "code").agg(F.sum("n").alias("docs"))
        grown = materialize(grown.filter(F.col("docs") >= min_docs), f"p5-level{length + 1}")
        edges = edges.unionByName(grown)
        more = grown.groupBy("host", "node").agg(F.collect_list("code").alias("more"))
        pages = behind.join(more, ["host", "node"]).withColumn("rest", _rests(F.transform("rest", lambda r: F.filter(r, lambda c: F.array_contains(F.col("more"), c)))))
        pages = pages.filter(F.size("rest") > 0).groupBy("host", "node", "rest").agg(F.sum("n").alias("n"))
        length += 1
        pages = materialize(pages, f"p5-projected{length}")
    if leads is None:
        leads = edges.select("host", "node", "code", F.lit(None).cast("string").alias("next")).limit(0)
    return edges, leads, names


def _rests(rests: Column) -> Column:
    """Rests in the one form by which databases are compared: sorted, distinct, none empty."""
    return F.sort_array(F.array_distinct(F.filter(rests, lambda r: F.size(r) > 0)))


def _behind(code: Column) -> Column:
    """What follows the first ``code`` in each of the rests that has it."""
    return _rests(F.transform(F.filter("rest", lambda r: F.array_contains(r, code)), lambda r: F.slice(r, F.array_position(r, code).cast("int") + 1, F.size(r))))


def _databases(pages: DataFrame) -> DataFrame:
    """host, node, code, next, pages: the name of the database of every node with one more line, and the pages in it.

    The name comes from the sums of n times each quarter of the md5 of a row's rests, so rows with equal rests count as one row.
    """
    x = pages.select("host", "node", "rest", "n", F.explode(F.array_distinct(F.flatten("rest"))).alias("code"))
    x = x.select("host", "node", "code", "n", _behind(F.col("code")).alias("rest")).filter(F.size("rest") > 0)
    x = x.select("host", "node", "code", "n", F.md5(F.to_json("rest")).alias("h"))
    quarters = [F.sum(F.col("n") * F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("bigint")) for k in range(4)]
    return x.groupBy("host", "node", "code").agg(F.md5(F.concat_ws(" ", *quarters)).alias("next"), F.sum("n").alias("pages"))


def frequent_sequences(lines: DataFrame, min_docs: int = 8, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The paths of ``sequence_graph``: the sequences (host, sequence array<int>, docs), and the frequent lines (host, code, line)."""
    edges, leads, names = sequence_graph(lines, min_docs, max_length)
    edges = materialize(edges.join(leads, ["host", "node", "code"], "left"), "p5-edges")
    level = edges.filter("node = ''").select("host", F.array("code").alias("sequence"), "docs", "next")
    found, length = level, 1
    while length != max_length:
        level = level.filter("next is not null").select("host", "sequence", F.col("next").alias("node")).join(edges, ["host", "node"])
        level = materialize(level.select("host", F.array_append("sequence", F.col("code")).alias("sequence"), "docs", "next"), f"p5-paths{length + 1}")
        if level.isEmpty():
            break
        found = found.unionByName(level)
        length += 1
    return found.drop("next"), names.select("host", "code", "line")


def repeated_lines(snapshot: DataFrame, min_docs: int = 8) -> DataFrame:
    """sub_collection, docid, line_no, line of every occurrence of a frequent sequence, single lines included.

    The sequences of every length are grown first (see ``sequence_graph``), and every line of one of them is taken where it
    stands: a line of a sequence is a frequent sequence itself. Rows without a host, null texts and empty lines give nothing.
    """
    lines = materialize(site_lines(snapshot), "p5-all")
    edges, _, names = sequence_graph(lines, min_docs)
    found = edges.select("host", "code").distinct().join(names, ["host", "code"]).select("host", "item")
    return lines.join(found, ["host", "item"]).select(F.explode("subs").alias("sub_collection"), "docid", "line_no", "line")


def line_sequences(snapshot: DataFrame, min_docs: int = 8, max_length: int | None = None) -> DataFrame:
    """host, length, lines, docs: the frequent line sequences of every host, with their lines in normalised form."""
    lines = materialize(site_lines(snapshot), "p5-all")
    found, names = frequent_sequences(lines, min_docs, max_length)
    names = names.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "line"))), lambda s: s["line"]).alias("line"))
    spelled = F.transform("sequence", lambda c: F.element_at("line", c))
    return found.join(names, "host").select("host", F.size("sequence").alias("length"), spelled.alias("lines"), "docs")


def without_repeated_lines(snapshot: DataFrame, min_docs: int = 8) -> DataFrame:
    """Current rows with the repeated lines taken out: sub_collection, docid, removed, text.

    Rows without repeated lines come out as they are; a text of repeated lines only becomes ''.
    """
    t = current_texts(snapshot)
    gone = repeated_lines(snapshot, min_docs).groupBy("docid", "sub_collection").agg(F.collect_list("line_no").alias("gone"))
    rows = t.select("docid", "text", F.inline("seen")).join(gone, ["docid", "sub_collection"], "left")
    keep = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i + 1))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    return rows.select("sub_collection", "docid", F.coalesce(F.size("gone"), F.lit(0)).alias("removed"), text.alias("text"))
