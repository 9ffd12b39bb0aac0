"""Pages of one snapshot that repeat each other with small edits: texts by SetSketch, then pages and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import words
from palimpsest.llm.setsketch import SketchParams, similar_texts
from palimpsest.operators.lineage import materialize
from palimpsest.operators.snapshots import current_texts, latest


def text_classes(snapshot: DataFrame, p: SketchParams) -> tuple[DataFrame, DataFrame]:
    """Texts that agree word for word as one class: members (id, sub_collection, docid) and texts (id, mask, words).

    ``words`` are 64-bit word hashes and ``id`` a 64-bit hash of their sequence. ``mask`` has a bit for each snapshot in which the text is current, so texts that never
    stand in one snapshot are not compared (two snapshots may share a bit, which costs a comparison and changes nothing). Texts of fewer words than a
    shingle, null texts included, are in no class.
    """
    w = F.transform(words(F.col("text")), lambda x: F.xxhash64(x))
    t = current_texts(snapshot).select("docid", "seen", w.alias("words")).filter(F.size("words") >= p.shingle)
    t = materialize(t.withColumn("id", F.xxhash64("words")), "p1-texts")
    members = t.select("id", "docid", F.inline("seen")).select("id", "sub_collection", "docid")
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(s["sub_collection"]), F.lit(64)).cast("int"))
    masks = t.select("id", F.aggregate("seen", F.lit(0).cast("bigint"), lambda acc, s: acc.bitwiseOR(bit(s))).alias("m")).groupBy("id").agg(F.bit_or("m").alias("mask"))
    one = latest(t.select("id", "words"), ["id"], [F.lit(0).asc()])
    return members, one.join(masks, "id").select("id", "mask", "words")


def similar_classes(snapshot: DataFrame, p: SketchParams) -> tuple[DataFrame, DataFrame]:
    """Members of each class, and the pairs of different classes that reach the threshold (a, b, similarity)."""
    members, texts = text_classes(snapshot, p)
    return members, materialize(similar_texts(texts, p), "p1-pairs")


def similar_pages(snapshot: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:  # noqa: B008
    """sub_collection, docid_a, docid_b of current rows of one snapshot that reach the threshold; docid_a < docid_b.

    Pages whose words agree have similarity 1 and are found through their class, never compared.
    """
    members, pairs = similar_classes(snapshot, p)
    side = lambda s: members.select(F.col("id").alias(s), "sub_collection", F.col("docid").alias(f"docid_{s}"))
    both = F.struct(F.least("docid_a", "docid_b").alias("docid_a"), F.greatest("docid_a", "docid_b").alias("docid_b"))
    across = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "sub_collection"]).filter("docid_a <> docid_b")
    equal = side("a").withColumnRenamed("a", "id").join(side("b").withColumnRenamed("b", "id"), ["id", "sub_collection"]).filter("docid_a < docid_b")
    return across.select("sub_collection", both.alias("p")).select("sub_collection", "p.*").unionByName(equal.select("sub_collection", "docid_a", "docid_b"))


def page_groups(snapshot: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:  # noqa: B008
    """sub_collection, docid, group_id, links: one row for each current row with enough words.

    ``group_id`` is the smallest docid that is reached over similar pages of the snapshot; ``links`` is the number of other
    pages of the snapshot that reach the threshold with this one. Pages alone have their own docid and 0 links. Copies
    are counted, not paired: a class enters the graph once per snapshot, with its number of members.
    """
    members, pairs = similar_classes(snapshot, p)
    node = members.groupBy("sub_collection", "id").agg(F.count("*").alias("n"), F.min("docid").alias("least"))
    node = materialize(node, "p1-nodes")
    end = lambda s: node.select("sub_collection", F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("least").alias(f"least_{s}"))
    edges = materialize(pairs.select("a", "b").join(end("a"), "a").join(end("b"), ["b", "sub_collection"]), "p1-edges")
    degree = edges.select("sub_collection", F.col("a").alias("id"), F.col("n_b").alias("n")).unionByName(edges.select("sub_collection", F.col("b").alias("id"), F.col("n_a").alias("n")))
    degree = degree.groupBy("sub_collection", "id").agg(F.sum("n").alias("others"))
    roots = components(edges.select("sub_collection", F.col("least_a").alias("u"), F.col("least_b").alias("v")), "sub_collection")
    out = node.join(degree, ["sub_collection", "id"], "left").join(roots.withColumnRenamed("node", "least"), ["sub_collection", "least"], "left")
    out = out.select("sub_collection", "id", F.coalesce("root", "least").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members.join(out, ["sub_collection", "id"]).select("sub_collection", "docid", "group_id", "links")


def _digest(edges: DataFrame, part: str) -> tuple:
    """Number and order-free hash of a set of edges: what tells two of them apart without a join."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(part, "u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u", part))).first())


def components(edges: DataFrame, part: str) -> DataFrame:
    """part, node, root: the smallest node of each connected component of (part, u, v), for nodes with an edge.

    Alternating large-star and small-star steps until no edge changes; their number grows with the logarithm of the longest chain, and the edges of each are
    written to the shared folder. The driver only learns a count and a hash. A star's minimum is a partial aggregate over keys, not a collected list.
    """
    e = edges.select(part, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = materialize(e, "edges")
    before, now = None, _digest(e, part)
    while before != now:
        both = e.unionByName(e.select(part, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(part, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, [part, "u"]).filter("v > u").select(part, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy(part, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [part, "u"])
        small = small.select(part, F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        e = materialize(small.filter("u <> v").distinct(), "edges")
        before, now = now, _digest(e, part)
    star = e.groupBy(part, "u").agg(F.min("v").alias("root")).select(part, F.col("u").alias("node"), "root")
    return star.unionByName(e.select(part, F.col("v").alias("node"), F.col("v").alias("root")).distinct())
