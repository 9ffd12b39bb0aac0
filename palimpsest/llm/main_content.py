"""Main body of pages by a site style tree: pages are merged by host, nodes that say little are found by entropy, their branches are cut.

``text_fr`` has lost its tags, so a line's place in the tree is host, presentation, content. A presentation is read from the characters alone: the
line with names and figures masked (with and without its first word), and, further up, the kinds of its first and last character (its *tag*).
One measure serves all nodes: the bits that a node tells about its page, given the pages that have it.

1. *Leaves.* A node that stands on a share p of a host's pages tells log2(1 / p) bits. The share is that of the host's other pages, smoothed with
   the composite share of the same node on all other hosts, so that a host of three pages is judged by the same formula as one of a million
   and a family of near copies on one host is no furniture of other hosts. Nodes under ``MIN_BITS`` are furniture, and their branches are cut.
2. *Heads and bodies.* The first line left on a page is its head node, the others are its body nodes. A body branch whose tag and opening are more
   likely in a head (a positive log-likelihood ratio, openings smoothed by Witten and Bell) is the head of another page: a pointer.
   A label before it is a node whose continuations are heads and spread with at least ``LABEL_BITS`` of entropy; it is cut with what it points to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import nfc, squeeze
from palimpsest.operators.lineage import materialize
from palimpsest.operators.snapshots import current_texts

#: A node that tells fewer bits stands on more than 13 % of the pages: furniture.
MIN_BITS = 2.9
#: Weight of the other hosts' share, in pages.
PRIOR_PAGES = 20
#: Entropy of the continuations from which a prefix is a label.
LABEL_BITS = 3.0
#: Longest label, in words.
LABEL_WORDS = 3

_NAME = "(?<![\\p{L}'])\\p{Lu}[\\p{L}'-]*"
_PAGE = ["host", "docid", "fp"]


def _figures(c: Column) -> Column:
    return F.regexp_replace(c, "\\p{N}+", "#")


def _shape(line: Column, shouted: Column) -> Column:
    """Names and figures masked, rows of names as one; a line in capitals has no names to mask."""
    names = F.regexp_replace(F.regexp_replace(line, _NAME, "§"), "§(?:[ |/>·-]*§)+", "§")
    return _figures(F.when(shouted, line).otherwise(names))


def _first_kind(word: Column) -> Column:
    c = F.substring(word, 1, 1)
    return F.when(c.rlike("\\p{Lu}"), "A").when(c.rlike("\\p{L}"), "a").when(c.rlike("\\p{N}"), "#").otherwise(c)


def _last_kind(line: Column) -> Column:
    c = F.substring(line, -1, 1)
    return F.when(c.rlike("\\p{L}"), "a").when(c.rlike("\\p{N}"), "#").otherwise(c)


def page_lines(snapshot: DataFrame) -> DataFrame:
    """The non-empty lines of the distinct texts of current rows: host ('' if unknown), docid, fp, subs, line_no, nodes, parts.

    ``nodes`` are hashes of the line's content, its shape after the first word, and its shape. ``parts`` are, for the whole line and for
    what follows its first one to ``LABEL_WORDS`` words (as long as three words are left), the tag, a hash of the opening (two words) and a hash
    of the words before. No text is kept.
    """
    t = current_texts(snapshot).filter("text is not null")
    own = F.transform("seen", lambda s: F.coalesce(s["host"], F.lit("")))
    t = t.select("docid", "fp", "text", "seen", F.explode(F.array_distinct(own)).alias("host"))
    subs = F.transform(F.filter("seen", lambda s: F.coalesce(s["host"], F.lit("")) == F.col("host")), lambda s: s["sub_collection"])
    flat = t.select(*_PAGE, subs.alias("subs"), F.posexplode(F.split(nfc(F.col("text")), "\n")).alias("p", "raw"))
    line = F.translate(squeeze(F.col("raw")), "’;", "',")
    flat = flat.select(*_PAGE, "subs", (F.col("p") + 1).alias("line_no"), F.replace(line, F.lit(" ,"), F.lit(",")).alias("line")).filter("line <> ''")
    flat = flat.withColumn("shape", _shape(F.col("line"), F.col("line") == F.upper("line"))).withColumn("content", _figures(F.lower("line")))
    flat = flat.withColumn("raw", F.split("line", " ")).withColumn("word", F.split("content", " ")).withColumn("last", _last_kind(F.col("line")))
    first_word = F.element_at("word", 1)
    template = F.concat(first_word, F.regexp_replace("shape", "^\\S+", ""))

    def part(k: int) -> Column:
        tag = F.concat(_first_kind(F.get("raw", F.lit(k))), "last")
        return F.struct(tag.alias("tag"), F.xxhash64(F.slice("word", k + 1, 2)).alias("op"), F.xxhash64(F.slice("word", 1, k)).alias("pre"))

    parts = F.filter(F.array(part(0), *(F.when(F.size("word") >= k + 3, part(k)) for k in range(1, LABEL_WORDS + 1))), lambda x: x.isNotNull())
    nodes = F.array(F.xxhash64(F.lit("c"), "content"), F.xxhash64(F.lit("t"), template), F.xxhash64(F.lit("s"), "shape"))
    return flat.select(*_PAGE, "subs", "line_no", nodes.alias("nodes"), parts.alias("parts"))


def furniture_nodes(lines: DataFrame) -> DataFrame:
    """host, node: nodes of fewer than ``MIN_BITS`` bits.

    n of a host's m pages have the node; the others' share is (n - 1) / (m - 1). The composite share of a node is the mean of its
    hosts' shares, weighted by its pages there; for each host it is taken without the host itself. Pages without a host have the other hosts' share only.
    Counts are distinct docids in two steps with partial sums; keys are (host, node), so a host of a third of all pages is spread over its nodes.
    """
    pages = lines.select("host", "docid").distinct().groupBy("host").agg(F.count("*").alias("m"))
    n = lines.select("host", "docid", F.explode("nodes").alias("node")).distinct().groupBy("host", "node").agg(F.count("*").alias("n"))
    n = n.join(pages, "host").withColumn("known", F.col("host") != "")
    n = n.withColumn("own", F.when(F.col("known"), F.col("n") - 1).otherwise(0)).withColumn("of", F.when(F.col("known"), F.col("m") - 1).otherwise(0))
    n = n.withColumn("k", F.when(F.col("known"), F.col("n")).otherwise(0)).withColumn("w", F.when(F.col("of") > 0, F.col("k") * F.col("own") / F.col("of")).otherwise(0.0))
    n = materialize(n.select("host", "node", "own", "of", "k", "w"), "p3-nodes")
    composite = n.groupBy("node").agg(F.sum("w").alias("w_all"), F.sum("k").alias("k_all")).filter("w_all > 0")
    x = n.join(composite, "node")
    others = F.when(F.col("k_all") > F.col("k"), (F.col("w_all") - F.col("w")) / (F.col("k_all") - F.col("k"))).otherwise(0.0)
    share = (F.col("own") + PRIOR_PAGES * others) / (F.col("of") + PRIOR_PAGES)
    return x.filter(-F.log2(share) < MIN_BITS).select("host", "node")


def _likelihoods(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How much likelier tags and openings are in heads than in bodies: tags (tag, unseen) and openings (tag, op, bits), positive tags only.

    Counts are of distinct contents per host, so that neither copies of a page nor near copies count again. ``unseen`` are the bits of an
    opening that no whole line of the tag has.
    """
    one = rest.select("host", F.element_at("nodes", 1).alias("content"), "head", F.element_at("parts", 1).alias("x")).distinct()
    o = one.groupBy("x.tag", "x.op").agg(F.count(F.when(F.col("head"), 1)).alias("h"), F.count(F.when(~F.col("head"), 1)).alias("b"))
    o = materialize(o, "p3-openings")
    t = o.groupBy("tag").agg(F.sum("h").alias("heads"), F.sum("b").alias("bodies"), F.count(F.when(F.col("h") > 0, 1)).alias("head_ops"), F.count(F.when(F.col("b") > 0, 1)).alias("body_ops"))
    all_heads, all_bodies = o.agg(F.sum("h")).scalar(), o.agg(F.sum("b")).scalar()
    t = t.withColumn("of_tag", F.log2((F.col("heads") + 0.5) / (all_heads + 1)) - F.log2((F.col("bodies") + 0.5) / (all_bodies + 1))).filter("heads > 0 and of_tag > 0")

    def bits(h: Column, b: Column) -> Column:
        kinds = F.col("head_ops") + F.col("body_ops") + 1
        ph = F.when(h > 0, h).otherwise(F.col("head_ops") / kinds) / (F.col("heads") + F.col("head_ops"))
        pb = F.when(b > 0, b).otherwise(F.greatest(F.col("body_ops"), F.lit(1)) / kinds) / F.greatest(F.col("bodies") + F.col("body_ops"), F.lit(1))
        return F.col("of_tag") + F.log2(ph) - F.log2(pb)

    tags = materialize(t.withColumn("unseen", bits(F.lit(0), F.lit(0))), "p3-tags")
    return tags.select("tag", "unseen"), o.join(tags, "tag").select("tag", "op", bits(F.col("h"), F.col("b")).alias("bits"))


def _scored(parts: DataFrame, tags: DataFrame, openings: DataFrame) -> DataFrame:
    """Adds ``alike`` (likelier in a head) to rows with tag and op; rows of a tag that is likelier in bodies fall out."""
    x = parts.join(tags, "tag").join(openings, ["tag", "op"], "left")
    return x.withColumn("alike", F.coalesce("bits", "unseen") > 0).drop("bits", "unseen")


def labels(rest: DataFrame, tags: DataFrame, openings: DataFrame) -> DataFrame:
    """pre: prefixes of body lines whose continuations are mostly heads, with at least ``LABEL_BITS`` of entropy over their openings.

    A line that is itself likelier a head has no label.
    """
    one = rest.filter("not head").select("host", F.element_at("nodes", 1).alias("content"), "parts").distinct()
    one = one.select("parts", F.element_at("parts", 1).alias("x")).select("parts", "x.tag", "x.op")
    known = openings.filter("bits > 0").select("tag", "op")
    flat = one.join(known, ["tag", "op"], "left_anti").select(F.inline(F.slice("parts", 2, LABEL_WORDS)))
    seen = flat.groupBy("pre", "tag", "op").agg(F.count("*").alias("n"))
    scored = _scored(seen, tags, openings).select("pre", "op", "n", F.when(F.col("alike"), F.col("n")).otherwise(0).alias("a"))
    every = seen.groupBy("pre", "op").agg(F.sum("n").alias("n")).groupBy("pre").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("n_log_n"))
    heads = scored.groupBy("pre").agg(F.sum("a").alias("alike"))
    x = heads.filter("alike > 0").join(every, "pre")
    return x.filter((F.col("alike") > 0.5 * F.col("total")) & (F.log2("total") - F.col("n_log_n") / F.col("total") > LABEL_BITS)).select("pre")


def classified_pages(snapshot: DataFrame) -> DataFrame:
    """host, docid, fp, subs, gone (sorted line numbers): the non-empty lines of each page that are not main body.

    Of the head-like lines before the first body line the last is the headline; labels with what they point to and all other head-like lines are cut.
    """
    lines = materialize(page_lines(snapshot), "p3-lines")
    low = materialize(furniture_nodes(lines), "p3-furniture")
    flat = lines.select(*_PAGE, "line_no", F.explode("nodes").alias("node")).join(low, ["host", "node"], "left_semi")
    noise = flat.groupBy(*_PAGE).agg(F.collect_set("line_no").alias("noise"))
    kept = F.array_sort(F.collect_list(F.struct("line_no", "nodes", "parts")))
    pages = lines.groupBy(*_PAGE).agg(F.first("subs").alias("subs"), kept.alias("all")).join(noise, _PAGE, "left")
    noise_of = F.coalesce("noise", F.array().cast("array<int>"))
    pages = pages.select(*_PAGE, "subs", noise_of.alias("noise"), F.filter("all", lambda s: ~F.array_contains(noise_of, s["line_no"])).alias("rest"))
    pages = materialize(pages, "p3-pages")
    rest = pages.select(*_PAGE, F.posexplode("rest").alias("p", "s")).select(*_PAGE, (F.col("p") == 0).alias("head"), "s.*")
    tags, openings = _likelihoods(rest)
    openings = materialize(openings, "p3-bits")
    label = materialize(labels(rest, tags, openings), "p3-labels")
    parts = rest.select(*_PAGE, "line_no", F.posexplode("parts").alias("k", "s")).select(*_PAGE, "line_no", "k", "s.*")
    scored = _scored(parts, tags, openings).filter("alike").join(label.withColumn("label", F.lit(True)), "pre", "left")
    hits = scored.filter("k = 0 or label").groupBy(*_PAGE).agg(
        F.collect_set(F.when(F.col("k") == 0, F.col("line_no"))).alias("like"), F.collect_set(F.when(F.col("k") > 0, F.col("line_no"))).alias("pointers")
    )
    x = pages.join(hits, _PAGE, "left")
    none = F.array().cast("array<int>")
    x = x.withColumn("like", F.coalesce("like", none)).withColumn("pointers", F.array_except(F.coalesce("pointers", none), "like"))
    body = F.filter(F.transform("rest", lambda s: s["line_no"]), lambda n: ~F.array_contains("like", n) & ~F.array_contains("pointers", n))
    x = x.withColumn("body", F.coalesce(F.array_min(body), F.lit((1 << 31) - 1)))
    x = x.withColumn("title", F.array_max(F.filter("like", lambda n: n < F.col("body"))))
    gone = F.array_union(F.array_union("noise", "pointers"), F.filter("like", lambda n: n != F.coalesce("title", F.lit(0))))
    return x.select(*_PAGE, "subs", F.array_sort(gone).alias("gone"))


def furniture_lines(snapshot: DataFrame) -> DataFrame:
    """sub_collection, docid, line_no of the non-empty lines that are not main body. Null and blank texts and empty tables give none."""
    return classified_pages(snapshot).select(F.explode("subs").alias("sub_collection"), "docid", "gone").select("sub_collection", "docid", F.explode("gone").alias("line_no"))


def main_content(snapshot: DataFrame) -> DataFrame:
    """sub_collection, docid, text: each current row with only its headline and the article's own lines, in order.

    A row without such lines gives ''; null text stays null.
    """
    gone = classified_pages(snapshot).select(F.explode("subs").alias("sub_collection"), "docid", "gone")
    rows = current_texts(snapshot).select("docid", "text", F.inline("seen")).join(gone, ["sub_collection", "docid"], "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: (squeeze(line) != "") & ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return rows.select("sub_collection", "docid", F.array_join(kept, "\n").alias("text"))
