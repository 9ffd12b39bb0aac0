"""Texts that break off inside a word or a sentence: a stack automaton over the whole text, and baselines of endings learned per source.

All of it stays in the JVM: the automaton folds over the marks of a text, endings are string functions of its last line. What an ending means is learned
from the texts themselves. A last line stands in a tree of its beginnings (kind of its first character, one word, two, three, the whole line);
each node has the share of its texts that end without a terminator, smoothed with the share of the node above it, first over all
sources, then in the text's own. A text without a terminator is whole where such lines end so, and cut where they do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import source_name
from palimpsest.operators.lineage import materialize

#: Weight of the node above in a share, in texts.
PRIOR_TEXTS = 5
#: Share of whole endings assumed for a last word that no text has ended or broken off with.
UNSEEN_ENDS = 0.75
#: Share of a source's texts with exactly one size from which the size is a limit, and weight of the null share, in texts.
LIMIT_SHARE, LIMIT_TEXTS = 0.03, 20
#: Brackets and quotes that open, with what closes them.
PAIRS = {"«": "»", "“": "”", "(": ")", "[": "]", "{": "}"}
#: Elements of HTML that have no end tag, or may leave it out.
_UNPAIRED = "area base br col embed hr img input link meta source track wbr p li dt dd option tr td th thead tbody tfoot colgroup".split()
_MARK = '[«»“”()\\[\\]{}"\\n]|</?[A-Za-z][A-Za-z0-9]*(?:\\s[^<>]*)?>|<[/!]?(?:[A-Za-z][^<>]*)?$'
_ELLIPSIS = "(?:\\[\\s*(?:\\.\\.\\.|…)\\s*\\]|\\(\\s*(?:\\.\\.\\.|…)\\s*\\)|\\.\\.\\.|…)$"
_BROKEN = "\\uFFFD$|(?:&#?[A-Za-z0-9]*|\\\\u[0-9A-Fa-f]{0,3}|\\\\x[0-9A-Fa-f]?|%[0-9A-Fa-f]?)$|(?:[\\p{L}][-\\u00AD]| -)$"
_ENDED = "[.!?][»”)\"' \\u00A0]*$"
_SPACE = "[\\s\\u00A0]+"
#: Levels of the tree of beginnings below the kind of the first character.
LEVELS = ("one", "two", "three", "line")


def open_marks(text: Column) -> Column:
    """What the automaton has open at the end of a text, outermost first, with line ends between marks of different lines.

    Brackets and quotes are paired by PAIRS, straight quotes with themselves, start tags with end tags of their name (elements without end
    tags and empty ones are passed over); a tag without its end stays open as "<". A closer takes with it what was left open inside; a stray
    closer is passed over.
    """

    def push(stack: Column, mark: Column) -> Column:
        return F.concat(stack, mark)

    def pop(stack: Column, opener: Column) -> Column:
        at = F.instr(F.reverse(stack), F.reverse(opener))
        return F.when(at == 0, stack).otherwise(F.substring(stack, F.lit(1), F.length(stack) - at - F.length(opener) + 1))

    openers, closers = "".join(PAIRS), "".join(PAIRS.values())

    def step(stack: Column, mark: Column) -> Column:
        name = F.lower(F.regexp_extract(mark, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
        symbol = F.when(name != "", F.concat(F.lit("<"), name, F.lit(">"))).otherwise(F.translate(mark, closers, openers))
        passed = ((mark == "\n") & ((stack == "") | F.endswith(stack, F.lit("\n")))) | name.isin(*_UNPAIRED) | F.endswith(mark, F.lit("/>"))
        closes = mark.isin(*PAIRS.values()) | F.startswith(mark, F.lit("</")) | ((mark == '"') & F.contains(stack, mark))
        unended = F.startswith(mark, F.lit("<")) & ~F.endswith(mark, F.lit(">"))
        return F.when(unended, push(stack, F.lit("<"))).when(passed, stack).when(closes, pop(stack, symbol)).otherwise(push(stack, symbol))

    marks = F.regexp_extract_all(text, F.lit(f"({_MARK})"), F.lit(1))
    return F.aggregate(marks, F.lit(""), step)


def _kind(c: Column) -> Column:
    return F.when(c.rlike("\\p{Lu}"), "A").when(c.rlike("\\p{L}"), "a").when(c.rlike("\\p{N}"), "0").otherwise(c)


def text_endings(documents: DataFrame) -> DataFrame:
    """One row per document with text that is not blank: its ending, size in characters and bytes, source, and a hash of the text; no text is kept.

    ending: '.' for a terminator (closing quotes and brackets may follow, or the whole line stands in such), '…' for an ellipsis, '' for
    neither. broken: half a character, tag or escape at the end, or a hyphen after a letter. open: the automaton has something open that was opened in the last
    line; before: in an earlier one. several: the last line holds more than one sentence. kind, one, two, three, line: its place in the tree
    (hashes, figures as one). last: hash of its last word, or of the mark it ends in.
    """
    body = F.regexp_replace("text", f"{_SPACE}$", "")
    d = documents.select("doc_id", source_name(F.col("source")).alias("name"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h"), body.alias("body"))
    d = d.filter("body <> ''").withColumn("stack", open_marks(F.col("body")))
    d = d.withColumn("line", F.regexp_replace(F.substring_index("body", "\n", -1), f"^{_SPACE}", "")).withColumn("inner", F.substring_index("stack", "\n", -1))
    line, low = F.col("line"), F.regexp_replace(F.lower("line"), "\\p{N}+", "0")
    words = F.split(low, _SPACE)
    core = F.regexp_replace("line", f"\\s*{_ELLIPSIS}", "")
    dots = line.rlike(_ELLIPSIS)
    enclosed = (F.col("inner") == "") & line.rlike('^[«“(\\["].*[»”)\\]"]$')
    ending = F.when(dots, "…").when(line.rlike(_ENDED) | enclosed, ".").otherwise("")
    last = F.regexp_extract(F.lower(core), "([\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}])$", 1)
    ended_word = F.regexp_extract(F.lower("line"), "([\\p{L}\\p{N}]+)[^\\p{L}\\p{N}]*$", 1)
    return d.select(
        "doc_id",
        "name",
        "chars",
        "bytes",
        "h",
        ending.alias("ending"),
        (line.rlike(_BROKEN) | F.endswith("inner", F.lit("<"))).alias("broken"),
        (F.col("inner") != "").alias("open"),
        F.contains("stack", F.lit("\n")).alias("before"),
        core.rlike("[.!?…]\\s+[^\\s»”)]").alias("several"),
        _kind(F.substring("line", 1, 1)).alias("kind"),
        *(F.xxhash64(F.slice(words, 1, k)).alias(n) for k, n in enumerate(LEVELS[:3], 1)),
        F.xxhash64(low).alias("line"),
        F.xxhash64(F.when(ending == ".", ended_word).otherwise(last)).alias("last"),
    )


def field_limits(texts: DataFrame) -> DataFrame:
    """name, unit, size: sizes at which a source cuts its texts.

    A size (in characters, or in bytes with up to 3 bytes less for half a character) that a share of ``LIMIT_SHARE`` of the source's other texts have
    as well (smoothed, so that few texts give no limit), most of them without a terminator. Sizes far less frequent than the source's most frequent one are
    echoes of it in the other unit.
    """
    one = texts.filter("name is not null")
    sizes = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))
    counts = one.select("name", (F.col("ending") != ".").cast("int").alias("u"), F.inline(sizes)).groupBy("name", "unit", "size").agg(F.count("*").alias("n"), F.sum("u").alias("u"))
    total = counts.groupBy("name").agg((F.sum("n") / 2).alias("all"), F.max("n").alias("most"))
    x = counts.filter("n > 1").join(total, "name")
    share = (F.col("n") - 1) / (F.col("all") - 1 + LIMIT_TEXTS)
    return x.filter((share >= LIMIT_SHARE) & (F.col("u") >= 0.5 * F.col("n")) & (F.col("n") >= 0.5 * F.col("most"))).select("name", "unit", "size")


def _at_limit(e: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``limit``: the text has the size at which its source cuts."""
    by = lambda u: limits.filter(F.col("unit") == u)
    e = e.join(by("chars").select("name", F.col("size").alias("chars"), F.lit(True).alias("_c")), ["name", "chars"], "left")
    near = by("bytes").select("name", F.explode(F.sequence(F.col("size") - 3, F.col("size"))).alias("bytes"), F.lit(True).alias("_b")).distinct()
    e = e.join(near, ["name", "bytes"], "left")
    return e.withColumn("limit", F.coalesce("_c", "_b", F.lit(False))).drop("_c", "_b")


def _counts(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("ending") == "", 1)).alias("u"), F.count(F.when(F.col("ending") == "…", 1)).alias("d"))


def usual(texts: DataFrame) -> DataFrame:
    """h, usual: for each text without a terminator, how usual its ending is for a last line like its own, from 0 to 1.

    Shares are those of the other texts, each level smoothed by the one above. First character and first word are counted over all texts, then in the
    text's own source. Texts at their source's limit count nowhere, so that a source that cuts much does not make its cuts usual.
    """
    open_ = texts.filter("ending <> '.'").select("h", "name", "ending", "several", "kind", *LEVELS, "limit")
    levels = [("r", ["several"]), ("k", ["several", "kind"])]
    free = texts.filter("not limit")
    for n, keys in levels:
        c = _counts(free, keys).select(*keys, F.struct("n", "u", "d").alias(n))
        open_ = open_.join(c, keys, "left")
    nodes = lambda df: F.array(*(F.struct(F.lit(i).alias("level"), F.xxhash64("several", n).alias("node")) for i, n in enumerate(LEVELS)))
    flat = free.select("ending", F.inline(nodes(free)))
    c = _counts(flat, ["level", "node"])
    deep = open_.select("h", F.inline(nodes(open_))).join(c, ["level", "node"])
    deep = deep.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("n", "u", "d")))).alias("deep"))
    open_ = open_.join(deep, "h", "left")
    free = free.filter("name is not null")
    for n, keys in (("sk", ["name", "several", "kind"]), ("so", ["name", "several", "one"])):
        open_ = open_.join(_counts(free, keys).select(*keys, F.struct("n", "u", "d").alias(n)), keys, "left")

    own = F.when(F.col("limit"), 0).otherwise(1)

    def blend(above: Column, node: Column) -> Column:
        same = F.when(F.col("ending") == "", node["u"]).otherwise(node["d"])
        return (F.coalesce(same - own, F.lit(0)) + PRIOR_TEXTS * above) / (F.coalesce(node["n"] - own, F.lit(0)) + PRIOR_TEXTS)

    deeper = [F.try_element_at("deep", F.lit(i)) for i in range(len(LEVELS))]
    path = [F.col("r"), F.col("k"), F.col("sk"), deeper[0], F.col("so"), *deeper[1:]]
    p = reduce(blend, path, F.lit(0.0))
    return open_.select("h", p.alias("usual"))


def cut_documents(documents: DataFrame) -> DataFrame:
    """doc_id, name, reason, cut for every document with text that is not blank.

    A text is cut if it ends in half a character, escape or tag (``broken``), if the automaton has something open that was opened in its last line, be it before a
    terminator (``open``), or if it has no terminator where such lines have one: reason ``limit`` at its source's size limit, ``ellipsis`` or
    ``unfinished``. A line that usually ends without a terminator is cut as well if its last word or mark is one that texts break off after but do not
    end with. Equal texts have one verdict, whatever their source: the first in the order of names decides. Null and blank texts give no row.
    """
    e = materialize(text_endings(documents), "p9-endings")
    texts = e.groupBy("h").agg(F.min_by(F.struct(*(c for c in e.columns if c not in ("doc_id", "h"))), F.struct(F.col("name").isNull(), "name", "doc_id")).alias("x")).select("h", "x.*")
    texts = materialize(texts, "p9-texts")
    texts = materialize(_at_limit(texts, materialize(field_limits(texts), "p9-limits")), "p9-sized")
    texts = materialize(texts.join(usual(texts), "h", "left"), "p9-usual")
    prose = F.col("usual") < 0.5
    words = texts.groupBy("last").agg(F.count(F.when(F.col("ending") == ".", 1)).alias("e"), F.count(F.when(prose & (F.col("ending") == ""), 1)).alias("u"))
    ends = (F.col("e") + PRIOR_TEXTS * UNSEEN_ENDS) / (F.col("e") + F.col("u") + PRIOR_TEXTS)
    dangling = words.filter(ends < 0.5).select("last", F.lit(True).alias("dangling"))
    texts = texts.join(dangling, "last", "left")
    reason = (
        F.when(F.col("broken"), "broken")
        .when(F.col("open"), "open")
        .when(F.col("ending") == ".", None)
        .when(prose, F.when(F.col("ending") == "…", "ellipsis").when(F.col("limit"), "limit").otherwise("unfinished"))
        .when((F.col("ending") == "") & F.col("dangling"), "unfinished")
    )
    out = e.select("doc_id", "name", "h").join(texts.select("h", reason.alias("reason")), "h")
    return out.select("doc_id", "name", "reason", F.col("reason").isNotNull().alias("cut"))


def cut_report(verdicts: DataFrame) -> DataFrame:
    """source, documents, cut, share: how often each source cuts its texts; a null source is a row of its own."""
    out = verdicts.groupBy(F.col("name").alias("source")).agg(F.count("*").alias("documents"), F.sum(F.col("cut").cast("bigint")).alias("cut"))
    return out.withColumn("share", F.col("cut") / F.col("documents"))
