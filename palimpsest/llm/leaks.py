"""Held-out passages inside training text, by suffix arrays over shards of the training tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import nfd
from palimpsest.operators.lineage import materialize

#: Tokens of training text for one suffix array; a longer document has an array of its own.
SHARD = 1 << 19
#: Words of held-out text that are searched for at once; more are searched for in further passes.
BLOCK = 1 << 21
#: Candidate pairs that are compared at once.
_CHUNK = 1 << 20


def leak_words(c: Column) -> Column:
    """NFD without combining marks, lower case, longest runs of letters and digits; null gives an empty array."""
    parts = F.split(F.lower(F.regexp_replace(nfd(F.coalesce(c, F.lit(""))), "\\p{M}+", "")), "[^\\p{L}\\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _word_hashes(c: Column) -> Column:
    return F.transform(leak_words(c), lambda w: F.xxhash64(w))


def suffix_ranks(tokens: np.ndarray, longest: int, at: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes up to the next break (0) or ``longest`` tokens, by prefix doubling: equal suffixes have equal ranks, breaks rank 0.

    Beside them the ranks by the first ``at`` tokens, a power of two.
    """
    n = len(tokens)
    rank = np.unique(np.concatenate(([0], tokens)), return_inverse=True)[1][1:].astype(np.int64)
    to_break = np.flatnonzero(np.append(tokens, 0) == 0)
    left = to_break[np.searchsorted(to_break, np.arange(n))] - np.arange(n)
    depth, early = 1, rank
    while depth < max(longest, at) and (left > depth).any():
        second = np.zeros(n, np.int64)
        more = np.flatnonzero(left > depth)
        second[more] = rank[more + depth]
        key = rank * (n + 2) + second
        rank = np.unique(np.concatenate(([0], key)), return_inverse=True)[1][1:].astype(np.int64)
        depth *= 2
        if depth == at:
            early = rank
    return rank, early if depth >= at else rank


def _long_runs(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the runs without a break that have at least ``depth`` tokens, each run with the break behind it. ``tokens`` end in a break."""
    ends = np.flatnonzero(tokens == 0)
    starts = np.concatenate(([0], ends[:-1] + 1))
    keep = ends - starts >= depth
    mark = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(mark, starts[keep], 1)
    np.add.at(mark, ends[keep] + 1, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _extend(a: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Length of the longest common run of a at i and at j, known to be at least n; breaks end it and a ends in one."""
    length = np.full(len(i), n, np.int64)
    live = np.arange(len(i))
    while len(live):
        x = a[i[live] + length[live]]
        live = live[(x != 0) & (x == a[j[live] + length[live]])]
        length[live] += 1
    return length


def _starts(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with at least ``depth`` tokens before the next break."""
    breaks = np.concatenate(([0], np.cumsum(ids == 0)))
    ok = np.zeros(len(ids), bool)
    if len(ids) >= depth:
        ok[: len(ids) - depth + 1] = breaks[depth:] == breaks[:-depth]
    return np.flatnonzero(ok)


class _Items:
    """The held-out side: sorted vocabulary of word hashes, tokens (1 + place in the vocabulary, breaks 0), item and offset of each token."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.empty(0, np.int64)
        ends = [0]
        self.tokens = np.concatenate([np.append(np.searchsorted(self.vocabulary, h) + 1, ends) for _, h in items])
        self.owner = np.concatenate([np.full(len(h) + 1, k) for k, (_, h) in enumerate(items)])
        self.offset = np.concatenate([np.arange(len(h) + 1) for _, h in items])
        self.ids = np.array([i for i, _ in items], np.int64)
        self.longest = max(len(h) for _, h in items)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _match(docs: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, held: _Items, depth: int) -> pa.RecordBatch:
    """The longest match of each document of a shard with each item: one suffix array over both, every held-out suffix searched for in it."""
    kept = _long_runs(tokens, depth)
    joint = np.concatenate((tokens[kept], held.tokens))
    split = len(kept)
    power = 1 << (depth.bit_length() - 1)
    rank, early = suffix_ranks(joint, held.longest, power)
    start = _starts(joint, depth)
    key = early[start] * (len(joint) + 2) + early[start + depth - power]
    group = np.unique(key, return_inverse=True)[1]  # suffixes of one group lie side by side in the suffix array
    i, gi = start[start < split], group[start < split]
    j, gj = start[start >= split], group[start >= split]
    owner = held.owner[j - split]
    # each item's suffixes in the order of the suffix array
    pair = gj * (len(held.ids) + 1) + owner
    order = np.lexsort((rank[j], pair))
    j, pair, owner, gj = j[order], pair[order], owner[order], gj[order]
    kinds, first = np.unique(pair, return_index=True)
    kind_of = np.searchsorted(kinds, pair)
    place = kind_of * (len(joint) + 1) + rank[j]
    # the items of each group
    kg = gj[first]
    low, high = np.searchsorted(kg, gi, "left"), np.searchsorted(kg, gi, "right")
    live = high > low
    i, low, n = i[live], low[live], (high - low)[live]
    doc_of = np.searchsorted(bounds, kept[i], "right") - 1
    out = []
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(n) // _CHUNK)) + 1, [len(n)]))
    for a, z in zip(cuts[:-1], cuts[1:]):
        m = n[a:z]
        row = np.repeat(np.arange(a, z), m)
        kind = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + low[row]
        at = np.searchsorted(place, kind * (len(joint) + 1) + rank[i[row]])
        for near in (at - 1, at):  # binary search: the longest match of a suffix is beside its place
            ok = (near >= 0) & (near < len(j))
            ok[ok] = kind_of[near[ok]] == kind[ok]
            x, y = i[row[ok]], j[near[ok]]
            whole = (x == 0) | (y == split) | (joint[x - 1] == 0) | (joint[x - 1] != joint[y - 1])  # a match that goes on to the left starts there
            x, y, d = x[whole], y[whole], doc_of[row[ok]][whole]
            length = _extend(joint, x, y, depth)
            o = held.owner[y - split]
            best = np.lexsort((held.offset[y - split], x, -length, o, d))
            new = np.ones(len(best), bool)
            new[1:] = (d[best][1:] != d[best][:-1]) | (o[best][1:] != o[best][:-1])
            out.append(np.stack([c[best][new] for c in (d, o, length, x, y)]))
    d, o, length, x, y = np.concatenate(out, 1) if out else np.empty((5, 0), np.int64)
    best = np.lexsort((x, -length, o, d))
    new = np.ones(len(best), bool)
    new[1:] = (d[best][1:] != d[best][:-1]) | (o[best][1:] != o[best][:-1])
    d, o, length, x, y = (c[best][new] for c in (d, o, length, x, y))
    item_start = np.searchsorted(held.owner, o) + split
    for k in range(len(y)):  # the earliest place in the item of a passage that it holds more than once
        words = joint[x[k] : x[k] + length[k]]
        where = np.flatnonzero(joint[item_start[k] : y[k]] == words[0]) + item_start[k]
        y[k] = next((p for p in where if np.array_equal(joint[p : p + length[k]], words)), y[k])
    cols = [docs[d], held.ids[o], length, kept[x] - bounds[d], held.offset[y - split]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "words", "doc_word", "item_word"])


def _search(items: list[tuple[int, np.ndarray]], depth: int, shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Items(items)
        docs, parts, sizes, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            size = np.concatenate(sizes) + 1
            return _match(np.concatenate(docs), np.concatenate(parts), np.cumsum(size) - size, held, depth)

        for b in batches:
            if not b.num_rows:
                continue
            words = b.column("words")
            offsets = words.offsets.to_numpy().astype(np.int64)
            values = held.look_up(words.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
            size, offsets = np.diff(offsets), offsets - offsets[0]
            ids, at = b.column("doc_id").to_numpy(), 0
            while at < b.num_rows:  # as many documents as fill the shard
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + shard - total, "right")) - 1)
                flat = np.zeros(offsets[end] - offsets[at] + end - at, np.int64)
                flat[np.arange(offsets[end] - offsets[at]) + np.repeat(np.arange(end - at), size[at:end])] = values[offsets[at] : offsets[end]]
                docs.append(ids[at:end])
                parts.append(flat)
                sizes.append(size[at:end])
                total += len(flat)
                at = end
                if total >= shard:
                    yield flush()
                    docs, parts, sizes, total = [], [], [], 0
        if docs:
            yield flush()

    return run


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, words, doc_word, item_word: the longest verbatim match of each document with each item.

    A match has at least ``min_words`` words; doc_word and item_word are the positions of its first word, the
    earliest of equally long ones. Words are split and hashed (64 bits) in the JVM. Words out of the held-out vocabulary break a shard's text; what is left between breaks
    is put in full suffix order, by prefix doubling, together with the held-out suffixes, and every suffix is searched for among those of each item it shares
    ``min_words`` words with: the longest match is beside its place. Matches that go on to the left are dropped before they are measured, so that a page of one
    word repeated costs no more than others. Training text is read once and never shuffled. Held-out text goes to the tasks in blocks of at most ``block`` words,
    each searched for in a pass of its own whose result is written before the next block is read: neither the driver nor a
    task ever holds more than one block, whatever the size of the table (a single item is never split). Null and empty texts, and items under ``min_words`` words, match nothing; equal items each match.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, words bigint, doc_word bigint, item_word bigint"
    slim = documents.filter("doc_id is not null and text is not null").select("doc_id", _word_hashes(F.col("text")).alias("words")).filter(F.size("words") >= min_words)
    texts = items.filter("item_id is not null and text is not null").select("item_id", _word_hashes(F.col("text")).alias("words")).filter(F.size("words") >= min_words).distinct()
    group: list[tuple[int, np.ndarray]] = []
    size, out = 0, spark.createDataFrame([], schema)
    for r in texts.orderBy("item_id", "words").toLocalIterator():
        if group and size + len(r.words) > block:
            out = out.unionByName(materialize(slim.mapInArrow(_search(group, min_words, shard), schema), "p7-block"))
            group, size = [], 0
        group.append((r.item_id, np.array(r.words, np.int64)))
        size += len(r.words)
    if not group:
        return out
    found = out.unionByName(slim.mapInArrow(_search(group, min_words, shard), schema))
    return found.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("words", "doc_word", "item_word"), F.struct(-F.col("words"), "doc_word", "item_word")).alias("x")).select("doc_id", "item_id", "x.*")


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no passage."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
