"""Near-duplicate texts by SetSketch: registers, bands, joint estimation by likelihood, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import materialize

_U = np.uint64


@dataclass(frozen=True)
class SketchParams:
    """m registers with base b and rate a, values 0..q+1; bands of ``rows`` registers each.

    With b near 1 two registers are equal with a probability just above the Jaccard similarity, as for minima that
    are kept in full. 64 bands of 4 registers miss a pair of similarity 0.6 with probability (1 - 0.6**4)**64 = 0.00014.
    """

    shingle: int = 3
    threshold: float = 0.6
    bands: int = 64
    rows: int = 4
    b: float = 1.001
    a: float = 20.0
    q: int = (1 << 16) - 2
    #: A candidate is verified if its estimate is within so many standard errors of the threshold.
    slack: float = 5.0
    #: Texts of one band that a task compares with the band's others; a band of more is split.
    split: int = 1000

    @property
    def m(self) -> int:
        return self.bands * self.rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (murmur3's)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_hashes(word_hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of texts given as flat word hashes with offsets, and the shingles' offsets.

    Every text must have at least k words.
    """
    h = word_hashes.view(_U) if word_hashes.dtype != _U else word_hashes
    n = len(h) - k + 1
    s = np.zeros(n, _U)
    for i in range(k):
        s = mix64(s + h[i : i + n])
    inside = np.ones(n, bool)
    for i in range(1, k):
        cut = offsets[1:-1] - i
        inside[cut[cut < n]] = False
    starts = offsets - (k - 1) * np.arange(len(offsets))
    return s[inside], starts


def _multipliers(m: int) -> np.ndarray:
    return mix64(np.arange(1, m + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def registers(shingles: np.ndarray, starts: np.ndarray, p: SketchParams) -> np.ndarray:
    """SetSketch registers (texts x m, uint16) of sets of shingle hashes laid end to end.

    Register j of a set is floor(1 - log_b(min h_j)) cut to 0..q+1, with h_j(d) exponential of rate a. An
    exponential is a growing function of a uniform number, so the minimum is taken over hashes and put through
    the logarithm once per register. Repeated shingles change nothing; the maximum of two sketches is the sketch of the union.
    """
    out = np.empty((len(starts), p.m), np.uint16)
    log_b = np.log(p.b)
    for j, c in enumerate(_multipliers(p.m)):
        x = shingles * c
        x ^= x >> _U(32)
        x *= _U(0x9E3779B97F4A7C15)
        low = np.minimum.reduceat(x, starts)
        u = (low.astype(np.float64) + 1.0) / 18446744073709551618.0
        h = -np.log1p(-u) / p.a
        out[:, j] = np.clip(np.floor(1.0 - np.log(h) / log_b), 0, p.q + 1)
    return out


def estimate_jaccard(up: np.ndarray, down: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, b: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the numbers of larger, smaller and equal registers and the set sizes."""
    total = n_a + n_b
    u, v = n_a / total, n_b / total
    top = np.minimum(u / v, v / u)
    lb = np.log(b)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (b - 1) / b) / lb

    def loss(j: np.ndarray) -> np.ndarray:
        gt, lt = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return -(up * np.log(gt + tiny) + down * np.log(lt + tiny) + same * np.log(np.maximum(1 - gt - lt, tiny)))

    low, high = np.zeros_like(top), top.copy()
    g = (np.sqrt(5.0) - 1) / 2
    for _ in range(30):  # the likelihood has one maximum in [0, top]
        x, y = high - g * (high - low), low + g * (high - low)
        left = loss(x) < loss(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list<long> column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def _sketches(p: SketchParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values, offsets = _flat(b.column("words"))
            shingles, starts = shingle_hashes(values, offsets, p.shingle)
            size = np.array([len(np.unique(shingles[s:e])) for s, e in zip(starts[:-1], starts[1:])], np.int32)
            reg = registers(shingles, starts[:-1], p)
            keys = mix64(np.arange(1, p.bands + 1, dtype=_U))[None, :].repeat(len(reg), 0)
            for r in range(p.rows):
                keys = mix64(keys + reg[:, r :: p.rows].astype(_U))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * p.m), len(reg), [None, pa.py_buffer(reg.tobytes())])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, p.bands), pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mask"), pa.array(size), raw.cast(pa.binary()), bands], ["id", "mask", "size", "sketch", "bands"])

    return run


def sketch(texts: DataFrame, p: SketchParams) -> DataFrame:
    """id, mask, size (distinct shingles), sketch (m 16-bit registers), bands (array of band keys) of (id, mask, words array<bigint>)."""
    return texts.mapInArrow(_sketches(p), "id bigint, mask bigint, size int, sketch binary, bands array<bigint>")


def band_pairs(sketches: DataFrame, p: SketchParams) -> DataFrame:
    """a, b: distinct pairs (a < b) that agree in a whole band, share a bit of their masks and may reach the threshold by their sizes.

    A similarity is at most the smaller size by the larger, so no pair is lost. A band's texts are counted; where there are more than ``split``, one
    side is cut into parts of about that many texts and the other goes to all of them, so that a band of a third of all texts is spread over as many tasks
    as it needs. All pairs of a band are looked at, none is dropped for its band's size.
    """
    flat = sketches.select("id", "mask", "size", F.explode("bands").alias("band"))
    hot = flat.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > p.split).select("band", F.ceil(F.col("n") / p.split).cast("int").alias("parts"))
    flat = flat.join(materialize(hot, "hot-bands"), "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    side = lambda s, part: flat.select("band", F.col("id").alias(s), F.col("mask").alias(f"mask_{s}"), F.col("size").alias(f"size_{s}"), part.alias("part"))
    left = side("a", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    close = F.least("size_a", "size_b") >= F.lit(p.threshold) * F.greatest("size_a", "size_b")
    pairs = left.join(right, ["band", "part"]).filter("a < b").filter(close & (F.col("mask_a").bitwiseAND(F.col("mask_b")) != 0))
    return pairs.select("a", "b").distinct()


def _estimates(p: SketchParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, p.m) for c in ("sketch_a", "sketch_b"))
            up, down = (x > y).sum(1), (x < y).sum(1)
            n_a, n_b = b.column("size_a").to_numpy().astype(float), b.column("size_b").to_numpy().astype(float)
            est = estimate_jaccard(up, down, p.m - up - down, n_a, n_b, p.b)
            ok = est >= p.threshold - p.slack * np.sqrt(p.threshold * (1 - p.threshold) / p.m)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(est)], ["a", "b", "estimate"]).filter(pa.array(ok))

    return run


def _verify(p: SketchParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sides = []
            for c in ("words_a", "words_b"):
                values, offsets = _flat(b.column(c))
                sides.append(shingle_hashes(values, offsets, p.shingle))
            (sa, ia), (sb, ib) = sides
            sim = np.empty(b.num_rows)
            for k in range(b.num_rows):
                x, y = np.unique(sa[ia[k] : ia[k + 1]]), np.unique(sb[ib[k] : ib[k + 1]])
                common = len(np.intersect1d(x, y, assume_unique=True))
                sim[k] = common / (len(x) + len(y) - common)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim)], ["a", "b", "similarity"])
            yield out.filter(pa.array(sim >= p.threshold))

    return run


def similar_texts(texts: DataFrame, p: SketchParams) -> DataFrame:
    """a, b, similarity of all pairs of distinct texts (id, mask, words array<bigint>) that reach the threshold and share a bit of their masks; a < b.

    Ids must be unique and every text must have at least ``shingle`` words. Candidates are pairs that agree in a whole
    band of registers (see ``band_pairs``). Only the candidates whose joint likelihood estimate comes near the threshold have their words fetched.
    """
    sk = materialize(sketch(texts.select("id", "mask", "words"), p), "sketch")
    pairs = materialize(band_pairs(sk, p), "candidates")
    full = lambda s: sk.select(F.col("id").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("size").alias(f"size_{s}"))
    near = pairs.join(full("a"), "a").join(full("b"), "b").mapInArrow(_estimates(p), "a bigint, b bigint, estimate double")
    near = materialize(near, "near")
    body = lambda s: texts.select(F.col("id").alias(s), F.col("words").alias(f"words_{s}"))
    both = near.select("a", "b").join(body("a"), "a").join(body("b"), "b")
    return both.mapInArrow(_verify(p), "a bigint, b bigint, similarity double")
