"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from palimpsest.llm.near_duplicates import components, page_groups, similar_pages
from palimpsest.llm.setsketch import SketchParams, band_pairs, estimate_jaccard, registers

WORDS = [f"mot{i}" for i in range(400)]


def shingles(text, k=3):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def pages(seed=5):
    """Families of edited texts, exact copies, short, empty and null texts, a very long text and its edit."""
    rng = random.Random(seed)
    rows, doc = [], 0
    for family in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(10, 120))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                cut = rng.randrange(len(w))
                w = w[cut:] + w[:cut]
            doc += 1
            rows.append((f"doc{doc}", f"2023-0{rng.randint(1, 2)}", " ".join(w), None, 1))
    long = [rng.choice(WORDS) for _ in range(20_000)]
    rows += [("doc900", "2023-01", " ".join(long), None, 1), ("901", "2023-01", " ".join(long[:-500]), None, 1)]
    for d, t in ((910, "Un deux  TROIS quatre"), (911, "un deux trois, quatre"), (912, "un deux trois quatre"), (913, "un deux"), (914, ""), (915, None), (916, "a b c")):
        rows.append((f"doc{d}", "2023-01", t, None, 1))
    rows += [rows[0], rows[1]]
    return rows


def brute(rows, threshold=0.6):
    import re

    now = {(int(re.sub("[^0-9]", "", d)), s): " ".join(re.findall(r"\w+", (t or "").lower())) for d, s, t, _, _ in rows}
    sets = {k: shingles(v) for k, v in now.items()}
    out = set()
    for (a, s), x in sets.items():
        for (b, r), y in sets.items():
            if s == r and a < b and x and y and len(x & y) >= threshold * len(x | y):
                out.add((s, a, b))
    return out, {k for k, v in sets.items() if v}


def test_pairs_against_brute_force(snapshot):
    rows = pages()
    want, _ = brute(rows)
    got = similar_pages(snapshot(rows)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == want and len(want) > 30


def test_groups_and_links(snapshot):
    rows = pages(6)
    want, nodes = brute(rows)
    root = {n: n[0] for n in nodes}
    links = dict.fromkeys(nodes, 0)
    for s, a, b in want:
        links[a, s] += 1
        links[b, s] += 1
    for _ in range(20):
        for s, a, b in want:
            root[a, s] = root[b, s] = min(root[a, s], root[b, s])
    got = {(r.docid, r.sub_collection): (r.group_id, r.links) for r in page_groups(snapshot(rows)).collect()}
    assert got == {n: (root[n], links[n]) for n in nodes}


def test_empty_tables(snapshot):
    assert similar_pages(snapshot([])).count() == 0
    assert page_groups(snapshot([])).count() == 0
    assert similar_pages(snapshot([("1", "2023-01", None, None, None), ("2", "2023-01", "", None, 1)])).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([("a", i, i + 1) for i in range(60)] + [("b", 7, 7), ("b", 9, 4)], "part string, u bigint, v bigint")
    got = {(r.part, r.node): r.root for r in components(edges, "part").collect()}
    assert got == {("a", i): 0 for i in range(61)} | {("b", 4): 4, ("b", 9): 4}


@pytest.mark.parametrize("j", [0.3, 0.6, 0.9])
def test_joint_estimate(j):
    p, rng, n = SketchParams(), np.random.default_rng(1), 400
    est = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
        c = round(2 * n * j / (1 + j))
        r = registers(np.concatenate([x[:n], x[:c], x[n : 2 * n - c]]), np.array([0, n]), p)
        up, down = (r[0] > r[1]).sum(), (r[0] < r[1]).sum()
        est.append(estimate_jaccard(*(np.array([float(v)]) for v in (up, down, p.m - up - down, n, n)), p.b)[0])
    assert abs(np.mean(est) - j) < 0.02


def test_sketches_merge():
    p, rng = SketchParams(), np.random.default_rng(2)
    x = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    parts = registers(np.concatenate([x[:200], x[100:]]), np.array([0, 200]), p)
    assert (parts.max(0) == registers(x, np.array([0]), p)[0]).all()


def test_a_hot_band_is_split_and_whole(spark):
    """1 500 texts in one band, in parts of 100: every pair that sizes and masks allow, once."""
    rows = [(k, 1 << (k % 3) | 8 * (k % 2), 10 + k % 40, [7, 100 + k % 5]) for k in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, mask bigint, size int, bands array<bigint>")
    got = {tuple(r) for r in band_pairs(df, SketchParams(split=100)).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] & b[1] and min(a[2], b[2]) >= 0.6 * max(a[2], b[2])}
    assert got == want
