"""Top items, leaks and mixing against brute force and the rules they must keep."""

import math
import os
import random
import re
import time
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import leaks, mixing
from palimpsest.llm.queries import TOKENIZER
from palimpsest.llm.top_items import top_items


def test_top_items_against_brute_force(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(1, 9)}", rng.randint(1, 60), rng.choice([1.0, 2.0, 3.5, float("nan"), None, -1.0])) for _ in range(4000)] + [(None, 1, 1.0), ("g1", None, 9.0)]
    best = defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g][i] = max(best[g].get(i, s), s)
    want = {(g, i, s, p) for g, m in best.items() for p, (i, s) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    df = spark.createDataFrame(rows, "g string, item bigint, score double").withColumn("pos", F.lit("clash")).repartition(5)
    top = top_items(df, ["g"], "item", "score", 5)
    assert {tuple(r) for r in top.select("g", "item", "score", "pos").collect()} == want
    assert "partial_collect_top_k" in top._jdf.queryExecution().executedPlan().toString()
    assert top_items(df.limit(0), ["g"], "item", "score").count() == 0


def leak_words(text):
    text = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text.lower())


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(1))


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"mot{i}" for i in range(60)] + ["été", "Ça"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for i in range(1, 12)]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "un deux")]
    docs = []
    for d in range(150):
        w = [rng.choice([*vocab, "autre"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            src = leak_words(items[rng.randrange(11)][1])
            a = rng.randrange(len(src))
            w[5:5] = src[a : a + rng.randint(6, 30)]
        docs.append((d, " ".join(w).upper() if d % 3 == 0 else ", ".join(w)))
    docs += [(900, None), (901, ""), (902, "x " * 100_000 + items[5][1])]

    def longest(a, b):
        best, row = 0, {}
        for x in a:
            new = {}
            for j, y in enumerate(b):
                if x == y:
                    new[j] = row.get(j - 1, 0) + 1
                    best = max(best, new[j])
            row = new
        return best

    want = {}
    for d, t in docs[:-1]:
        for i, h in items:
            n = longest(leak_words(t), leak_words(h))
            if n >= 12:
                want[d, i] = n
    df, it = documents(spark, docs).repartition(3), spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    for shard, block in ((1 << 19, 16 << 20), (200, 300)):
        got = {(r.doc_id, r.item_id): r.words for r in leaks.find_leaks(df, it, 12, shard, block).collect()}
        assert {k: v for k, v in got.items() if k[0] != 902} == want and len(want) > 15
        assert (902, 6) in got
    left = leaks.without_leaks(df, leaks.find_leaks(df, it))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want} - {902}


def test_one_word_repeated(spark):
    """20 000 equal words against an item of 500 of them: one match, in bounded time and memory."""
    held = leaks._Items([(1, np.zeros(500, np.int64))])
    tokens = np.append(np.ones(20_000, np.int64), 0)
    began = time.time()
    out = leaks._match(np.array([7]), tokens, np.array([0]), held, 12).to_pylist()
    assert out == [{"doc_id": 7, "item_id": 1, "words": 500, "doc_word": 0, "item_word": 0}] and time.time() - began < 5


def test_suffix_order():
    rng = np.random.default_rng(3)
    tokens = np.append(rng.integers(0, 4, 300), 0)
    cut = lambda k: tuple(tokens[k : k + int(np.flatnonzero(tokens[k:] == 0)[0])])
    rank, suffixes = leaks.suffix_ranks(tokens, 1000)[0], [cut(k) for k in range(301)]
    order = {s: n for n, s in enumerate(sorted(set(suffixes)))}
    assert [order[s] for s in suffixes] == list(rank)


def test_leak_positions_and_empty(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    df = documents(spark, [(1, f"avant lui {passage} après"), (2, "rien")])
    it = spark.createDataFrame([(7, f"début {passage}")], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.find_leaks(df, it).collect()] == [(1, 7, 14, 2, 1)]
    assert leaks.find_leaks(df.limit(0), it).count() == 0 and leaks.find_leaks(df, it.limit(0)).count() == 0


pytestmark_tokens = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")


def corpus(spark, sizes):
    rows = [(k, " ".join(f"mot{(k * 7 + i) % 50}" for i in range(10 + k % 15)), s) for k, s in enumerate(s for s, n in sizes for _ in range(n))]
    rows += [(9_000, None, "a"), (9_001, "", "b"), (9_002, "sans source", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("name", F.lit("clash")).withColumn("tokens", F.lit(1))


@pytestmark_tokens
def test_mix_keeps_its_rules(spark):
    docs = corpus(spark, [("A", 300), (" b ", 40), ("c-d", 5), ("E", 60)])
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 4), ("c_d", 0.3, 2), ("e", 0.0, 3), ("gone", 0.2, 5), ("a", 0.9, 9)], "source string, target_share double, max_repeat int").withColumn("available", F.lit("clash"))
    targets = targets.filter("not (source = 'a' and max_repeat = 9)")
    for steps in (1024, 1):
        goal, drawn = mixing.mix(docs, targets, TOKENIZER, steps=steps)
        rows = drawn.collect()
        assert len(rows) == len({r.doc_id for r in rows})
        by = defaultdict(list)
        for r in rows:
            by[r.name].append(r)
        report = {r.source: r for r in mixing.mix_report(goal, drawn).collect()}
        for g in goal.collect():
            used = sum(r.tokens * r.times for r in by[g.name])
            assert report[g.source].used_tokens == used and used <= g.budget + 1e-6
            assert all(1 <= r.times <= g.max_repeat for r in by[g.name])
            full = g.available * g.max_repeat
            assert report[g.source].short == (g.target_share > 0 and full < g.budget)
            if full >= g.budget > 0:
                assert g.budget - used < 60
            if by[g.name]:
                assert max(r.times for r in by[g.name]) - min(r.times for r in by[g.name]) <= 1
        assert {s for s, r in report.items() if r.short} == {"c_d", "gone"}
        assert sum(r.actual_share for r in report.values()) == pytest.approx(1.0)


@pytestmark_tokens
def test_mix_is_stable_and_weighted(spark):
    docs = corpus(spark, [("a", 400), ("b", 400)])
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 3)], "source string, target_share double, max_repeat int")
    one, two = ({(r.doc_id, r.times) for r in mixing.mix(d, targets, TOKENIZER)[1].collect()} for d in (docs, docs.repartition(7)))
    assert one == two
    w = spark.range(20_000).withColumn("w", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25))
    key = w.select("id", (-F.log(mixing.uniform(F.col("id"), 5)) / F.col("w")).alias("k")).orderBy("k").limit(1000)
    share = key.filter("id % 2 = 0").count() / 1000
    assert 0.74 < share < 0.86


def test_keys_of_small_weights_keep_their_order(spark):
    k = spark.range(50_000).select(mixing.exponential_key(F.col("id"), F.lit(0.05), 3).alias("key"))
    k = k.withColumn("bucket", mixing.key_bucket(F.col("key")))
    assert k.select("key").distinct().count() == 50_000
    assert k.groupBy("bucket").count().agg(F.max("count")).first()[0] < 0.001 * 50_000
    by = k.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).orderBy("bucket").collect()
    assert all(x.z < y.a for x, y in zip(by, by[1:]))


@pytestmark_tokens
def test_mix_of_nothing(spark):
    docs = corpus(spark, []).limit(0)
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeat int")
    goal, drawn = mixing.mix(docs, targets, TOKENIZER)
    assert drawn.count() == 0 and [r.short for r in mixing.mix_report(goal, drawn).collect()] == [False]
    goal, drawn = mixing.mix(corpus(spark, [("a", 3)]), targets.limit(0), TOKENIZER)
    assert drawn.count() == 0 and mixing.mix_report(goal, drawn).count() == 0
