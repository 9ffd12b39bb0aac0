"""Endings of texts, hand-made, and the learned baselines on a small corpus."""

import random

from pyspark.sql import functions as F

from palimpsest.llm.cut_texts import cut_documents, cut_report, open_marks, text_endings

MARKS = {
    "a (b) [c]": "",
    "a (b [c": "([",
    "« a », b": "",
    "« a « b »": "«",
    "a) b": "",
    "(a] b": "(",
    "": "",
    'il dit "oui" puis "non': '"',
    "<b>gras</b> <i>pen": "<i>",
    "<ul><li>un<li>deux</ul> <br> <img src='x'/>": "",
    "un <a href='x": "<",
    "deux < trois": "",
    "« dit\nil (bas": "«\n(",
    "« dit\nil » (bas)\nfin": "",
}


def test_automaton(spark):
    df = spark.createDataFrame([(t,) for t in MARKS], "t string").select("t", open_marks(F.col("t")).alias("open"))
    assert {r.t: r.open for r in df.collect()} == MARKS


ENDINGS = {
    "Une phrase.": ("ending", "."),
    "Il dit « oui. »": ("ending", "."),
    "(voir la page)": ("ending", "."),
    "Une phra": ("ending", ""),
    "Le chat…": ("ending", "…"),
    "Le chat [...]": ("ending", "…"),
    "Une voiture\ufffd": ("broken", True),
    "Un orage&eac": ("broken", True),
    "Un orage <": ("broken", True),
    "Un <a href='x": ("broken", True),
    "Un <a title='" + "long " * 100: ("broken", True),
    "Un regrou-": ("broken", True),
    "Il a dit (selon la presse.": ("open", True),
    "« Tout commence\nUne ligne": ("before", True),
    "Une. Deux": ("several", True),
}


def test_endings(spark):
    rows = [(i, t, "s") for i, t in enumerate(ENDINGS)]
    out = {r.doc_id: r for r in text_endings(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert {t: (f, out[i][f]) for i, (t, (f, _)) in enumerate(ENDINGS.items())} == ENDINGS


def test_open_before_a_terminator_is_cut(spark):
    rows = [(i, f"Une phrase entière, la {i}e.", "s") for i in range(50)] + [(100, "Il a dit (selon la presse.", "s"), (101, "« Non.\nIl est parti.", "s")]
    out = {r.doc_id: r.reason for r in cut_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out.pop(100) == "open" and set(out.values()) == {None}


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    sentence = lambda n=10: "Le " + " ".join(word() for _ in range(n)) + "."
    rows, cut, k = [], set(), 0
    for source in ("libre", "serre"):
        for i in range(120):
            k += 1
            text = "\n".join(sentence() for _ in range(6))
            if i % 3 == 1:
                text += f"\nPhoto : {word()} {word()}"
            if i % 3 == 2:
                text += "\nAffaire à suivre…"
            if source == "serre" and i % 2:
                text = "\n".join(sentence() for _ in range(30))[:500]
                if text[-1] != ".":
                    cut.add(k)
            elif i % 20 == 4:
                text = text.split("\n")[0] + "\n" + sentence()[: rng.randint(8, 30)].rstrip()
                cut.add(k)
            elif i % 20 == 5:
                text = sentence() + "\n" + sentence()[:25] + "…"
                cut.add(k)
            rows.append((k, text, source))
    rows += [(1000 + i, rows[c - 1][1], "Libre ") for i, c in enumerate(sorted(cut)[:6])]
    cut |= {1000 + i for i in range(6)}
    rows += [(2000, None, "libre"), (2001, " \n", "libre"), (2002, "mot " * 60_000 + "fin.", None), (2003, "Le chat", None)]
    return rows, cut | {2003}


def test_corpus(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("name", F.lit("clash")).withColumn("kind", F.lit(1))
    out = cut_documents(df)
    got = {r.doc_id: r.cut for r in out.collect()}
    assert set(got) == {r[0] for r in rows} - {2000, 2001}
    assert {d for d, c in got.items() if c} == want
    report = {r.source: r for r in cut_report(out).collect()}
    assert report[None].cut == 1 and report[None].documents == 2 and 0.4 < report["serre"].share < 0.7


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert cut_documents(df).count() == 0 and cut_report(cut_documents(df)).count() == 0
