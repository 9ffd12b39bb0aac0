"""Term counts, repeated lines and main content against plain computations."""

import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

from palimpsest.llm import site_lines
from palimpsest.llm.main_content import furniture_lines, main_content
from palimpsest.llm.site_lines import line_sequences, repeated_lines, without_repeated_lines
from palimpsest.llm.term_counts import count_pairs, snapshot_term_counts


def test_terms_against_plain(snapshot):
    rng = random.Random(2)
    pool = ["été", "été", "Mot1x", "L'eau", "rare", "a_b", "Éa"]
    rows = [(f"doc{rng.randint(1, 30)}", f"2023-0{rng.randint(1, 3)}", " ".join(rng.choice(pool[: rng.randint(1, 7)]) for _ in range(rng.randint(0, 9))), None, k) for k in range(200)]
    rows += [("5", "2023-09", None, None, 1), ("6", "2023-09", "   ", None, 1), ("7", "2023-09", "12 34", None, 1), ("8", "2023-09", "long " * 50_000, None, 1)]
    now = {}
    for d, s, t, _, k in rows:
        key = (int(re.sub("[^0-9]", "", d)), s)
        if key not in now or k > now[key][0]:
            now[key] = (k, t)
    total, docs, alive = Counter(), defaultdict(set), set()
    for (d, _), (_, t) in now.items():
        if t and t.strip(" \t\r\n "):
            alive.add(d)
            for w in re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", t).lower()):
                total[w] += 1
                docs[w].add(d)
    mark = lambda n: "rare" if n <= 2 else "common" if n > 0.5 * len(alive) else "kept"
    want = {(w, total[w], len(docs[w]), mark(len(docs[w]))) for w in total}
    assert {tuple(r) for r in snapshot_term_counts(snapshot(rows)).collect()} == want
    assert snapshot_term_counts(snapshot([])).count() == 0


def test_hot_term_over_partitions(spark):
    rows = [("hot", d, 1) for d in range(3000)] * 2 + [(f"t{d % 50}", d, 2) for d in range(1000)]
    got = {r.term: (r.n_total, r.n_docs) for r in count_pairs(spark.createDataFrame(rows, "term string, doc bigint, n bigint").repartition(8), 6).collect()}
    assert got["hot"] == (6000, 3000) and got["t7"] == (40, 20) and len(got) == 51


def site(n=12):
    rows = [(f"doc{i}", "2023-01", f"Menu\nArticle {i}a\n\n Partager  : lien\nFin de page", "http://www.a.example/x", 1) for i in range(n)]
    rows += [(f"doc{i}", "2023-02", f"MENU\nautre {i}b", "m.a.example", 1) for i in range(4)]
    rows += [(f"doc{100 + i}", "2023-01", "Menu\nPartager : lien", "http://b.example", 1) for i in range(7)]
    return [*rows, ("doc200", "2023-01", "Menu", None, 1), ("doc201", "2023-01", None, "http://a.example", 1), ("doc202", "2023-01", "", "http://a.example", 1), rows[0]]


def test_repeated_lines(snapshot):
    got = {tuple(r)[:3] for r in repeated_lines(snapshot(site())).collect()}
    want = {("2023-01", i, n) for i in range(12) for n in (1, 4, 5)} | {("2023-02", i, 1) for i in range(4)}
    assert got == want
    assert repeated_lines(snapshot([])).count() == 0


def test_removal(snapshot):
    out = {(r.sub_collection, r.docid): (r.removed, r.text) for r in without_repeated_lines(snapshot(site())).collect()}
    assert out["2023-01", 3] == (3, "Article 3a\n") and out["2023-02", 3] == (1, "autre 3b")
    assert out["2023-01", 100] == (0, "Menu\nPartager : lien") and out["2023-01", 201] == (0, None) and out["2023-01", 202] == (0, "")


def test_sequences_against_brute_force(snapshot):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randint(2, 8))) for _ in range(40)]
    rows = [(f"doc{i}", "2023-01", t, "http://h.example", 1) for i, t in enumerate(texts)]
    support = defaultdict(set)
    for i, t in enumerate(texts):
        for n in (1, 2, 3):
            for c in itertools.combinations(t.split("\n"), n):
                support[c].add(i)
    want = {(c, len(s)) for c, s in support.items() if len(s) >= 8}
    got = {(tuple(r.lines), r.docs) for r in line_sequences(snapshot(rows), 8, 3).collect()}
    assert got == want and any(len(c) == 3 for c, _ in want)


def test_sequences_of_every_length(snapshot):
    texts = ["a\nb\na\nc\nd\ne"] * 8 + ["a\nb\nx\nd\ne"] * 2 + ["e\nd"]
    rows = [(f"doc{i}", "2023-01", t, "http://h.example", 1) for i, t in enumerate(texts)]
    rows += [("doc0", "2023-02", "e\nd", "http://h.example", 1), ("doc1", "2023-02", "a\nb\nd\ne", "http://h.example", 1)]
    support = defaultdict(set)
    for d, _, t, *_ in rows:
        lines = t.split("\n")
        for n in range(1, len(lines) + 1):
            for c in itertools.combinations(lines, n):
                support[c].add(d)
    want = {(c, len(s)) for c, s in support.items() if len(s) >= 8}
    got = [(tuple(r.lines), r.docs) for r in line_sequences(snapshot(rows)).collect()]
    assert sorted(got) == sorted(want) and max(len(c) for c, _ in want) == 6
    assert line_sequences(snapshot([])).count() == 0


def test_removal_grows_sequences_to_the_end(snapshot, monkeypatch):
    graphs, graph = [], site_lines.sequence_graph
    monkeypatch.setattr(site_lines, "sequence_graph", lambda *a: graphs.append(graph(*a)) or graphs[-1])
    menu = [f"entrée {i}" for i in range(40)]
    rows = [(f"doc{i}", "2023-01", "\n".join([f"titre {i}", *menu, "pied"][: 42 - (i == 8)]), "http://h.example", 1) for i in range(9)]
    got = {tuple(r)[1:3] for r in repeated_lines(snapshot(rows)).collect()}
    assert got == {(i, n) for i in range(9) for n in range(2, 43 - (i == 8))}
    (edges, leads, _), = graphs
    follows = {(r.node, r.code): r.next for r in leads.collect()}
    out = defaultdict(list)
    for r in edges.collect():
        out[r.node].append((follows.get((r.node, r.code)), r.docs))

    def paths(node, seen={}):
        if node not in seen:
            seen[node] = sum(1 + paths(next) for next, _ in out.get(node, []))
        return seen[node]

    assert paths("") == 2**41 - 1 and {d for e in out.values() for _, d in e} == {8, 9}
    assert sum(map(len, out.values())) == 41 + 40 * 41 // 2


def news(hosts=3, pages=40):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    sentence = lambda n=12: " ".join(word() for _ in range(n)).capitalize() + "."
    rows, main = [], {}
    for h in range(hosts):
        for i in range(pages):
            doc = h * 1000 + i + 1
            title = f"{word().capitalize()} {word()} {word()} {word()} à {word().capitalize()}"
            lines = [("Accueil > Infos", 0), (title, 1), (f"Par {word().capitalize()} {word().capitalize()}", 0), (sentence(), 1)]
            if i % 2:
                lines.append(("Publicité", 0))
            if i % 13 == 0:
                lines.append(("À retenir", 1))
            lines += [(f"- {i % 7 + 2} {word()} de {word().capitalize()}", 1), (sentence(), 1), ("", None), (f"Lire aussi : {word().capitalize()} {word()} {word()} {word()}", 0)]
            lines += [(f"{i} réactions ({doc})", 0), (f"© 2023 Site{h} Nom", 0)]
            rows.append((f"doc{doc}", "2023-01", "\n".join(t for t, _ in lines), f"http://h{h}.example/", 1))
            main[doc] = {k for k, (_, m) in enumerate(lines, 1) if m == 0}
    return rows, main


def test_furniture(snapshot):
    rows, want = news()
    got = defaultdict(set)
    for r in furniture_lines(snapshot(rows)).collect():
        got[r.docid].add(r.line_no)
    assert {d: got[d] for d in want} == want


def test_near_copies_on_a_small_host_are_kept(snapshot):
    rows, want = news(3, 12)
    body = "Un texte repris presque tel quel par ce site.\nIl compte deux paragraphes entiers."
    rows += [(f"doc{9000 + i}", "2023-01", f"Accueil > Infos\nTitre {chr(97 + i)}bel du jour\n{body}\n© 2023 Site0 Nom", "http://h0.example/", 1) for i in range(4)]
    got = defaultdict(set)
    for r in furniture_lines(snapshot(rows)).collect():
        got[r.docid].add(r.line_no)
    assert all(got[9000 + i] == {1, 5} for i in range(4))


def test_main_content_edges(snapshot):
    rows, _ = news(1, 40)
    rows += [("5000", "2023-01", None, None, 1), ("5001", "2023-01", "", "http://x.example", 1), ("5002", "2023-01", "Une phrase seule.", None, 1)]
    out = {r.docid: r.text for r in main_content(snapshot(rows)).collect()}
    assert out[5000] is None and out[5001] == "" and out[5002] == "Une phrase seule."
    assert "Publicité" not in out[2] and len(out[2].split("\n")) == 4
    assert furniture_lines(snapshot([])).count() == 0
