"""Current rows and changes between snapshots, against a plain computation."""

import random
import re
import unicodedata

from palimpsest.operators.snapshots import current_rows, page_changes


def plain_current(rows):
    out = {}
    for d, s, t, u, k in rows:
        digits = re.sub("[^0-9]", "", d or "")
        if digits and s is not None:
            key = (int(digits), s)
            if key not in out or (k if k is not None else -1) > out[key][0]:
                out[key] = (k if k is not None else -1, t, u)
    return out


def norm(t):
    return re.sub("[ \t\r\n ]+", " ", unicodedata.normalize("NFC", t or "")).strip(" ")


def plain_changes(rows):
    now = plain_current(rows)
    subs = sorted({s for _, s in now})
    out = set()
    for before, after in zip(subs, subs[1:]):
        a = {d: norm(v[1]) for (d, s), v in now.items() if s == before}
        b = {d: norm(v[1]) for (d, s), v in now.items() if s == after}
        out |= {(after, d, "added") for d in b.keys() - a.keys()} | {(after, d, "removed") for d in a.keys() - b.keys()}
        out |= {(after, d, "changed") for d in a.keys() & b.keys() if a[d] != b[d]}
    return out


def test_changes_against_plain(spark, snapshot):
    rng = random.Random(3)
    texts = ["été a", "été  a", "A", "a", None, "", " ", "x\r\ny", "x y", "z" * 50_000]
    rows = [(rng.choice(["doc{}", "{}", "doc-{}", " DOC{}"]).format(rng.randint(1, 25)), f"2023-0{rng.randint(1, 4)}", rng.choice(texts), None, k) for k in range(300)]
    rows += [(None, "2023-01", "a", None, 1), ("doc", "2023-01", "a", None, 1), ("7", None, "a", None, 1)]
    got = {(r.sub_collection, r.docid, r.change) for r in page_changes(snapshot(rows)).collect()}
    assert got == plain_changes(rows)


def test_changed_fields_and_gaps(snapshot):
    rows = [("1", "2023-01", "a", None, 1), ("1", "2023-03", "b", None, 1), ("2", "2023-01", "a", None, 1), ("2", "2023-03", " a ", None, 2)]
    assert [tuple(r) for r in page_changes(snapshot(rows)).collect()] == [("2023-03", 1, "changed", ["text_fr"])]


def test_hot_page_and_ties(snapshot):
    rows = [("doc5", "2023-01", f"v{k}", "http://a.example", k) for k in range(200)] * 2 + [("5", "2023-01", "null day", None, None)]
    out = current_rows(snapshot(rows)).collect()
    assert [(r.docid, r.text, r.host) for r in out] == [(5, "v199", "a.example")]


def test_one_snapshot_and_none(snapshot):
    assert page_changes(snapshot([("1", "2023-01", "a", None, 1)])).count() == 0
    assert page_changes(snapshot([])).count() == 0
    assert current_rows(snapshot([])).count() == 0
