import hashlib
import random

import pytest

from lettermill.llm import decontam, license

from .data import by_id, documents, words

KEEP = set("abcdefghijklmnopqrstuvwxyz0123456789")


def plain_words(text):
    """Letters, digits and beyond ASCII; A-Z lower-cased."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c in KEEP or ord(c) > 127 else " " for c in low).split(" ")


def tokens(text):
    return [w for w in plain_words(text) if w]


def places(text, phrases=license.PHRASES):
    w = tokens(text)
    return sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


LICENCES = [
    "Licensed under CC BY-NC 4.0.", "all rights, reserved ALL RIGHTS RESERVED all rights", "the GNU General Public License general public license", "cc by cc by", "ccby cc\u00e9 by", None, "", "...", "CC\u0085BY",
    "Released under the MIT License.", "general public", "x " * 3000 + "All rights reserved",
]


def test_licences_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = "cc by general public license all rights reserved the this work is licensed".split()
    texts = LICENCES + [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    got = by_id(license.scan(documents(spark, [(i, t, None) for i, t in enumerate(texts)])))
    for i, t in enumerate(texts):
        found, row = places(t), got[i].licenses
        assert (row.n_words, row.n_base) == (len(tokens(t)), len(found))
        assert (row.first_word, row.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1


def test_long_templates_are_chained_over_edits():
    scanner = license.default_scanner()
    mit = dict((label, t) for label, t in license.TEMPLATES[::-1] if len(t) > 200)["mit"]
    w = mit.split()
    edited = w[:20] + ["surely"] + w[20:50] + w[52:]
    report = license._report(scanner, ("Some words before. " + " ".join(edited) + " and after").encode())
    assert report["labels"] == "mit"
    assert 0.9 < report["score"] <= 1
    span = report["spans"][-1]
    assert span["start"] <= 4 and span["stop"] >= len(tokens(mit)) - 3
    assert license._report(scanner, " ".join(w[:20]).encode())["labels"] == ""


def test_repeated_notices_give_a_span_each():
    mit = next(t for label, t in license.TEMPLATES if label == "mit" and len(t) > 200)
    short, w = "Released under the MIT License", mit.split()
    text = " filler ".join([short, mit, short, " ".join(w[:20] + ["surely"] + w[20:]), mit, short])
    spans = license._report(license.default_scanner(), text.encode())["spans"]
    t = tokens(text)
    starts = lambda x: [i for i in range(len(t)) if t[i : i + len(tokens(x))] == tokens(x)]
    assert [(s["start"], s["stop"]) for s in spans if s["template"] == 2] == [(i, i + 5) for i in starts(short)]
    long = [s for s in spans if s["template"] == 3]
    assert len(starts(short)) == len(long) == 3
    assert [s["start"] for s in long if s["cover"] == 1 and s["stop"] - s["start"] == len(tokens(mit))] == starts(mit)
    assert all(a["stop"] <= b["start"] for a, b in zip(long, long[1:], strict=False))


def test_labels_of_the_method_on_repeats_and_long_texts(spark):
    """A template far inside a long text, twice, and a row that repeats: the same labels and score, by the template's words."""
    rng = random.Random(6)
    label, mit = next((x, t) for x, t in license.TEMPLATES if x == "mit" and len(t) > 200)
    filler = words(rng, 150_000, 900)
    rows = [(1, f"{filler} {mit} {filler} {mit}", None), (1, f"{filler} {mit} {filler} {mit}", None), (2, filler, None), (None, mit, None)]
    got = license.scan(documents(spark, rows)).collect()
    assert sorted((r.licenses.labels, r.licenses.score, len(r.licenses.spans)) for r in got) == [("", 0.0, 0), (label, 1.0, 1), (label, 1.0, 2), (label, 1.0, 2)]
    for r in got:
        w = tokens(r.text)
        assert all(w[s.start : s.stop] == tokens(mit) for s in r.licenses.spans)


def test_automaton_statistics():
    rng = random.Random(3)
    for _ in range(100):
        templates = [[rng.choice("abc").encode() for _ in range(rng.randint(1, 8))] for _ in range(3)]
        auto = license.Automaton()
        for i, t in enumerate(templates):
            auto.add(i, t)
        auto.close()
        doc = [rng.choice("abcd").encode() for _ in range(25)]
        found = {at: (state, run) for at, state, run in auto.statistics(iter([doc[:9], [], doc[9:]]))}
        for at in range(1, 26):
            ends, best = set(), 0
            for run in range(1, at + 1):
                now = {(i, j + run) for i, t in enumerate(templates) for j in range(len(t) - run + 1) if t[j : j + run] == doc[at - run : at]}
                if not now:
                    break
                ends, best = now, run
            state, run = found.get(at, (0, 0))
            assert (run, auto.ends[state]) == (best, ends)


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = tokens(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if k else []:
            wins.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for i, t, _ in docs:
        w, hit, own = tokens(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    own |= {x for x in found if x is not None}
        ids = sorted(map(str, own))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def benchmark_case():
    rng = random.Random(8)
    items = [(i, words(rng, n, 60)) for i, n in enumerate((30, 12, 10, 9, 3, 1))] + [(None, words(rng, 20, 60)), (6, None), (7, ""), (2, words(rng, 11, 60)), (10, words(rng, 15, 60))]
    docs = []
    for i in range(60):
        t = words(rng, rng.randrange(0, 80), 60).split()
        if i % 2:
            passage = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(t) + 1)
            t[at:at] = passage[rng.randrange(3) :]
        docs.append((i, ", ".join(t).upper(), "s"))
    docs += [(100, None, None), (101, "", None), (3, docs[3][1], "s"), (None, docs[5][1], "s"), (102, words(rng, 20000, 60), "s")]
    return docs, items


@pytest.mark.parametrize(("most", "hashes", "parts"), [(500_000, 4_000_000, 4), (7, 20, 100), (7, 20, 2)])
def test_decontamination_equals_brute_force(spark, monkeypatch, most, hashes, parts):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", most)
    monkeypatch.setattr(decontam, "BROADCAST_HASHES", hashes)
    monkeypatch.setattr(decontam, "BROADCASTS", parts)
    docs, items = benchmark_case()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = decontam.report(documents(spark, docs), bench).collect()
    key = lambda r: tuple((x is None, x) if x is None or not isinstance(x, str) else x for x in r)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, key(r[1:])))
    assert got == sorted(brute(docs, items), key=lambda r: (r[0] is None, r[0] or 0, key(r[1:])))


def test_removing_documents_and_spans(spark):
    docs, items = benchmark_case()
    bench = spark.createDataFrame([(i, t) for i, t in items if t and len(t.split()) > 9], "item_id long, text string")
    frame = documents(spark, docs)
    bad = {(r[0], d[1]) for r, d in zip(brute(docs, [x for x in items if x[1] and len(x[1].split()) > 9]), docs, strict=True) if r[5]}
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i is None, i or 0, t or "") for i, t, _ in docs if (i, t) not in bad)
    cut = decontam.decontaminate(frame, bench, mode="spans")
    assert cut.count() == len(docs)
    assert decontam.report(cut.where("doc_id < 60"), bench).where("n_hit > 30").count() == 0
    text = spark.createDataFrame([(1, "Say: one two, three! four.", 1)], "doc_id long, text string, win int")
    small = spark.createDataFrame([(1, "TWO three")], "item_id long, text string")
    assert decontam.decontaminate(text, small, mode="spans").first().text == "Say: one four."


def test_empty_tables(spark):
    none = documents(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(none, bench).count() == 0
    row = decontam.report(documents(spark, [(1, "a b", "s")]), bench).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
    assert license.scan(none).count() == 0
