import base64
import gzip
import hashlib

import duckdb
import pytest

from lettermill.llm import chat, mixing, warc

from .data import by_id, documents, words

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "http://a/5", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nnot a record\r\n\r\n"),
    (6, "http://a/6", "é" * 70000), (2, "http://a/2", "<p>same</p>"), (None, "http://a/n", "<p>same</p>"), (7, "u", "\x00\x01 \ud7ff"), (9, "http://a/9", "é" * 70000),
]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()  # noqa: S324


def test_archives_round_trip_and_revisits(spark):
    frame = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive_pages(frame).collect()
    assert len(got) == len(PAGES)
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected = []
    seen = set()
    for i, _, h in sorted(PAGES, key=lambda p: -1 if p[0] is None else p[0]):
        first = i == best[h or ""] and (h or "") not in seen
        if first:
            seen.add(h or "")
        expected.append((i, len((h or "").encode()), sha(h), "response" if first else "revisit", None if first else best[h or ""]))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected, key=key)


def test_threshold_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "u", ""), (2, "u", ""), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    got = by_id(warc.archive_pages(frame, least_bytes=5), "page_id")
    assert [got[i].record_type for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
    assert warc.archive_pages(frame.limit(0)).count() == 0


def test_parsing_members_and_broken_records():
    record = b"WARC/1.1\r\nContent-Length: 5\r\nWARC-Type: response\r\n\r\nab\r\nc\r\n\r\n"
    for raw in (record * 2, gzip.compress(record * 2), gzip.compress(record) + gzip.compress(record)):
        assert [b for _, b in warc.parse(raw)] == [b"ab\r\nc"] * 2
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(record[:-8]))
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.parse(b"hello\r\n"))


def test_other_records_and_old_revisits(spark, tmp_path):
    def made(kind, name, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n"
    page = lambda name, i: made("response", name, http + b"same", f"X-Page-ID: {i}")
    same = f"WARC-Payload-Digest: sha1:{sha('same')}"
    other = [made("warcinfo", "i", b"a: b\r\n\r\n\xff"), made("request", "q", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"), made("metadata", "m", b"")]
    old = [made("revisit", "r1", http, same, "WARC-Refers-To: <a>"), made("revisit", "r2", http, same), made("revisit", "r3", http, f"WARC-Payload-Digest: sha1:{sha('far')}", "WARC-Refers-To: <far>")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "plain.warc").write_bytes(other[0] + page("a", 1) + old[0] + other[1])
    (tmp_path / "in" / "packed.warc.gz").write_bytes(gzip.compress(page("b", 2) + other[2] + old[1] + old[2]))
    warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = warc.read(spark, str(tmp_path / "out")).collect()
    assert sorted(bytes(r.raw) for r in rows if r.raw is not None) == sorted(x[:-4] for x in other)
    ids = {r.record_id for r in rows}
    refers = {r.record_id: (r.refers_to_id, r.refers_to) for r in rows if r.kind == "revisit"}
    assert {k: refers.pop(k) for k in ("<r1>", "<r2>", "<r3>")} == {"<r1>": ("<b>", 2), "<r2>": ("<b>", 2), "<r3>": ("<far>", None)}
    assert list(refers.values()) == [("<b>", 2)] and "<b>" in ids and "<a>" not in ids and len(rows) == 8


def test_captures_keep_their_own_headers(spark, tmp_path):
    """A 404 and a redirect with equal payloads: status, headers, dates and addresses are those of each capture."""

    def made(name, when, status, payload):
        block = f"HTTP/1.1 {status}\r\nServer: s-{name}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {when}\r\nWARC-Target-URI: http://h/{name}\r\nContent-Type: application/http; msgtype=response\r\n"
        return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    (tmp_path / "in").mkdir()
    dns = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <d>\r\nContent-Type: text/dns\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    raw = made("a", "2020-01-01T00:00:00Z", "404 Not Found", b"gone") + made("b", "2021-02-02T00:00:00Z", "301 Moved", b"gone") + made("c", "2022-03-03T00:00:00Z", "200 OK", b"here") + dns
    (tmp_path / "in" / "x.warc").write_bytes(raw)
    warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = {r.uri: r for r in warc.read(spark, str(tmp_path / "out")).collect()}
    assert [bytes(rows[f"http://h/{k}"].http).split(b"\r\n")[:2] for k in "abc"] == [[b"HTTP/1.1 404 Not Found", b"Server: s-a"], [b"HTTP/1.1 301 Moved", b"Server: s-b"], [b"HTTP/1.1 200 OK", b"Server: s-c"]]
    assert [rows[f"http://h/{k}"].date[:4] for k in "abc"] == ["2020", "2021", "2022"]
    a, b = rows["http://h/a"], rows["http://h/b"]
    assert (a.kind, b.kind, a.payload_bytes) == ("revisit", "response", 4)
    assert (a.refers_to_id, a.refers_to_uri, a.refers_to_date) == ("<b>", "http://h/b", "2021-02-02T00:00:00Z")
    assert bytes(rows[None].raw) == dns[:-4] and len(rows) == 4


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * (n * 1000 + i)) for i, n in enumerate([1] * 50 + [100] * 6)], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.page_records(pages), str(tmp_path / "a"), per_file=16)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "a").rglob("*.gz")]
    assert len(sizes) > 6 and max(sizes) <= 16 * (warc.SMALL + 1000)
    assert warc.read(spark, str(tmp_path / "a"), payloads=False).count() == 56


def test_a_hot_payload_has_one_response(spark):
    """The commonest payload, the empty one, ten thousand times: written by several tasks, one response, the rest revisits."""
    pages = spark.range(10_000).selectExpr("id as page_id", "concat('http://h/', id) as url", "cast(null as string) as html").repartition(6)
    got = warc.archive_pages(pages).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r.record_type, r.refers_to, r["count"]) for r in got) == [("response", None, 1), ("revisit", 9999, 9999)]


CHAT = [
    (1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", "yo"), (1, None, "ann", "late"), (1, 2, "bob b", "yo"), (2, 0, "system", "alone"), (3, 5, None, None), (3, 700, "user", ""),
    (None, 0, "user", "q"), (None, 300, "assistant", "a"), (1, -3, "cat", "first"),
]


def test_perspectives_render_each_dialogue(spark):
    frame = spark.createDataFrame([(*c, 1) for c in CHAT], "conv_id long, turn long, role string, text string, start int")
    rows = chat.rotate(frame).collect()
    for conv in {c[0] for c in CHAT}:
        turns = sorted((c for c in CHAT if c[0] == conv), key=lambda c: (c[1] is None, c[1] or 0, c[2] or "unknown", c[3] or ""))
        parties = {c[2] or "unknown" for c in turns} - {"system"}
        assert {r.perspective for r in rows if r.conv_id == conv} == parties
        for p in parties:
            own = sorted((r for r in rows if r.conv_id == conv and r.perspective == p), key=lambda r: r.seq)
            whole = "".join(r.rendered for r in own)
            assert [r.seq for r in own] == list(range(len(turns)))
            for r, (_, _, role, text) in zip(own, turns, strict=True):
                assert whole[r.start : r.stop] == r.rendered
                shown = (text or "").replace("<|", "< |")
                speaker = role or "unknown"
                head = "system" if speaker == "system" else "assistant" if speaker == p else f"user name={speaker.replace(' ', '_')}"
                assert r.rendered == f"<|im_start|>{head}\n{shown}<|im_end|>\n"
                assert (r.mask_start is not None) == (head == "assistant")
                if r.mask_start is not None:
                    assert whole[r.mask_start : r.mask_stop] == shown + "<|im_end|>"
    assert chat.rotate(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_a_long_dialogue_of_many_parties(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "BROADCAST_PARTIES", most)
    turns = [(1, i if i % 7 else None, f"p{i % 5}", "long " * 2000 if i == 9 else str(i)) for i in range(1500)] + [(2, 0, "a", "b")]
    rows = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).where("conv_id = 1").collect()
    assert len(rows) == 5 * 1500
    for p in range(5):
        own = sorted((r for r in rows if r.perspective == f"p{p}"), key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(1500))
        assert all(a.stop == b.start for a, b in zip(own, own[1:], strict=False)) and own[0].start == 0
        assert sum(r.mask_start is not None for r in own) == 300


def test_perspectives_equal_sql(spark):
    import pandas as pd

    conversations = pd.DataFrame([c for c in CHAT if c[1] is not None], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    sql = sorted(map(str, con.execute(f"SELECT conv_id, perspective, seq, rendered, start, stop FROM ({chat.ROTATE_SQL})").fetchall()))
    frame = spark.createDataFrame([c for c in CHAT if c[1] is not None], "conv_id long, turn long, role string, text string")
    got = sorted(str((r.conv_id, r.perspective, r.seq, r.rendered, r.start, r.stop)) for r in chat.rotate(frame).collect())
    assert got == sql


def level(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        goal = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    import random

    rng = random.Random(7)
    names = ["b", "a", "é", "Z", None, "tiny", "zero"]
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice(names[:5])) for i in range(900)]
    rows += [(1000, "one two", "tiny"), (1001, None, "zero"), (1002, " \t", "zero"), (1003, words(rng, 9000), "b"), (0, rows[0][1], rows[0][2]), (None, "x y z", "a")]
    frame = documents(spark, rows)
    got = mixing.mix(frame).collect()
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    sizes, taken = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for r in got:
        s = source[r.doc_id, r.size]
        sizes[s] += r.size
        taken[s] += r.taken
        assert r.taken in [m * r.size for m in range(4)]
    goals = level(sizes)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s]
        assert abs(r.target - goals[s]) < 1e-6 * max(1, goals[s])
    for s in names:
        assert abs(taken[s] - goals[s]) <= max(2, 0.01 * goals[s]), s
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, mixing.mix(frame.repartition(5)).collect())) == sorted(map(key, got))
    assert mixing.mix(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(frame, most=2.5)


def test_mix_takes_some_of_many_repeated_rows(spark):
    """A third of all rows are one row: as many of its copies are taken again as the target asks for."""
    import random

    rng = random.Random(5)
    rows = [(i, words(rng, 20), "ab"[i % 2]) for i in range(400)] + [(7777, "one two three", "a")] * 300
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == 700
    for s in "ab":
        own = [r for r in got if (r.doc_id == 7777 or r.doc_id % 2 == 0) == (s == "a")]
        assert abs(sum(r.taken for r in own) - own[0].target) <= (2 if s == "a" else 10)  # half of a document
        assert all(r.taken in [m * r.size for m in range(4)] for r in own)


def test_mix_takes_a_large_document_where_that_comes_nearer(spark):
    rows = [(1, " ".join(["w"] * 100), "a"), (2, " ".join(["w"] * 30), "b"), (3, " ".join(["w"] * 30), "b")]
    got = by_id(mixing.mix(documents(spark, rows), weights=(19, 1)))
    assert got[1].target > 150 and got[1].taken == 200 or got[1].target <= 150 and got[1].taken == 100
    rows = [(1, " ".join(["w"] * 1000), "a"), *((i, "x y", "b") for i in range(2, 700))]
    got = by_id(mixing.mix(documents(spark, rows), weights=(4, 3)))
    assert 1300 < got[1].target < 1400 and got[1].taken == 1000
    got = by_id(mixing.mix(documents(spark, rows), weights=(19, 5)))
    assert 1800 < got[1].target < 1900 and got[1].taken == 2000


def thresholds(rows, targets, sizes):
    """The words taken of each document (doc_id, text, source), one document after the other in the order of hashes."""
    key = lambda i, t: int(hashlib.md5(f"{i}/{t}".encode()).hexdigest()[:9], 16)  # noqa: E731, S324
    taken = {}
    for s, goal in targets.items():
        own = sorted((key(i, t), i, len(t.split())) for i, t, x in rows if x == s)
        whole = int(goal / sizes[s] + 1e-9)
        left, extra, lo = goal - whole * sizes[s], set(), 0
        for _ in range(mixing.PASSES):
            most = left
            for h, i, n in [d for d in own if d[0] >= lo and d[2] <= most + 1e-6]:
                if n > left + 1e-6:
                    lo = h + 1
                    break
                extra.add(i)
                left -= n
            else:
                lo = 1 << 40
        near = min(((abs(n - left), h, i) for h, i, n in own if i not in extra and n < 2 * left), default=None)
        extra |= {near[2]} if near else set()
        taken |= {i: n * (whole + (i in extra)) for _, i, n in own}
    return taken


def test_documents_taken_equal_brute_force(spark):
    import random

    rng = random.Random(21)
    rows = [(i, words(rng, rng.choice((1, 5, 40, 300))), rng.choice("abcd")) for i in range(300)]
    got = by_id(mixing.mix(documents(spark, rows)))
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcd"}
    assert {i: r.taken for i, r in got.items()} == thresholds(rows, level(sizes), sizes)
