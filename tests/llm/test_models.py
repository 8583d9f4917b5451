import hashlib
import random
import zlib

import numpy as np

from lettermill.llm import quality, toxicity, urls
from lettermill.llm.labels import drawn

from .data import by_id, documents, words

BAD = "grumbleworth snarlbark".split()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=500):
    """Documents of which some are junk and some hold words that mark them."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        t = words(rng, rng.randrange(40, 90)).split()
        junk, toxic = rng.random() < 0.3, rng.random() < 0.2
        if junk:
            t = [f"{w} |" for w in t[:20]] * 3
        if toxic:
            for _ in range(4):
                t[rng.randrange(len(t))] = rng.choice(BAD)
        rows.append((i, " ".join(t), f"s{i % 3}"))
        labels.append((i, int(not junk), int(toxic), 1.0))
    rows += [(None, None, None), (n, "", "s"), (n + 1, words(rng, 50000), "s"), (0, rows[0][1], "s0")]
    labels += [(n + 5, None, None, 1.0), (None, 1, 1, 1.0)]
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score double"), {r[0]: r[1:3] for r in labels}


def check(got, truth, column, cut):
    assert len(got) == 504
    for r in got:
        assert r.held_out == (held(r.doc_id) if r.doc_id is not None else True)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    tested = [(truth[r.doc_id][column], r.predicted) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    return np.mean([a == b for a, b in tested])


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = frames(spark)
    got = quality.classify(docs, labels).collect()
    assert check(got, truth, 0, 0.3) > 0.97
    again = {(r.doc_id, r.score) for r in quality.classify(docs.repartition(3), labels.repartition(2)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    kept = quality.accept(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = frames(spark)
    got = toxicity.classify(docs, labels).collect()
    assert check(got, truth, 1, 0.5) > 0.97
    kept = toxicity.accept(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 - r.predicted for r in got)


def test_held_out_labels_teach_nothing(spark):
    docs, labels, truth = frames(spark)
    from pyspark.sql import functions as F

    from lettermill.llm.labels import held_out

    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for module in (quality, toxicity):
        a, b = ({(r.doc_id, r.score) for r in module.classify(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_without_labels(spark):
    docs, labels, _ = frames(spark)
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.classify(docs, none).collect()} == {0}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_flattened_trees_equal_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, quality.FEATURES))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, trees=15)
    walked = np.full(len(x), model.base)
    for i, row in enumerate(x):
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            walked[i] += leaf[at - len(f)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-walked)))
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_statistics_equal_counting():
    """Shares of kinds of characters and words, counted one by one."""
    text = "The cat, the CAT!\nsat on 12 mats...\t caf\u00e9 \u00e9t\u00e9"
    raw, w = text.encode(), text.lower().split()
    got = quality.statistics(raw)
    share = lambda ok: sum(map(ok, raw)) / len(raw)
    expected = {
        0: share(lambda c: 65 <= c <= 90), 1: share(lambda c: 97 <= c <= 122), 2: share(lambda c: 48 <= c <= 57), 3: share(lambda c: c >= 128), 4: share(lambda c: c in b" \t\x0b\x0c\r"),
        5: share(lambda c: c == 10), 6: share(lambda c: c in b".,;:'-"), 7: share(lambda c: c in b"!?"), 10: share(lambda c: c in b"aeiouAEIOU"), 11: share(lambda c: c < 32),
        12: -sum(raw.count(c) / len(raw) * np.log2(raw.count(c) / len(raw)) for c in set(raw)), 13: np.log1p(len(raw)), 14: np.log1p(len(w)), 15: np.mean([len(x.encode()) for x in w]),
        18: len(set(w)) / len(w), 19: max(map(w.count, w)) / len(w), 21: 0.0, 22: len(set(zip(w, w[1:], strict=False))) / (len(w) - 1), 25: np.log1p(1), 27: sum(text.count(c) for c in ".!?") / len(w),
    }
    for k, v in expected.items():
        assert abs(got[k] - v) < 1e-12, k
    assert not quality.statistics(None).any() and not quality.statistics(b"").any()


def test_first_split_equals_trying_all():
    """A tree of depth 1 splits where trying every cut of every statistic gains most."""
    rng = np.random.default_rng(12)
    x, y = np.round(rng.normal(size=(200, 5)), 1), (rng.random(200) < 0.5).astype(float)
    y[x[:, 3] > 0.4] = 1
    model = quality.fit(x, y, depth=1, trees=1, bins=64)
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(200, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    best = (-1.0, 0, 0.0)
    for f in range(5):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
            low = x[:, f] <= cut
            if min(h[low].sum(), h[~low].sum()) >= quality.LEAF:
                best = max(best, (gain(low) + gain(~low), -f, -cut))
    f, cut = -best[1], -best[2]
    assert int(model.feature[0, 0]) == f
    assert ((x[:, f] > model.threshold[0, 0]) == (x[:, f] > cut)).all()
    for side, low in ((0, x[:, f] <= cut), (1, x[:, f] > cut)):
        assert abs(model.leaf[0, side] + quality.RATE * g[low].sum() / (h[low].sum() + quality.RIDGE)) < 1e-9


def test_one_risk_step_equals_differences():
    """Slopes of the risk against small differences of it, where its negative part is above 0 and where it is below."""
    rng = np.random.default_rng(3)
    loss = lambda z, sign: np.log1p(np.exp(-sign * z)).mean()
    for shift, clipped in ((0.0, False), (-6.0, True)):
        p, u, w = (rng.random((30, 6)) < 0.5).astype(float), (rng.random((80, 6)) < 0.3).astype(float), rng.normal(size=6)
        c = 0.1
        if clipped:  # positives far on the wrong side make the estimate of the negatives' risk negative
            w, c, u = np.full(6, -shift), 0.0, np.zeros((80, 6))
        prior = 0.4
        negative = lambda w, c: loss(u @ w + c, -1) - prior * loss(p @ w + c, -1)  # noqa: B023, E731
        whole = lambda w, c: prior * loss(p @ w + c, 1) + negative(w, c)  # noqa: B023, E731
        risk, dw, dc = toxicity.risk(w, c, p, u, prior)
        assert (negative(w, c) < 0) == clipped
        assert abs(risk - prior * loss(p @ w + c, 1) - max(0.0, negative(w, c))) < 1e-9
        goal = (lambda w, c: -negative(w, c)) if clipped else whole  # noqa: B023
        e = 1e-6
        slopes = [(goal(w + e * np.eye(6)[i], c) - goal(w - e * np.eye(6)[i], c)) / (2 * e) for i in range(6)]
        assert np.allclose(dw, slopes, atol=1e-5) and abs(dc - (goal(w, c + e) - goal(w, c - e)) / (2 * e)) < 1e-5


def test_the_risk_does_not_go_below_zero():
    """With few examples, unlabelled positives still score above negatives."""
    rng = np.random.default_rng(2)
    draw = lambda p: np.unique(np.concatenate([rng.integers(100, 4000, 30), [p] if p else []]).astype(np.int64))
    positive, unlabelled = [draw(7) for _ in range(60)], [draw(7 if i % 5 == 0 else 0) for i in range(600)]
    a, b = (np.bincount(np.concatenate(sets), minlength=4000) for sets in (positive, unlabelled))
    hashes = np.flatnonzero(a >= toxicity.LEAST)
    chosen = toxicity.choose(hashes, a[hashes], len(positive), b[hashes], len(unlabelled))
    assert 7 in chosen
    place = {int(h): i for i, h in enumerate(chosen)}
    own = lambda sets: [np.array([place[h] for h in s.tolist() if h in place], np.int64) for s in sets]
    model = toxicity.fit(toxicity.matrix(own(positive), len(chosen)), toxicity.matrix(own(unlabelled), len(chosen)), chosen, 0.2)
    steps = lambda sets: dict(zip(*np.unique(np.round([model.margin(r) / toxicity.STEP for r in own(sets)]).astype(int), return_counts=True), strict=True))
    cut = toxicity._cut(steps(positive), steps(unlabelled), 0.2)
    assert all(model.margin(r) >= cut for r in own([draw(7) for _ in range(50)]))
    assert all(model.margin(r) < cut for r in own([draw(0) for _ in range(50)]))


def test_places_of_words_equal_their_hashes():
    rng = random.Random(9)
    texts = [words(rng, 60).encode(), "Caf\u00e9 \u00e9t\u00e9s longwordindeed x".encode(), None, b""]
    hashes = np.unique(np.concatenate([toxicity.word_set(t) for t in texts]))[::3]
    columns = toxicity.Columns(hashes)
    for t in texts * 2:
        assert hashes[columns.of(t)].tolist() == sorted(set(toxicity.word_set(t).tolist()) & set(hashes.tolist()))


def test_samples_are_bounded_and_the_same(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 3 as y")
    rows = rows.union(rows.where("doc_id < 50")).unionAll(spark.range(3000).selectExpr("7 as doc_id", "1 as y"))
    got = drawn(rows, 100, "doc_id", "y").collect()
    assert len(got) == 100 and len(set(got)) == 100
    assert sorted(drawn(rows.repartition(7), 100, "doc_id", "y").collect()) == sorted(got)
    assert drawn(rows.limit(0), 100, "doc_id").count() == 0


def test_labels_of_one_class_and_ties_at_the_cut(spark):
    docs, labels, _ = frames(spark)
    good = labels.where("quality = 1 and toxic = 0")
    assert {r.predicted for r in quality.classify(docs, good).collect()} == {1}
    assert {r.predicted for r in toxicity.classify(docs, good).collect()} == {0}
    level = quality.classify(docs, labels.limit(0))
    assert {r.predicted for r in level.collect()} == {1}  # 0.5 is above 0.3 for all
    assert {r.predicted for r in quality.classify(docs, labels.limit(0), cut=0.5).collect()} == {1}  # a tie at the cut counts


def rule(url, rules=urls.RULES):
    """Host, path and longest rule, word for word."""
    if not url or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    stop = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop]), rest[stop:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://a.example.net", "HTTP://A.Example.NET/en/1", "https://example.net/en/x?y#z", "http://notexample.net/en/1", "http://example.com/de/", "http://x.example.com/fr/",
    "http://é.org/fr/é", "http://org/fr/", "http://borg/fr/1", "://net/", "a://b://net/x", "http://x.net?/en/", "http://x.net#f", "http://u:p@x.net:80/en/", "http://line\nbreak.net/en/\nx",
]


def test_url_rules_and_verdicts(spark):
    many = [f"http://good{i}.example.net/en/story-{i}" for i in range(60)] + [f"http://spam-track{i}.net/win?x={i}" for i in range(60)]
    other = ["http://good77.example.com/en/story-77", "http://spam-track9.com/win?x=3"]
    data = [(i, u, "h") for i, u in enumerate([*URLS, *many, *other])] + [(0, None, "again"), (None, "http://x.net/", "h")]
    data.insert(-2, (len(data), "http://long.com/" + "ab/" * 40_000, "h"))
    clashing = spark.createDataFrame(data, "page_id long, url string, host string").selectExpr("*", "1 as path", "2 as rule", "'x' as ruled", "3 as codes", "true as held", "0.5 as score")
    got = urls.judge(clashing).collect()
    assert len(got) == len(data)
    rows = by_id([r for r in got if r.page_id is not None] and spark.createDataFrame(got), "page_id")
    for i, u, _ in data[:-2]:
        host, path, own = rule(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, own), u
        if own:
            assert rows[i].verdict == urls.RULES[own]
    n = len(URLS) + len(many)
    assert (rows[n].verdict, rows[n + 1].verdict) == ("allow", "block")
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_language_models_equal_brute_force(spark):
    data = [(i, u) for i, u in enumerate([f"http://good{i}.example.net/en/{i}" for i in range(8)] + [f"http://bad.net/{i}x" for i in range(8)] + ["http://else.com/Q~é"])]
    got = by_id(urls.judge(spark.createDataFrame(data, "page_id long, url string")), "page_id")
    allowed = set("abcdefghijklmnopqrstuvwxyz0-._~:/?#[]@!$&'()+,;=%")
    fold = lambda u: "".join(c if c in allowed else "*" for c in ("0" if c.isdigit() else c.lower() for c in u))
    grams = lambda u: [("^^" + fold(u))[i : i + 3] for i in range(len(u))]
    counts = {k: [g for _, u in data if (own := rule(u)[2]) and urls.RULES[own] == k and hashlib.md5(u.encode()).hexdigest()[0] > "2" for g in grams(u)] for k in ("allow", "block")}

    def p(kind, gram):
        prob = 1 / len(urls.ALPHABET)
        for n in (1, 2, 3):
            tail, before = gram[3 - n :], gram[3 - n : 2]
            prob = (sum(g.endswith(tail) for g in counts[kind]) + urls.SMOOTH * prob) / (sum(g[3 - n : 2] == before for g in counts[kind]) + urls.SMOOTH)
        return prob

    for i, u in data:
        score = np.mean([np.log(p("allow", g) / p("block", g)) for g in grams(u)])
        assert abs(got[i].score - score) < 1e-6
