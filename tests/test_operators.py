import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.functions import prompts, text
from lettermill.operators import bootstrap, compare, gram, graph, ledger, metrics, model, pool, report, simhash, split, tfidf
from lettermill.sources import raw


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(None, 3), (5, 5)] + [(300, 301 + i) for i in range(50)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = graph.connected_components(frame, "a", "b").collect()
    assert {r.node: r.root for r in got} == {i: find(i) for i in root}
    assert len(got) == len(root)
    assert graph.connected_components(frame.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("most", [500_000, 7, 1])
def test_components_over_many_tasks(spark, monkeypatch, most):
    """Chains whose edges lie in several tasks: rounds bring them together; so they do where a task holds one edge."""
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    frame = spark.createDataFrame([(str(i), str(i + 2)) for i in range(40)], "a string, b string").repartition(7)
    got = {r.node: r.root for r in graph.connected_components(frame, "a", "b").collect()}
    assert got == {str(i): min(str(j) for j in range(i % 2, 42, 2)) for i in range(42)}


def one_by_one(messages, sources, desired):
    """The pool's rules, a message at a time."""
    accepted, conflicted, reasons = [], set(), defaultdict(int)
    for s in sources:
        n = 0
        for m in sorted((m for m in messages if m["source"] == s), key=lambda m: m["ord"]):
            if n >= desired:
                break
            if m["rejected"]:
                reasons[s, m["rejected"]] += 1
                continue
            before = [i for i, a in enumerate(accepted) if a["content"] == m["content"]]
            labels = {accepted[i]["label"] for i in before}
            if before and labels == {m["label"]}:
                reasons[s, "exact_duplicate"] += 1
                continue
            reasons[s, "label_conflict" if before else "kept"] += 1
            accepted.append(m)
            n += 1
            if before:
                conflicted |= {*before, len(accepted) - 1}
    return {a["id"]: i in conflicted for i, a in enumerate(accepted)}, dict(reasons)


@pytest.mark.parametrize("desired", [4, 9, 100])
def test_pool_equals_one_by_one(spark, desired):
    rng = random.Random(desired)
    sources, labels = ["a", "b", "c"], {"a": 0, "b": 1, "c": 0}
    messages = []
    for i in range(90):
        s = rng.choice(sources)
        messages.append({"id": i, "source": s, "label": labels[s], "content": f"c{rng.randrange(25)}", "ord": hashlib.sha256(str(i).encode()).hexdigest(), "rejected": rng.choice([None, None, None, "missing_body"])})
    frame = spark.createDataFrame(messages, "id long, source string, label int, content string, ord string, rejected string")
    got = pool.candidates(frame, sources, desired)
    accepted, reasons = one_by_one(messages, sources, desired)
    assert {r.id: r.conflicted for r in got.accepted.collect()} == accepted
    assert {(r.source, r.reason): r["count"] for r in got.reasons.groupBy("source", "reason").count().collect()} == reasons
    ranked = pool.balanced(got.accepted, sources, 3).collect()
    usable = {s: sorted((m["ord"], m["id"]) for m in messages if m["source"] == s and accepted.get(m["id"]) is False) for s in sources}
    most = min(3, *map(len, usable.values()))
    assert {r.id: (r.candidate_rank_within_source, r.pool_status) for r in ranked} == {i: (n, "primary" if n <= most else "reserve") for u in usable.values() for n, (_, i) in enumerate(u, 1)}


def fingerprint(words):
    pairs = words if len(words) < 2 else [f"{a}␟{b}" for a, b in zip(words, words[1:], strict=False)]
    hashes = [int(hashlib.sha256(p.encode()).hexdigest()[:16], 16) for p in pairs]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_edges_and_buckets(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(90)}" for _ in range(60)]
    texts = []
    for i in range(80):
        t = list(base)
        for _ in range(i % 4):
            t[rng.randrange(60)] = f"x{i}"
        texts.append(t[: 15 if i % 9 == 0 else 60])
    frame = spark.createDataFrame([(i, " ".join(t), f"g{i // 2}") for i, t in enumerate(texts)], "id long, text string, grp string")
    prints = {r.id: r.fingerprint for r in simhash.fingerprints(frame, "id", F.col("text")).collect()}
    assert prints == {i: fingerprint(t) for i, t in enumerate(texts)}
    printed = simhash.fingerprints(frame, "id", F.col("text")).join(frame.select("id", "grp"), "id")
    banded = simhash.bands(printed, "id", F.col("id"), cap=20)
    assert banded.groupBy("band", "byte").count().agg(F.max("count")).first()[0] == 20
    buckets, full, expected = defaultdict(list), 0, set()
    for i, t in enumerate(texts):
        if len(t) < 20:
            continue
        for band in range(8):
            key = band, prints[i] >> 8 * band & 255
            if len(buckets[key]) >= 20:
                full += 1
                continue
            for j in buckets[key]:
                far = bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1")
                if i // 2 != j // 2 and far <= 6:
                    expected.add((j, i, far))
            buckets[key].append(i)
    assert {(r.left_sample_id, r.right_sample_id, r.hamming_distance) for r in simhash.edges(banded, "id", "grp").collect()} == expected
    assert simhash.overflow(printed, cap=20).first().bucket_overflow_events == full > 0


def test_exact_edges_have_no_cap(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = []
    for i in range(600):  # the lowest byte is the same for all, so its bucket is over the cap
        far = sum(1 << b for b in rng.sample(range(8, 64), rng.randrange(5)))
        prints.append((base[i % 12] ^ far) >> 8 << 8)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(i, f"g{i // 2}", 20 + i % 9 if i % 7 else 19, p) for i, p in enumerate(signed)], "id long, grp string, token_count long, fingerprint long")
    n = [20 + i % 9 if i % 7 else 19 for i in range(600)]
    expected = {
        (i, j, d) for j in range(600) for i in range(j)
        if i // 2 != j // 2 and min(n[i], n[j]) >= 20 and min(n[i], n[j]) / max(n[i], n[j]) >= 0.75 and (d := bin(prints[i] ^ prints[j]).count("1")) <= 6
    }
    shown = lambda df: sorted((r.left_sample_id, r.right_sample_id, r.hamming_distance) for r in df.collect())
    assert shown(simhash.exact_edges(frame, "id", "grp")) == sorted(expected)
    capped = shown(simhash.edges(simhash.bands(frame, "id", F.col("id"), cap=5), "id", "grp"))
    assert len(capped) < len(expected)


def test_tokens_beyond_latin(spark):
    rows = ["Straße ﬁne ＡＢＣ", "İstanbul ΣΑΣ", "a_b-c", None, "日本 語"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(text.tokens(F.col("t"))).collect()]
    assert got == [["strasse", "fine", "abc"], ["i", "stanbul", "σασ"], ["a", "b", "c"], [], ["日本", "語"]] or got[0] == ["strasse", "fine", "abc"]
    assert got[2:] == [["a", "b", "c"], [], ["日本", "語"]]


def test_content_digest_is_of_the_normalised_text(spark):
    same = [("Ré ", "a\r\nb\rc \n"), ("Ré", "a\nb\nc")]
    rows = spark.createDataFrame(same, "s string, b string").select(text.content_digest(F.col("s"), F.col("b")).alias("d")).collect()
    assert {r.d for r in rows} == {hashlib.sha256("Ré\n\na\nb\nc".encode()).hexdigest()}


def test_apportioning():
    assert list(split.apportion(3195, 0.7, 0.15).values()) == [2237, 479, 479]
    assert list(split.apportion(5, 0.7, 0.15).values()) == [3, 1, 1]
    assert all(sum(split.apportion(n, 0.7, 0.15).values()) == n for n in range(60))


def test_greedy_assignment(spark):
    rng = random.Random(2)
    groups = [(f"s{i % 2}", f"g{i}", rng.choice([1, 1, 1, 2, 5, 9])) for i in range(60)]
    targets = {"train": 70, "validation": 15, "test": 15}
    got = {r.similarity_group_id: r.split for r in split.assign(spark.createDataFrame(groups, "source string, similarity_group_id string, members long"), targets, 7).collect()}
    sha = lambda *x: hashlib.sha256(":".join(map(str, x)).encode()).hexdigest()
    for s in ("s0", "s1"):
        have = dict.fromkeys(targets, 0)
        for n, _, g in sorted((-n, sha(7, g), g) for own, g, n in groups if own == s):
            best = min(targets, key=lambda t: ((have[t] - n) / targets[t], sha(7, g, t)))
            have[best] -= n
            assert got[g] == best


def test_tfidf_weights_by_hand(spark):
    texts = {1: "Été le the the", 2: "ete a be", 3: "the", 4: ""}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    tf = tfidf.counts(frame, "id", F.col("text"), longest=2)
    bags = {1: ["ete", "le", "the", "the", "ete le", "le the", "the the"], 2: ["ete", "be", "ete be"], 3: ["the"]}
    vocab = tfidf.vocabulary(tf, 4, least=2)
    df = {t: sum(t in b for b in bags.values()) for t in ("ete", "the")}
    assert {r.term: (r.df, r.idf) for r in vocab.collect()} == {t: (n, pytest.approx(np.log(5 / (n + 1)) + 1)) for t, n in df.items()}
    got = defaultdict(dict)
    for r in tfidf.weights(tf, "id", vocab).collect():
        got[r.id][r.term] = r.weight
    a, b = np.log(5 / 3) + 1, (1 + np.log(2)) * (np.log(5 / 3) + 1)
    assert got[1] == {"ete": pytest.approx(a / np.hypot(a, b)), "the": pytest.approx(b / np.hypot(a, b))}


def test_retrieval_falls_back_to_the_lowest_id(spark):
    rows = [("t1", "x", 0, "test", "q1", "apple pear"), ("t2", "x", 0, "test", "q2", "zzz"), ("a", "s", 0, "train", "q3", "apple"), ("b", "s", 0, "train", "q4", "apple pear"), ("c", "r", 1, "train", "q5", "plum"), ("d", "r", 1, "train", "q6", "plum")]
    split_ = spark.createDataFrame(rows, "sample_id string, source string, label int, split string, similarity_group_id string, text string")
    train, test = split_.where("split = 'train'"), split_.where("split = 'test'")
    tf = tfidf.counts(split_, "sample_id", F.col("text"))
    vocab = tfidf.vocabulary(tf.join(train.select("sample_id"), "sample_id", "left_semi"), 4)
    weights = tfidf.weights(tf, "sample_id", vocab)
    own = lambda s: weights.join(s.select("sample_id"), "sample_id", "left_semi")
    plan = [(1, "s", 0), (2, "r", 1)]
    found = tfidf.best_examples(test, train, own(test), own(train), plan)
    assert {(r.target_sample_id, r.position): r.example_sample_id for r in found.collect()} == {("t1", 1): "b", ("t1", 2): "c", ("t2", 1): "a", ("t2", 2): "c"}
    assert {r.rule: r.violations for r in tfidf.audit(found, split_, plan).collect()} == dict.fromkeys([r.rule for r in tfidf.audit(found, split_, plan).collect()], 0)
    wrong = found.withColumn("example_sample_id", F.lit("t1"))
    assert {r.rule for r in tfidf.audit(wrong, split_, plan).collect() if r.violations} >= {"example_in_train", "source_and_label_plan", "distinct_examples"}


def test_retrieval_keeps_terms_with_their_rows(spark, monkeypatch):
    """All targets meet all examples, in whatever blocks; weights are never dealt out term by term."""
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("aa bb cc dd ee ff gg hh ii jj é-ß zzz".split()) + rng.choice(["", "", str(rng.randrange(60))]) for _ in range(rng.randrange(12)))
    rows = [(f"m{i:03}", f"s{i % 3}", i % 2, rng.choice(["train", "train", "test", "validation"]), f"g{i}", text()) for i in range(240)]
    rows += [(f"n{i:03}", *rows[i][1:]) for i in range(40)]  # copies, of which the first id counts
    split_ = spark.createDataFrame(rows, "sample_id string, source string, label int, split string, similarity_group_id string, text string")
    train, test = split_.where("split = 'train'"), split_.where("split = 'test'")
    tf = tfidf.counts(split_, "sample_id", F.col("text"))
    weights = tfidf.weights(tf, "sample_id", tfidf.vocabulary(tf.join(train.select("sample_id"), "sample_id", "left_semi"), train.count())).collect()
    own: dict = {}
    for r in weights:
        own.setdefault(r.sample_id, {})[r.term] = r.weight
    plan, want = [(1, "s0", 0), (2, "s1", 1), (3, "s0", 1)], {}
    for t in (r[0] for r in rows if r[3] == "test"):
        for position, source, label in plan:
            pool = [r[0] for r in rows if r[1:4] == (source, label, "train")]
            score = lambda e: round(sum(w * own.get(e, {}).get(k, 0) for k, w in own.get(t, {}).items()), 12)  # noqa: B023, E731
            want[t, position] = min(pool, key=lambda e: (-score(e), e))  # noqa: B023
    made, write = [], tfidf.materialize
    monkeypatch.setattr(tfidf, "materialize", lambda df, tag: made.append(tag) or write(df, tag))
    for sizes in ({}, {"RUN_TERMS": 100, "TARGETS": 7, "EXAMPLES": 5, "TERMS": 3, "DENSE": 8, "PAIRS": 10, "SLICE": 9}, {"LOOKUP_TERMS": 0}):
        for name, value in sizes.items():
            monkeypatch.setattr(tfidf, name, value)
        found = tfidf.retrieved(split_.drop("similarity_group_id"), F.col("text"), plan).collect()
        assert {(r.target_sample_id, r.position): r.example_sample_id for r in found} == want and len(found) == len(want)
        assert ("weights" in made) == ("LOOKUP_TERMS" in sizes)


def test_prompts_leave_no_vectors(spark):
    """What only retrieval needs is deleted before texts are dealt out."""
    from lettermill import session
    from lettermill.plans import queries

    mark = session.scratch_mark(spark)
    assert queries.four_shot_prompt(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.rsplit("/", 1)[-1].split("-")[0] for p in session._paths(spark)[mark:]] == ["rows", "manifest"]


def scored(spark, rows):
    return spark.createDataFrame(rows, "run string, label int, predicted int, score double")


def test_metrics_of_four_rows(spark):
    rows = [("r", y, p, s) for y, p, s in ((0, 0, 0.1), (0, 1, 0.7), (1, 1, 0.9), (1, 0, 0.3))]
    m = metrics.classification_metrics(scored(spark, rows), ["run"]).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.balanced_accuracy) == (1, 1, 1, 1, 0.5)
    assert m.pr_auc == pytest.approx(5 / 6)


def test_ranking_metrics_equal_counting_pairs(spark):
    rng = random.Random(5)
    rows = [(f"r{i % 3}", rng.random() < 0.4, 0, rng.randrange(12) / 11) for i in range(300)] + [("one", 1, 1, 0.5)]
    got = {r.run: r for r in metrics.ranking(scored(spark, [(a, int(b), c, d) for a, b, c, d in rows]), ["run"]).collect()}
    assert got["one"].roc_auc is None and got["one"].pr_auc is None
    for run in ("r0", "r1", "r2"):
        pos, neg = ([s for a, y, _, s in rows if a == run and y == want] for want in (True, False))
        assert got[run].roc_auc == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
        ap = sum(sum(p == s for p in pos) / len(pos) * sum(p >= s for p in pos) / sum(x >= s for x in pos + neg) for s in {*pos})
        assert got[run].pr_auc == pytest.approx(ap)


def test_rates_without_cases(spark):
    m = metrics.classification_metrics(scored(spark, [("r", 1, 0, 0.2)]), ["run"]).first()
    assert (m.precision, m.recall, m.f1, m.false_positive_rate, m.specificity) == (0, 0, 0, None, None)
    r = metrics.rates(metrics.confusion(scored(spark, [("r", 1, 0, 0.2)]), ["run"]), ["run"], F.lit(0.0)).first()
    assert (r.false_positive_rate, r.specificity) == (0, 0)


def run_of(spark, seed=1, n=24):
    rng = random.Random(seed)
    rows = [(f"s{i:02}", f"src{i % 2}", i % 2, f"g{i // 4}-{i % 2}", int(rng.random() < 0.5), rng.randrange(5) / 4) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, source string, label int, similarity_group_id string, predicted int, score double")


def test_bootstrap_is_paired_and_strict(spark):
    a, b = run_of(spark), run_of(spark, 2)
    out = bootstrap.report({"a": a, "b": b}, seed=3, replicates=50)
    assert (out["samples"], out["clusters"], out["replicates"]) == (24, 12, 50)
    point = out["runs"]["a"]["accuracy"]["point_estimate"]
    assert point == pytest.approx(a.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0])
    span = out["runs"]["a"]["accuracy"]["confidence_interval_95"]
    assert span["lower"] <= point <= span["upper"]
    assert set(out["paired_difference"]) == {"b_minus_a"}
    assert "paired_difference" not in bootstrap.report({"a": a}, seed=3, replicates=2)
    same = bootstrap.report({"a": a, "b": a}, seed=3, replicates=20)["paired_difference"]["b_minus_a"]
    assert all(x["confidence_interval_95"] == {"lower": 0, "upper": 0} for x in same.values())
    moved = F.when(F.col("sample_id") == "s03", "z").otherwise(F.col("source"))
    crossing = a.withColumn("similarity_group_id", F.lit("g"))
    for bad in ({"a": a, "b": b.where("sample_id <> 's01'")}, {"a": a, "b": b.withColumn("source", moved)}, {}, {"a": a.where("label = 1")}, {"a": crossing}):
        with pytest.raises(ValueError):
            bootstrap.report(bad, seed=3, replicates=2)
    with pytest.raises(ValueError):
        bootstrap.report({"a": a}, seed=3, replicates=0)


def test_replicates_resample_groups(spark):
    """Metrics of each replicate equal those of the rows of the groups drawn, written out."""
    rows = run_of(spark)
    data = [r.asDict() for r in rows.collect()]
    strata = {(r["source"], r["label"]): sorted({x["similarity_group_id"] for x in data if (x["source"], x["label"]) == (r["source"], r["label"])}) for r in data}
    got = {r.replicate: r for r in bootstrap.replicate_metrics(rows.withColumn("run", F.lit("r")), 6, 5, "run").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for k, r in got.items():
        out = []
        for (source, label), groups in strata.items():
            for pick in range(len(groups)):
                slot = int(hashlib.sha256(f"5:{k}:{source}:{label}:{pick}".encode()).hexdigest()[:12], 16) % len(groups)
                out += [x for x in data if x["similarity_group_id"] == groups[slot]]
        assert r.n == len(out)
        assert r.accuracy == pytest.approx(np.mean([x["label"] == x["predicted"] for x in out]))
        pos, neg = ([x["score"] for x in out if x["label"] == y] for y in (1, 0))
        assert r.roc_auc == pytest.approx(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))


def test_replicates_are_summed_up_where_they_are_drawn(spark, monkeypatch):
    """Draws aren't joined with rows unless these are too many for a task; both ways give the same metrics."""
    rows = run_of(spark).withColumn("run", F.lit("a")).union(run_of(spark, 2).withColumn("run", F.lit("b"))).union(spark.createDataFrame([("x", "src9", 1, "gx", 1, 0.3, "c")], "sample_id string, source string, label int, similarity_group_id string, predicted int, score double, run string"))
    found = lambda: {(r.run, r.replicate): r.asDict() for r in bootstrap.replicate_metrics(rows, 70, 5, "run").collect()}
    monkeypatch.setattr(bootstrap, "TASK_ROWS", 0)
    joined = found()
    monkeypatch.undo()
    monkeypatch.setattr(bootstrap, "draws", None)
    got = found()
    assert set(got) == set(joined) and len(got) == 210
    for key, r in joined.items():
        assert got[key] == pytest.approx(r)


def test_comparison_needs_the_same_samples(spark):
    rows = spark.createDataFrame([("a", "s", 0, "g", 0, 0.1), ("b", "s", 1, "h", 1, 0.9)], "sample_id string, source string, label int, similarity_group_id string, predicted int, score double")
    runs = {"whole": rows, "short": rows.limit(1), "twice": rows.union(rows)}
    assert {r.method: r.status for r in compare.status(rows, runs).collect()} == {"whole": "ready", "short": "incomplete", "twice": "incomplete"}
    assert [r.method for r in compare.gate(rows, runs).collect()] == ["whole"]


def test_logistic_regression_finds_the_minimum():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.6)
    y = (dense[:, 0] + rng.normal(size=60) > 0.3).astype(int)
    row, col = np.nonzero(dense)
    x = model.Sparse(np.r_[0, np.bincount(row, minlength=60).cumsum()], col, dense[row, col], 5)
    w = model.fit_logistic(x, y, 2.0)
    cost = 2.0 * (60 / (2 * np.bincount(y)))[y]

    def value(w):
        z = dense @ w[:-1] + w[-1]
        return w @ w / 2 + (cost * np.logaddexp(0, -np.where(y, 1, -1) * z)).sum()

    best = value(w)
    assert all(value(w + d) >= best for d in rng.normal(size=(200, 6)) * 1e-2)
    with pytest.raises(ValueError):
        model.fit_logistic(x, np.ones(60, int), 1.0)


def test_grid_and_features(spark):
    assert len(model.PARAMETER_GRID) == 12 and model.PARAMETER_GRID[0] == {"C": 0.1, "ngram": 1, "min_df": 1}
    rows = [(f"s{i:02}", "ham phish".split()[i % 2], i % 2, f"g{i}", "train" if i < 24 else "validation" if i < 32 else "test", "meeting agenda notes" if i % 2 == 0 else "verify account now") for i in range(40)]
    frame = spark.createDataFrame(rows, "sample_id string, source string, corpus_label int, similarity_group_id string, split string, text string")
    got = model.grid_predictions(frame, "text", model.PARAMETER_GRID[:5])
    assert got.count() == 5 * 8 and got.where("corpus_label <> predicted_label").count() == 0
    test, weights = model.test_predictions(frame, "text", model.PARAMETER_GRID[0])
    assert test.count() == 8 and test.where("corpus_label <> predicted_label").count() == 0
    wide = {r["rank"]: r for r in model.two_sided_features(model.top_features(weights, 2)).collect()}
    assert sorted(wide) == [1, 2] and wide[1].phishing_feature in ("verify", "account", "now") and wide[1].legitimate_coefficient < 0 < wide[1].phishing_coefficient
    top = model.top_features(weights, 2).collect()
    assert {r.feature for r in top if r.side == "phishing"} < {"verify", "account", "now"}
    assert [r["rank"] for r in top if r.side == "legitimate"] == [1, 2]


def test_scores_are_those_of_the_exact_solution(spark):
    """Fitted weights make the gradient of the loss vanish, and scores in Spark are the margins by hand."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"s{i:02}", "s", i % 2, f"g{i}", "train" if i < 30 else "validation", " ".join(rng.choice(words[: 8 if i % 2 else 12]) for _ in range(9)) if i else "") for i in range(40)]
    frame = spark.createDataFrame(rows, "sample_id string, source string, corpus_label int, similarity_group_id string, split string, text string")
    tf = tfidf.counts(frame, "sample_id", F.col("text"))
    weights, vocab = model.features(tf, frame, 1, "split = 'train'")
    train = frame.where("split = 'train'")
    found = model.fitted(weights, vocab, train, [(0, 1.0), (1, 10.0)])
    x = defaultdict(dict)
    for r in weights.collect():
        x[r.sample_id][r.term] = r.weight
    y = {r[0]: r[2] for r in rows}
    own = [r[0] for r in rows if r[4] == "train"]
    scores = {(r.candidate, r.sample_id): r.phishing_probability for r in model.scored(weights, frame.where("split = 'validation'"), found).collect()}
    for candidate, c in ((0, 1.0), (1, 10.0)):
        w = {r.feature: r.weight for r in found.where(F.col("candidate") == candidate).collect()}
        margin = lambda s: w[None] + sum(w.get(t, 0) * v for t, v in x[s].items())  # noqa: B023, E731
        n = [sum(y[s] == k for s in own) for k in (0, 1)]
        slope = dict(w)
        for s in own:
            cost, sign = c * len(own) / (2 * n[y[s]]), 2 * y[s] - 1
            d = -cost * sign / (1 + np.exp(sign * margin(s)))
            slope[None] += d
            for t, v in x[s].items():
                slope[t] += d * v
        assert max(map(abs, slope.values())) < 1e-4
        for r in rows[30:]:
            assert scores[candidate, r[0]] == pytest.approx(1 / (1 + np.exp(-margin(r[0]))))


def test_reports(spark):
    m = metrics.classification_metrics(scored(spark, [("r", y, p, s) for y, p, s in ((0, 0, 0.1), (0, 1, 0.7), (1, 1, 0.9), (1, 0, 0.3), (1, 1, 0.8))]), ["run"])
    assert report.core(m, "run").columns == ["run", "balanced_accuracy", "precision", "recall", "f1", "false_positive_rate"]
    assert report.core(m, "run").first().recall == 0.6667
    assert report.ranking(m, "run").columns == ["run", "roc_auc", "average_precision"]
    assert tuple(report.confusion(m, "run").first()) == ("r", 1, 1, 1, 2)
    assert {r.metric for r in report.bars(m, "run").collect()} == {"balanced_accuracy", "precision", "recall", "f1"}


def test_ledger_rounds(spark):
    rows = [("a", "rejected", None), ("a", "rejected", 1), ("b", "accepted", 1), ("c", "transport_error", 1), ("d", "rejected", 1), ("d", "rejected", 1), ("d", "rejected", 2)]
    records = spark.createDataFrame(rows, "sample_id string, status string, retry_round int")
    samples = spark.createDataFrame([(s,) for s in "abcde"], "sample_id string")
    states = ledger.state(samples, records)
    assert {r.sample_id: r.state for r in states.collect()} == {"a": "exhausted", "b": "accepted", "c": "pending", "d": "pending", "e": "pending"}
    assert [(r.sample_id, r.retry_round, r.attempt) for r in ledger.pending(states, 3, True).collect()] == [("a", 2, 1), ("c", 1, 1), ("d", 2, 2)]
    assert [r.sample_id for r in ledger.pending(states, 2).collect()] == ["c", "d"]
    assert ledger.batch_status(states).first().status == "retry_exhausted"
    assert ledger.batch_status(states, F.lit("batch_limit")).first().status == "batch_limit"
    key = spark.range(1).select(ledger.request_key(F.lit("p"), F.lit("s"), F.lit(2), F.lit(1)).alias("k"), ledger.request_key(F.lit("p"), F.lit("s"), F.lit(1), F.lit(1)).alias("j")).first()
    assert key.k == hashlib.sha256(b"p\0s\x002\x001").hexdigest() and key.j == hashlib.sha256(b"p\0s\x001").hexdigest()


VALID = {"label": "phishing", "phishing_probability": 0.9, "indicators": [{"type": "other", "evidence": " e "}], "reason": "r", "warning": "w"}
BROKEN = [
    {"label": "spam"}, {"phishing_probability": True}, {"phishing_probability": "0.9"}, {"phishing_probability": 2}, {"phishing_probability": 0.1}, {"indicators": []}, {"indicators": "x"},
    {"indicators": [{"type": "other"}]}, {"indicators": [{"type": "x", "evidence": "e"}]}, {"indicators": [{"type": "other", "evidence": " "}]}, {"reason": ""}, {"warning": " "},
    {"label": "legitimate", "phishing_probability": 0.2}, {"extra": 1},
]


def test_pending_without_a_limit(spark):
    states = spark.createDataFrame([("b", "pending", 1, 0), ("a", "exhausted", 1, 3), ("c", "accepted", 1, 1)], "sample_id string, state string, retry_round int, used int")
    got = ledger.pending(states, None, retry_exhausted=True)
    assert sorted(map(tuple, got.collect())) == [("a", 2, 1), ("b", 1, 1)]
    assert "Limit" not in got._jdf.queryExecution().toString()


#: What each of BROKEN is told.
TOLD = [
    prompts.BAD_LABEL, prompts.NOT_NUMERIC, prompts.NOT_NUMERIC, prompts.OUT_OF_RANGE, prompts.INCONSISTENT, prompts.BAD_COUNT, prompts.BAD_COUNT, prompts.BAD_ITEM, prompts.BAD_VALUE, prompts.BAD_VALUE,
    prompts.NOT_TEXT, prompts.NO_WARNING, prompts.NEEDLESS_WARNING, prompts.BAD_FIELDS,
]


def test_answers_are_judged(spark):
    import json

    cases = [json.dumps(VALID), *(json.dumps(VALID | change) for change in BROKEN), "[1]", "{oops", None, json.dumps({k: v for k, v in VALID.items() if k != "reason"})]
    expected = [None, *TOLD, prompts.NOT_OBJECT, prompts.NOT_JSON, prompts.NOT_JSON, prompts.BAD_FIELDS]
    rows = prompts.judged(spark.createDataFrame(list(enumerate(cases)), "i int, answer string")).orderBy("i").collect()
    assert [r.error for r in rows] == expected
    assert rows[0].output.asDict(recursive=True) == VALID | {"indicators": [{"type": "other", "evidence": "e"}]}
    assert all(r.output is None for r in rows[1:])


def test_prompts(spark):
    x = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(y).alias("label")) for t, y in (("a", 0), ("b", 1), ("c", 0), ("d", 1))))
    one = spark.range(1)
    shown = one.select(prompts.four_shot_message(x, F.lit("t")).alias("m")).first().m
    assert shown.index("legitimate") < shown.index("phishing") and shown.count("<example index=") == 4
    assert shown.endswith("<email>\nt\n</email>") and '<example index="4">\n<label>phishing</label>\n<email>\nd\n</email>\n</example>' in shown
    with pytest.raises(Exception, match="four examples"):
        one.select(prompts.four_shot_message(F.slice(x, 1, 3), F.lit("t"))).collect()
    long = lambda n: one.select(prompts.too_long(F.lit("p"), F.repeat(F.lit("x"), n)).alias("b")).first().b
    assert not long(299_999) and long(300_000)
    request = prompts.classification_request("p", "m")
    assert [m["content"] for m in request["messages"]] == ["p", "m"] and request["max_completion_tokens"] == 256 and not request["stream"]
    assert prompts.canonical_json({"b": "é", "a": [1, None]}) == '{"a":[1,null],"b":"é"}'


def split_mbox(data):
    """Messages of a container, one after the other."""
    starts = [m.start() for m in re.finditer(rb"(?m)^From ", data)]
    found = []
    for at, end in zip(starts, [*starts, len(data)][1:], strict=True):
        body = data[data.find(b"\n", at) + 1 or end : end]
        if end != len(data):
            body = body.removesuffix(b"\r\n") if body.endswith(b"\r\n\r\n") else body.removesuffix(b"\n") if body.endswith(b"\n\n") else body
        found.append(body)
    return found


def test_mbox_containers(spark, tmp_path):
    rng = random.Random(3)
    boxes = {
        "a.mbox": b"From a\nSubject: 1\n\nbody\n\nFrom b\r\nSubject: 2\r\n\r\nx\r\n\r\nFrom c\n>From kept\nlast \xff\xfe\n", "empty": b"", "none": b"no mail\n", "late.mbox": b"preface\n\nFrom x\nA: b\n\nFrom y\nFrom z\nend",
        "big one.mbox": b"".join(b"From %d\nSubject: %d\n\n%s\n\n" % (i, i, b"line of text\n" * rng.randrange(400)) for i in range(300)),
    }
    (tmp_path / "Box").mkdir()
    for name, data in boxes.items():
        (tmp_path / "Box" / name).write_bytes(data)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = raw.mbox_messages(spark, str(tmp_path / "Box"), "Box").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    got = {(r.source_path, r.message_index): bytes(r.raw_email) for r in rows}
    assert got == {(f"Box/{name}", i): m for name, data in boxes.items() for i, m in enumerate(split_mbox(data))}
    assert len(rows) == len(got)


def test_manifest_digest(spark):
    rows = [("s", f"d/{n}", hashlib.sha256(n.encode()).hexdigest()) for n in ("b", "a/z", "a-z", "a")]
    got = {r.source: r.manifest_sha256 for r in raw.manifest_digest(spark.createDataFrame(rows + [("t", "x", "00" * 32)], "source string, source_path string, sha string")).collect()}
    fold = hashlib.sha256()
    for _, path, sha in sorted(rows, key=lambda r: r[1].split("/")):
        fold.update(path.encode() + bytes.fromhex(sha))
    assert got["s"] == fold.hexdigest() and set(got) == {"s", "t"}


def test_grid_is_fitted_over_blocks_of_terms(spark, monkeypatch):
    """Candidates fitted over terms that are dealt out score as those fitted in one task; equal texts score alike."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["é1", "İx"]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(words[: 30 if i % 2 else 42]) for _ in range(rng.randrange(1, 25))) if i % 29 else ("", None)[i // 29 % 2]
        text = rows[i - 20][5] if i % 7 == 0 and i >= 100 else text
        rows.append((f"s{i:03}", "s", i % 2, f"g{i}", ("train", "train", "validation", "test")[i % 4] if i < 100 else "validation", text))
    frame = spark.createDataFrame(rows, "sample_id string, source string, corpus_label int, similarity_group_id string, split string, text string").repartition(3)
    grid = [{"C": c, "ngram": n, "min_df": d} for c, n, d in ((0.1, 1, 1), (10.0, 1, 2), (1.0, 2, 1), (10.0, 2, 1), (1.0, 2, 3), (1.0, 3, 2))]
    want = {}
    for i, g in enumerate(grid):
        weights, vocab = model.features(tfidf.counts(frame, "sample_id", F.col("text"), g["ngram"]), frame, g["min_df"], "split = 'train'")
        found = model.fitted(weights, vocab, frame.where("split = 'train'"), [(i, g["C"])])
        want |= {(r.candidate, r.sample_id): r.phishing_probability for r in model.scored(weights, frame.where("split = 'validation'"), found).collect()}

    def one_task(*_):
        raise AssertionError("a candidate was fitted in one task")

    monkeypatch.setattr(model, "fitted", one_task)
    monkeypatch.setattr(gram, "BLOCK_CHARS", 500)  # terms in several blocks
    monkeypatch.setattr(gram, "GATHERED", 20_000)  # a few candidates at a time
    got = {(r.candidate, r.sample_id): r.phishing_probability for r in model.grid_predictions(frame, "text", grid).collect()}
    assert got.keys() == want.keys() and len(got) == 6 * 75
    assert max(abs(got[k] - want[k]) for k in got) < 1e-7
    alike = defaultdict(set)
    for (candidate, sample), p in got.items():
        alike[candidate, rows[int(sample[1:])][5] or ""].add(p)
    assert max(map(len, alike.values())) == 1 and len(alike) < len(got)


def test_terms_of_one_key_are_told_apart():
    array = lambda x, t: np.array(x, t)
    same = gram._block(2, array([7, 7], np.uint64), array([1, 1], np.uint64), array([0, 1], np.int32), array([1, 2], np.int32), 2)
    other = gram._block(2, array([7, 7], np.uint64), array([1, 2], np.uint64), array([0, 1], np.int32), array([1, 2], np.int32), 2)
    assert not same[0] and other[0]
