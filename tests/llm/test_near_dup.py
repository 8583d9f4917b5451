import random

import numpy as np
import pytest

from lettermill.llm import embed, minhash
from lettermill.llm.words import mix, shingles

from .data import by_id, documents, near_copies, words


def components(ids, linked):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(m) for m in groups.values() for i in m}


def shingle_sets(rows, width):
    out = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


@pytest.mark.parametrize(("width", "percent", "options"), [(3, 85, {}), (5, 80, {"small": 2, "levels": 2, "block": 3})])
def test_near_duplicates_equal_brute_force(spark, width, percent, options):
    rows = near_copies()
    rows += [(len(rows), None, "s0"), (len(rows) + 1, "", "s1"), (len(rows) + 2, " \t\n", None), (len(rows) + 3, words(random.Random(1), 30000), "s2"), (len(rows) + 4, "a b", "s"), (len(rows) + 5, "A\nB", "s")]
    sets = shingle_sets(rows, width)
    expected = components([r[0] for r in rows], lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))
    got = by_id(minhash.near_duplicates(documents(spark, rows), width, percent, **options))
    assert {i: (g.n_shingles, g.component_id, g.kept) for i, g in got.items()} == {r[0]: (len(s), expected[r[0]], expected[r[0]] == r[0]) for r, s in zip(rows, sets, strict=True)}


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    same = words(random.Random(2), 50)
    rows = [(1, same, "a"), (1, same, "a"), (1, "other text altogether here now", "a"), (None, same, "a"), (0, "", "a")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [(False, 0, 0, 0, True), (False, 1, 1, 1, True), (False, 1, 46, 1, True), (False, 1, 46, 1, True), (True, 0, 46, 1, False)]


def test_distinct_keeps_one_of_each_group_and_all_columns(spark):
    rows = near_copies(seed=9)
    docs = documents(spark, [*rows, rows[0], rows[3], rows[3], (900, None, "x"), (901, "", "x")])
    sets = shingle_sets(rows, 5)
    expected = components([r[0] for r in rows], lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    got = minhash.distinct(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({*expected.values(), 900, 901})


def test_empty_tables(spark):
    assert minhash.near_duplicates(documents(spark, []).limit(0)).count() == 0
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_tree_splits_less_than_it_keeps():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 2000, dtype=np.uint64)
    a = np.unique(base[:1000])
    b = np.unique(np.concatenate([base[:920], base[1000:1080]]))  # similarity about 0.85
    found = 0
    for t in range(200):
        sk = minhash.sketch([a, b])
        rows, names = minhash.branch(np.full(2, t + 1, np.uint64), sk, 0.85)
        mine = [set(names[rows == i].tolist()) for i in (0, 1)]
        found += bool(mine[0] & mine[1])
    assert found / 200 > 0.75


DEPTHS = 12


def test_trees_grow_with_depth():
    for similarity in (0.8, 0.85):
        needed = [minhash.trees_for(similarity, depth) for depth in range(1, DEPTHS + 1)]
        assert needed == sorted(needed) and needed[1] <= minhash.TREES < needed[-1]
        assert all(minhash.missed(similarity, d, t) <= minhash.MISS for d, t in enumerate(needed, 1))
        assert minhash.missed(similarity, 1, 1000) < 2 * minhash.UNLIKE


def grown_apart(rng, s, depth, trees, pairs):
    """Which of so many pairs of sketches of a similarity no tree, grown by branch(), brings together at a depth."""
    same = rng.random((pairs, minhash.POSITIONS)) < s
    a = rng.integers(0, 1 << 32, same.shape, dtype=np.uint32)
    b = np.where(same, a, a + 1).astype(np.uint32)
    return same.sum(axis=1), a, b, depth, trees


@pytest.mark.parametrize(("threshold", "s", "depth", "trees"), [(0.8, 0.8, 6, 4), (0.85, 0.85, 3, None), (0.85, 0.9, 6, None), (0.85, 0.95, 9, None), (0.8, 0.8, 9, None), (0.8, 0.85, 3, None)])
def test_recall_of_trees_by_similarity(threshold, s, depth, trees):
    """The chance to miss a pair agrees with trees grown by branch() for pairs of sketches; by default it is below MISS."""
    pairs, rng = 3000, np.random.default_rng(5)
    agree, a, b, _, _ = grown_apart(rng, s, depth, trees, pairs)
    chosen = trees or minhash.trees_for(threshold, depth)
    lost = np.ones(pairs, bool)
    for t in range(chosen):
        own, nodes = np.arange(pairs), mix(np.arange(pairs, dtype=np.uint64) * np.uint64(chosen) + np.uint64(t))
        for _ in range(depth):
            (ra, na), (rb, nb) = minhash.branch(nodes, a[own], threshold), minhash.branch(nodes, b[own], threshold)
            both = na == nb
            own, nodes = own[ra[both]], na[both]
        lost[own] = False
    lost |= agree < minhash.agreement_cut(threshold)
    if trees:
        assert abs(lost.mean() - minhash.missed(s, depth, trees)) < 0.02
    else:
        assert lost.sum() <= 3


def test_many_near_copies_under_one_id(spark):
    """Rows that share an id are told apart by their texts; repeats of one text come once."""
    rng = random.Random(11)
    base = words(rng, 120, 5000).split()
    texts = []
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
        texts.append(" ".join(copy))
    frame = documents(spark, [(7, t, "s") for t in texts] + [(7, texts[0], "s")] * 40 + [(9, words(rng, 90, 5000), "s"), (None, texts[1], "s")])
    got = minhash.near_duplicates(frame, block=16).collect()
    assert len(got) == 102
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(7, 7, True), (9, 9, True), (None, 7, False)}


def test_forest_of_a_block():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))
    some = {frozenset(map(int, e)) for e in minhash.linked(sets, 50, 100, first=3)}
    expected = components(list(range(40)), lambda i, j: j < 3 and linked(i, j))
    assert components(list(range(40)), lambda i, j: frozenset((i, j)) in some) == expected
    forest = minhash.linked(sets, 50, 100)
    assert all(linked(i, j) for i, j in forest)
    brute = components(list(range(40)), linked)
    chosen = {frozenset(map(int, e)) for e in forest}
    assert components(list(range(40)), lambda i, j: frozenset((i, j)) in chosen) == brute
    assert len(shingles(b"one two", 3)) == 1


EXACT = {"reach": None, "cells": 3.0, "block": 7, "sample": 60}


@pytest.mark.parametrize("options", [{"reach": None}, EXACT, {}])
def test_embeddings_equal_brute_force(spark, options):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    rows = [base[i % 40] + rng.normal(size=8) * (0.05, 0.12, 0.2)[i % 3] for i in range(160)]
    rows += [rows[0], rows[0] * 3, base[1] * 1e200, np.zeros(8), np.full(8, np.nan), np.array([np.inf] + [0] * 7)]
    data = [(i, [float(x) for x in r], 1) for i, r in enumerate(rows)] + [(900, None, 1), (901, [1.0, None], 1), (902, [], 1), (903, [1.0, 2.0], 1), (904, [2.0, 4.0], 1)]
    got = by_id(embed.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, uid int"), **options), "vec_id")
    unit = {}
    for i, v, _ in data:
        x = np.array([np.nan if e is None else e for e in v or []], float)
        if x.size and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    ids = [d[0] for d in data]
    link = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9
    n_links = {a: sum(link(a, b) for b in ids if b != a) for a in ids}
    expected = components(ids, lambda i, j: link(ids[i], ids[j]))
    if options:
        assert {i: (g.n_links, g.component_id, g.kept) for i, g in got.items()} == {a: (n_links[a], expected[a], expected[a] == a) for a in ids}
    else:
        assert all(g.n_links <= n_links[i] and g.component_id >= expected[i] for i, g in got.items())
        assert sum(g.n_links for g in got.values()) >= 0.9 * sum(n_links.values())


def test_repeated_and_null_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [2.0, 0.0]), (0, None), (5, [0.0, 3.0]), (None, [-1.0, 0.0])]
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(False, 0, 0, 0, True), (False, 1, 1, 1, True), (False, 1, 2, 1, True), (False, 1, 2, 1, True), (False, 5, 1, 1, False), (True, 0, 0, -1, True), (True, 0, 2, 1, False)]


def test_recall_of_visits_on_vectors_that_do_not_cluster(spark):
    """Pairs right above the threshold in random directions, among random vectors: nearly all are found with few visits."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(3000, 32)))
    aside = rng.normal(size=(400, 32))
    aside = unit(aside - (aside * x[:400]).sum(1, keepdims=True) * x[:400])
    y = 0.902 * x[:400] + (1 - 0.902**2) ** 0.5 * aside
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = by_id(embed.near_duplicates(frame), "vec_id")
    found = sum(got[3000 + i].component_id == i for i in range(400))
    assert found >= 390
    assert all(got[3000 + i].n_links == got[i].n_links for i in range(400))
    points = [{"dim": 32, "point": i, "weight": 1, "vector": v.tobytes()} for i, v in enumerate(x)]
    import pandas as pd

    cells = {32: embed.spherical_kmeans(x, 220)}
    visits = pd.concat(embed._visits(iter([pd.DataFrame(points)]), cells, 0.9, embed.REACH))
    assert len(visits) < 20 * len(x)
