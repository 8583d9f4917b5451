"""MinHash near-duplicates by a chosen-path set similarity join.

Each distinct shingle set is a point with POSITIONS minwise tokens. A tree starts with all points in one
node. A node branches by positions drawn from its own name: a point goes to one child for each drawn
position, named by the position and the point's minwise token there, 1/similarity children on average,
so that points as similar as the threshold stay together about as often as they are split. Independent
trees repeat this. Nodes of a few points are compared exhaustively; larger ones are compared against a
pivot, end with a comparison of what is outside their largest cluster of candidates if that is a few points, and branch on
otherwise. What stays apart is less similar to the pivot than candidates are, so that every level thins such nodes out.
Each level may part a pair, so points that are still in large mixed nodes get further trees, as many as the
depth needs to keep the chance to miss a link below MISS.

Clusters of candidates are then compared on their full shingle sets, in blocks of bounded size: each with its
own and with a few pivots of its cluster first; what is linked then needs no more comparisons, and only the points
outside a cluster's largest part meet all of its blocks. Only the links of a spanning forest leave a block. Equal sets were
merged at the start, and pairs within a group are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from math import comb, floor

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lettermill.llm.words import mix, shingles
from lettermill.operators.graph import connected_components
from lettermill.session import count, materialize

POSITIONS = 64
#: Trees over all points; deeper nodes get more (see trees_for).
TREES = 12
#: The chance that trees lose a pair right at the threshold whose sketches agree well enough, at any depth,
#: and the trees that are started for that at most.
MISS, MOST_TREES = 1e-4, 1000
#: Nodes of up to this many points are compared exhaustively.
SMALL = 16
#: Larger ones end as well where the pairs of those outside their largest cluster with all others are no more than this.
PAIRS = 1 << 17
#: All end when what is outside the largest clusters needs no more comparisons than this in all.
REST = 1 << 24
#: Rows of a node that are compared in one group.
CHUNK = 4096
#: Levels after which what is still large and mixed is compared exhaustively, too.
LEVELS = 64
#: The chance that the sketches of a pair right at the threshold agree so little that it isn't a candidate.
UNLIKE = 1e-6
#: Points, and shingles, of one block in the final comparison, and pivots that each block of a cluster meets.
BLOCK, BLOCK_SHINGLES, PIVOTS = 1024, 1_000_000, 4
#: Members, nodes and keys that are broadcast to what they are looked up for; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MUL = _RNG.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)

SIGNATURE = "uid long, doc_id string, key long, th long, n_shingles long, digest string, sketch binary"


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens (32 bits each) of non-empty sets, one row per set."""
    out = np.empty((len(sets), POSITIONS), np.uint32)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= 1 << 17):
            total += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        with np.errstate(over="ignore"):
            for k in range(POSITIONS):
                out[at:end, k] = np.minimum.reduceat((x * _MUL[k] + _ADD[k]) >> np.uint64(32), starts)
        at = end
    return out


def digest(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else ""


def _signatures(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), 512):
            part = pdf.iloc[at : at + 512]
            sets = [shingles(t, width) for t in part["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            sk = sketch([sets[i] for i in full])
            rows = dict(zip(full, sk, strict=True))
            yield pd.DataFrame({
                "uid": part["uid"], "doc_id": part["doc_id"], "key": part["key"], "th": part["th"], "n_shingles": [len(s) for s in sets], "digest": [digest(s) for s in sets],
                "sketch": [rows[i].tobytes() if i in rows else None for i in range(len(sets))],
            })


def branch(nodes: np.ndarray, sk: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each row's node: row numbers, and the children's names."""
    with np.errstate(over="ignore"):
        rows, names = [], []
        own = np.floor(1 / similarity)
        for i in range(int(own) + 1):
            seed = mix(nodes + np.uint64(0x632BE59BD9B4E019) * np.uint64(i + 1))
            # the first positions always, one more by chance, to make 1/similarity of them on average
            take = np.flatnonzero((seed >> np.uint64(40)) / float(1 << 24) < (1 / similarity - own)) if i == own else np.arange(len(nodes))
            pos = (seed[take] % np.uint64(POSITIONS)).astype(np.int64)
            token = sk[take, pos].astype(np.uint64)
            names.append(mix(mix(nodes[take] + np.uint64(1)) ^ (token * np.uint64(POSITIONS) + pos.astype(np.uint64))))
            rows.append(take)
    return np.concatenate(rows), np.concatenate(names)


def agreement_cut(similarity: float) -> int:
    """The positions in which candidates' sketches agree at least: a pair at the threshold has fewer with a chance of UNLIKE."""
    below, k = 0.0, 0
    while below + (more := comb(POSITIONS, k) * similarity**k * (1 - similarity) ** (POSITIONS - k)) <= UNLIKE:
        below, k = below + more, k + 1
    return k


def missed(similarity: float, depth: int, trees: int) -> float:
    """The chance that a pair of that similarity is missed: by its sketches, or parted within so many levels in each tree.

    Sketches agree in a binomial number of positions; given that, a pair's common nodes are a branching
    process, and trees are independent.
    """
    own, cut, lost = floor(1 / similarity), agreement_cut(similarity), 0.0
    more = 1 / similarity - own
    for k in range(POSITIONS + 1):
        gone = 0.0
        for _ in range(depth):
            child = 1 - k / POSITIONS * (1 - gone)
            gone = child**own * (1 - more + more * child)
        lost += comb(POSITIONS, k) * similarity**k * (1 - similarity) ** (POSITIONS - k) * (gone**trees if k >= cut else 1.0)
    return lost


@cache
def trees_for(similarity: float, depth: int) -> int:
    """How many trees nodes of a depth need so that a pair is missed with a chance of MISS at most."""
    return next((t for t in range(1, MOST_TREES) if missed(similarity, depth, t) <= MISS), MOST_TREES)


def _branched(frames: Iterator[pd.DataFrame], similarity: float, trees: tuple[int, int] = (0, 0)) -> Iterator[pd.DataFrame]:
    """Rows (born, point, n, sketch) for each tree of a range, or (born, node, ...) below the root, to rows ROW of the children."""
    for pdf in frames:
        if not len(pdf):
            continue
        sk = np.frombuffer(b"".join(pdf["sketch"]), np.uint32).reshape(len(pdf), POSITIONS)
        point, n, born = (pdf[c].to_numpy() for c in ("point", "n", "born"))
        mini = np.array([row.tobytes() for row in sk.astype(np.uint8)], object)
        starts = [pdf["node"].to_numpy().view(np.uint64)] if "node" in pdf else [np.full(len(pdf), t + 1, np.uint64) for t in range(*trees)]
        for nodes in starts:
            rows, names = branch(nodes, sk, similarity)
            yield pd.DataFrame({"born": born[rows], "node": names.view(np.int64), "point": point[rows], "n": n[rows], "mini": mini[rows]})


ROW = "born int, node long, point long, n long, mini binary"


def _matched(frames: Iterator[pd.DataFrame], similarity: float, cut: int) -> Iterator[pd.DataFrame]:
    """Nodes' points, lengths and minis (arrays) to their candidate pairs (p, q)."""
    for pdf in frames:
        p, q = [], []
        for point, n, mini in zip(pdf["points"], pdf["ns"], pdf["minis"], strict=True):
            x, point, n = np.frombuffer(b"".join(mini), np.uint8).reshape(len(mini), -1), np.asarray(point), np.asarray(n)
            i, j = np.triu_indices(len(x), 1)
            ok = (np.minimum(n[i], n[j]) >= (similarity - 1e-9) * np.maximum(n[i], n[j])) & (point[i] != point[j])
            i, j = i[ok], j[ok]
            ok = (x[i] == x[j]).sum(axis=1) >= cut
            p.append(np.minimum(point[i[ok]], point[j[ok]]))
            q.append(np.maximum(point[i[ok]], point[j[ok]]))
        yield pd.DataFrame({"p": np.concatenate([np.zeros(0, np.int64), *p]), "q": np.concatenate([np.zeros(0, np.int64), *q])})


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of positions at which two sketches (their low bytes) agree."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _apart(pdf: pd.DataFrame, similarity: float, cut: int) -> pd.DataFrame:
    """Pairs of clusters, by their roots, that a node's points outside its largest one bring together with points of this chunk."""
    out, there = pdf[pdf["out"]], pdf[~pdf["out"]]
    x, y = (np.frombuffer(b"".join(side["mini"]), np.uint8).reshape(len(side), POSITIONS) for side in (out, there))
    n, m, a, b = out["n"].to_numpy(), there["n"].to_numpy(), out["r_point"].to_numpy(), there["r_point"].to_numpy()
    found = [np.zeros((0, 2), np.int64)]
    step = max(1, (1 << 18) // max(1, len(y)))
    for at in range(0, len(x), step):
        i, j = np.nonzero((np.minimum.outer(n[at : at + step], m) >= (similarity - 1e-9) * np.maximum.outer(n[at : at + step], m)) & (a[at : at + step, None] != b[None, :]))
        ok = (x[at + i] == y[j]).sum(axis=1) >= cut
        found.append(np.unique(np.stack([a[at + i[ok]], b[j[ok]]], 1), axis=0))
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    return pd.DataFrame({"p": pairs[:, 0], "q": pairs[:, 1]})


def _few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows, broadcast if their number is bounded."""
    return F.broadcast(rows) if (count(rows) if n is None else n) <= BROADCAST_ROWS else rows


def _rooted(rows: DataFrame, roots: DataFrame | None, *ends: str) -> DataFrame:
    """rows with the roots of their points in ends, as columns r_<end>; a point without a candidate is its own."""
    for end in ends:
        if roots is None:
            rows = rows.withColumn(f"r_{end}", F.col(end))
        else:
            own = roots.select(F.col("point").alias(f"__{end}"), F.col("root").alias(f"r_{end}"))
            rows = rows.join(own, F.col(end) == F.col(f"__{end}"), "left").drop(f"__{end}").withColumn(f"r_{end}", F.coalesce(f"r_{end}", end))
    return rows


def _joined(roots: DataFrame | None, merged: DataFrame) -> DataFrame:
    """roots (point, root) after merged (node, root), which maps roots, or points that had none, to new ones."""
    if roots is None:
        return merged.withColumnRenamed("node", "point")
    moved = roots.join(merged.select("node", F.col("root").alias("__new")), F.col("root") == F.col("node"), "left").select("point", F.coalesce("__new", "root").alias("root"))
    new = merged.join(roots.select("point"), F.col("node") == F.col("point"), "left_anti").select(F.col("node").alias("point"), "root")
    return moved.union(new)


def candidate_clusters(points: DataFrame, similarity: float, trees: int = TREES, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """(point, root): clusters that hold every candidate pair. points: point, n, sketch.

    The trees are started over all points. After each level, points still in large mixed nodes get as many
    more as trees_for asks for at the next level: a pair that comes so far in one tree has had that many.
    A row's born is the level after which its tree was started. Candidates of a level are merged with the clusters so far
    by their roots alone.
    """
    cut = agreement_cut(similarity)
    fits = lambda m, n: F.least(m, n) >= F.lit(similarity - 1e-9) * F.greatest(m, n)
    alike = lambda a, b: agreement(a, b) * POSITIONS >= cut - 0.5
    grown = lambda rows, *new: rows.mapInPandas(partial(_branched, similarity=similarity, trees=new or (0, 0)), ROW)

    def merged(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
        apart = _rooted(pairs.distinct(), roots, "p", "q").where("r_p != r_q")
        return _joined(roots, connected_components(apart, "r_p", "r_q"))

    rows = grown(points.select(F.lit(0).alias("born"), "point", "n", "sketch"), 0, trees)
    roots, level, more = None, 0, None
    while True:
        level += 1
        # Nodes of one point are gone before anything but their name is moved.
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = materialize(rows.join(_few(materialize(sizes, f"sizes{level}")), "node"), f"rows{level}")
        few, large = rows.where(F.col("size") <= small), rows.where(F.col("size") > small)
        packed = few.groupBy("node").agg(F.collect_list(F.struct("point", "n", "mini")).alias("x"))
        packed = packed.select(*(F.col(f"x.{c}").alias(f"{c}s") for c in ("point", "n", "mini")))
        pairs = packed.mapInPandas(partial(_matched, similarity=similarity, cut=cut), "p long, q long")
        # The pivot is the smallest point by a hash, another order at each level, the same one in all trees. Rows meet it where they lie.
        pivot = F.min(F.struct(F.xxhash64(F.lit(level), "point").alias("h"), F.col("point").alias("pivot"), F.col("n").alias("pivot_n"), F.col("mini").alias("pivot_mini"))).alias("x")
        pivots = materialize(large.groupBy("node").agg(pivot).select("node", "x.pivot", "x.pivot_n", "x.pivot_mini"), f"pivots{level}")
        many = large.join(_few(pivots), "node").where((F.col("point") != F.col("pivot")) & fits(F.col("n"), F.col("pivot_n"))).where(alike("mini", "pivot_mini"))
        pairs = pairs.union(many.select(F.least("point", "pivot"), F.greatest("point", "pivot")))
        roots = materialize(merged(pairs if more is None else pairs.union(more), roots), f"roots{level}")
        inside = materialize(_rooted(large, roots, "point"), f"inside{level}")
        parts = inside.groupBy("node", "r_point").agg(F.count(F.lit(1)).alias("part"))
        parts = parts.groupBy("node").agg(F.sum("part").alias("all"), F.max(F.struct("part", "r_point")).alias("most"))
        mixed = parts.select("node", F.col("most.r_point").alias("main"), "all", (F.col("all") - F.col("most.part")).alias("out")).where("out > 0")
        mixed = materialize(mixed, f"mixed{level}")
        # A node with little to compare outside its largest cluster ends, and all end when little is left in all.
        few_pairs = (F.col("out") <= small) | (F.col("out") * F.col("all") <= PAIRS)
        left = mixed.agg(F.coalesce(F.sum(F.col("out") * F.col("all")), F.lit(0)).alias("pairs"), F.count(F.lit(1)).alias("nodes")).first()
        done = left.pairs <= REST or level >= levels
        chunks = F.ceil(F.col("all") / CHUNK).cast("int").alias("chunks")
        ends = inside.join(_few(mixed.where(F.lit(done) | few_pairs).select("node", "main", chunks), left.nodes), "node")
        fields = ["point", "n", "mini", "r_point"]
        there = ends.select("node", F.pmod(F.xxhash64("point"), F.col("chunks")).cast("int").alias("chunk"), *fields, F.lit(False).alias("out"))
        asks = ends.where("r_point != main").select("node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), *fields, F.lit(True))
        more = there.union(asks).groupBy("node", "chunk").applyInPandas(lambda pdf: _apart(pdf, similarity, cut), "p long, q long")
        if done:
            return merged(more, roots) if left.nodes else roots
        left = materialize(inside.join(_few(mixed.where(~few_pairs).select("node"), left.nodes), "node").select("born", "node", "point", "n"), f"left{level}")
        born = [r["born"] for r in left.select("born").distinct().collect()]  # levels
        if not born:
            return merged(more, roots)
        rows = grown(left.join(points.select("point", "sketch"), "point").select("born", "node", "point", "n", "sketch"))
        wanted = max(trees_for(similarity, level - k + 1) for k in born)
        if wanted > trees:
            again = left.select("point").distinct().join(points, "point").select(F.lit(level).alias("born"), "point", "n", "sketch")
            rows = rows.union(grown(again, trees, wanted))
            trees = wanted
        rows = materialize(rows, f"grown{level}")


def _sets(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Full sets of the texts."""
    for pdf in frames:
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at : at + 256]
            yield part.drop(columns=["text"]).assign(shingles=[shingles(t, width).tobytes() for t in part["text"]])


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked(sets: list[np.ndarray], num: int, den: int, first: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * intersection >= num * union, by exhaustive comparison.

    With first, only pairs with one of so many first sets are compared. Shingles that one set alone has can't count; the
    others make a 0/1 matrix whose products, taken over bounded runs of columns, are the intersections.
    """
    n = len(sets)
    m = n if first is None else first
    size = np.array([len(s) for s in sets], np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((m, n), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        step = min(int(column[-1]) + 1, max(64, (1 << 22) // n))
        for lo in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, (lo, lo + step))
            x = np.zeros((n, step), np.float32)
            x[owner[a:b], column[a:b] - lo] = 1
            common += x[:m] @ x.T
    common = common.astype(np.int64)
    ok = np.triu(den * common >= num * (size[:m, None] + size[None, :] - common), 1)
    parent, forest = list(range(n)), []
    for i, j in zip(*np.nonzero(ok), strict=True):
        ri, rj = _find(parent, i), _find(parent, j)
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
            forest.append((i, j))
    return forest


def _verified(pdf: pd.DataFrame, num: int, den: int, asked: bool = False) -> pd.DataFrame:
    """Links of a block; with asked, only those of points asked for."""
    pdf = pdf.sort_values("asked", ascending=False, kind="stable").drop_duplicates("point")
    point, m = pdf["point"].to_numpy(), int(pdf["asked"].sum()) if asked else len(pdf)
    forest = linked([np.frombuffer(s, np.uint64) for s in pdf["shingles"]], num, den, m) if len(pdf) > 1 and m else []
    return pd.DataFrame({"p": [point[i] for i, _ in forest], "q": [point[j] for _, j in forest]}, dtype="int64")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES, small: int = SMALL, levels: int = LEVELS, block: int = BLOCK, key: str | None = None) -> DataFrame:
    """Link documents whose sets of distinct width-word shingles have 100 * |A & B| >= percent * |A | B|.

    docs: doc_id (long) and text; other columns are ignored. Words lie between ASCII white space, A-Z
    lower-cased. A text of fewer words is one shingle. Returns one row per input row: doc_id, n_shingles,
    component_id (smallest doc_id reachable over links, null doc_ids last), kept (doc_id equals it).
    Null and empty texts have no shingles and link with nothing. Rows that repeat a doc_id count as rows
    of their own: equal texts link, others only if similar. An empty table gives an empty result. With key, the
    name of a column of numbers, key and root (a number for each group, null without shingles) come as well.
    """
    own_key = F.lit(0) if key is None else F.col(key)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_key.cast("long").alias("key"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    # Ids pass Python as strings, since pandas would make floats of numbers with nulls among them.
    rows = texts.withColumn("uid", F.monotonically_increasing_id()).withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = rows.mapInPandas(partial(_signatures, width=width), SIGNATURE)
    signed = materialize(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")
    first = F.min(F.struct("uid", "doc_id", "th", F.col("n_shingles").alias("n"), "sketch")).alias("first")
    points = materialize(
        signed.where("n_shingles > 0").groupBy("digest").agg(first, F.min("doc_id").alias("least"))
        .select("digest", F.col("first.uid").alias("point"), "first.doc_id", "first.th", "first.n", "first.sketch", "least"), "points",
    )
    clusters = candidate_clusters(points.select("point", "n", "sketch"), percent / 100, trees, small, levels)
    edges = _confirmed(texts, points, clusters, width, percent, block)
    roots = connected_components(edges, "p", "q")
    named = points.select("digest", "point", "least").join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = materialize(named.join(least, "root").select("digest", "root", "component_id"), "components")
    out = signed.select("doc_id", "key", "n_shingles", F.nullif("digest", F.lit("")).alias("digest")).join(component, "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "key", "root")
    return out.drop("key", "root") if key is None else out


def distinct(docs: DataFrame, width: int = 5, percent: int = 80, **options: int) -> DataFrame:
    """docs, all columns, with one row of each group that near_duplicates finds, that of the smallest doc_id.

    Rows are told apart by doc_id and the hash of the text. Of rows that repeat both, one stays if any does;
    of rows that repeat the smallest doc_id with other texts, that with the smallest hash of the text.
    """
    keyed = docs.withColumn("__lm_text", F.xxhash64("text"))
    found = materialize(near_duplicates(keyed, width, percent, key="__lm_text", **options), "found")
    full = found.where("n_shingles > 0").select("root", F.col("doc_id").alias("__lm_id"), F.col("key").alias("__lm_key"))
    first = F.min(F.struct(F.col("__lm_id").isNull().alias("none"), "__lm_id", "__lm_key")).alias("first")
    keep = full.groupBy("root").agg(first).select(F.col("first.__lm_id").alias("i"), F.col("first.__lm_key").alias("k"))
    each = full.groupBy("__lm_id", "__lm_key").agg(F.count(F.lit(1)).alias("n"))
    each = each.join(keep, F.col("__lm_id").eqNullSafe(F.col("i")) & (F.col("__lm_key") == F.col("k")), "left")
    each = materialize(each.where("k is null or n > 1").select("__lm_id", "__lm_key", F.col("k").isNotNull().alias("stays")), "keys")
    sought = each.withColumnRenamed("stays", "__lm_stays")
    sought = F.broadcast(sought) if count(each) <= BROADCAST_ROWS else sought
    same = keyed["doc_id"].eqNullSafe(F.col("__lm_id")) & (F.col("__lm_text") == F.col("__lm_key"))
    left = keyed.join(sought, same, "left").where(F.col("__lm_key").isNull() | F.col("__lm_stays"))
    if each.where("stays").isEmpty():
        return left.select(*docs.columns)
    # Rows that stay but are there several times: only these are brought together.
    once = left.where("__lm_stays").dropDuplicates(["__lm_id", "__lm_key"]).select(*docs.columns)
    return left.where("__lm_stays is null").select(*docs.columns).union(once)


def _confirmed(texts: DataFrame, points: DataFrame, clusters: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (p, q) that connect all linked points of each cluster, on the full sets."""
    shape = "p long, q long"
    members = clusters.join(points.select("point", "doc_id", "th", "n"), "point")
    need = lambda n: F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(n) / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("root").agg(need("n").alias("blocks"))
    members = materialize(members.join(sizes, "root").select("root", "point", "doc_id", "th", "n", "blocks"), "members")
    sought = _few(members.select("root", "point", "n", "blocks", F.col("doc_id").alias("__id"), F.col("th").alias("__th")))
    sets = texts.join(sought, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    # Rows that repeat id and text come once, whatever their number, as they are merged before the shuffle.
    sets = sets.groupBy("root", "point", "n", "blocks").agg(F.first("text").alias("text"))
    sets = sets.mapInPandas(partial(_sets, width=width), "root long, point long, n long, blocks int, shingles binary")
    sets = materialize(sets.withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")), "sets")
    # Each block with itself, and with the pivots of its cluster.
    large = sets.where("blocks > 1")
    first = [F.min(F.struct(F.xxhash64(F.lit(k), "point").alias("h"), "point"))["point"] for k in range(PIVOTS)]
    pivots = large.select("root", "point").groupBy("root").agg(F.array_distinct(F.array(*first)).alias("x")).select(F.col("root").alias("__root"), F.explode("x").alias("__point"))
    pivots = large.join(_few(materialize(pivots, "pivots")), (F.col("root") == F.col("__root")) & (F.col("point") == F.col("__point")))
    fields = ["root", "blocks", "point", "shingles"]
    rows = sets.select(*fields, "block", F.lit(True).alias("asked")).union(pivots.select(*fields, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.lit(False)))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        return _verified(pdf, percent, 100).assign(large=bool(pdf["blocks"].iloc[0] > 1))

    near = materialize(rows.groupBy("root", "block").applyInPandas(own, shape + ", large boolean"), "near")
    # Points outside the largest part of a cluster with all its blocks.
    parts = connected_components(near.where("large"), "p", "q").withColumnRenamed("node", "point")
    held = materialize(_rooted(large.select("root", "point", "n"), parts, "point"), "held")
    most = held.groupBy("root", "r_point").agg(F.count(F.lit(1)).alias("size")).groupBy("root").agg(F.max(F.struct("size", "r_point"))["r_point"].alias("most"))
    outside = materialize(held.join(most, "root").where("r_point != most").select("root", "point", "n"), "outside")
    if outside.isEmpty():
        return near.select("p", "q")
    runs = _few(materialize(outside.groupBy(F.col("root").alias("__root")).agg(need("n").alias("runs")), "runs"))
    there = large.join(runs, F.col("root") == F.col("__root"))
    asked = there.join(_few(outside.select(F.col("point").alias("__point"))), F.col("point") == F.col("__point"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.select("root", F.pmod(F.xxhash64("point"), F.col("runs")).cast("int").alias("run"), every("blocks").alias("block"), F.lit(True).alias("asked"), "point", "shingles")
    rows = asked.union(there.select("root", every("runs"), "block", F.lit(False), "point", "shingles"))
    return near.select("p", "q").union(rows.groupBy("root", "run", "block").applyInPandas(lambda pdf: _verified(pdf, percent, 100, asked=True), shape))
