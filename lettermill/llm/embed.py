"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one kept per group.

Equal vectors are merged first. Cells are about as many as four times the square root of the vectors, fitted in two
levels. Every vector has one home cell, that of the nearest centroid, and visits the cells near it: those to
whose bisector its distance is at most REACH deviations of a neighbour right at the threshold in a random
direction (or, if exact is asked for, cells in which any vector within the threshold's angle could be at home). A pair is compared if either
visits the other's home. Visitors and residents of a cell meet in blocks; a block returns how many links
each vector has there and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.labels import drawn
from lettermill.operators.graph import connected_components
from lettermill.session import count, materialize

#: Cells: so many times the square root of the number of vectors.
CELLS = 4.0
#: Vectors at most that the first level of centroids is fitted on, and vectors for each centroid of the second.
SAMPLE, SAMPLE_CELL = 20_000, 16
#: How far a vector visits, in standard deviations (of a random direction's share in one direction). Measured at the
#: threshold of 0.9 on random vectors: more than 0.999 of the pairs are compared, at 0.95 all. The README has the cost.
REACH = 1.7
#: Bytes of doubles on one side of a block, and vectors at most.
BLOCK_BYTES, BLOCK = 1 << 24, 8192
ROUNDS = 6

UNITS = "uid long, vec_id string, dim int, digest string, vector binary"


def _units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes of doubles; without bytes if they link with nothing."""
    for pdf in frames:
        raw = []
        for v in pdf["embedding"]:
            x = None if v is None else np.asarray(v, np.float64)
            with np.errstate(over="ignore"):
                ok = x is not None and x.size and np.isfinite(x).all() and x.any()
            raw.append((x / np.abs(x).max()).tobytes() if ok else None)
        yield pd.DataFrame({
            "uid": pdf["uid"], "vec_id": pdf["vec_id"], "dim": [len(r) // 8 if r else 0 for r in raw],
            "digest": [xxhash.xxh3_128_hexdigest(r) if r else None for r in raw], "vector": raw,
        })


def _matrix(vectors: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors x: at most k of them."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 4096] @ c.T).argmax(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return np.unique(c, axis=0)


def _coarse(frames: Iterator[pd.DataFrame], centroids: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for dim, part in pdf.groupby("dim"):
            if dim in centroids:
                yield pd.DataFrame({"dim": dim, "coarse": (_matrix(part["vector"]) @ centroids[dim].T).argmax(1), "vector": part["vector"]})


def _fine(pdf: pd.DataFrame) -> pd.DataFrame:
    c = spherical_kmeans(_matrix(pdf.sort_values("vector")["vector"]), max(1, round(len(pdf) / SAMPLE_CELL)))
    return pd.DataFrame({"dim": pdf["dim"].iloc[0], "centroid": [row.tobytes() for row in c]})


def fit_cells(points: DataFrame, n: int, sample: int = SAMPLE, cells: float = CELLS) -> dict[int, np.ndarray]:
    """Centroids for each number of dimensions: about cells * sqrt(n) in all, from points (digest, dim, vector).

    Centroids of a first level, the square root of as many, are fitted on a bounded sample; sampled vectors are dealt
    to them and each of their parts is fitted by a task of its own, with as many centroids as its share asks for. The driver
    holds the centroids alone, whose number grows with the square root of the input.
    """
    k = max(1, round(cells * n**0.5))
    first = drawn(points.select("digest", "dim", "vector"), sample, "digest").select("dim", "vector").toPandas().sort_values("vector")
    coarse = {int(d): spherical_kmeans(_matrix(g["vector"]), max(1, round((k * len(g) / len(first)) ** 0.5))) for d, g in first.groupby("dim")}
    share = min(1.0, SAMPLE_CELL * k / max(n, 1))
    chosen = points.where(F.shiftrightunsigned(F.xxhash64(F.lit("cells"), "digest"), 2) < F.lit(int(share * (1 << 62)))).select("dim", "vector")
    dealt = chosen.mapInPandas(partial(_coarse, centroids=coarse), "dim int, coarse long, vector binary")
    found = dealt.groupBy("dim", "coarse").applyInPandas(_fine, "dim int, centroid binary").toPandas().sort_values(["dim", "centroid"])
    fine = {int(d): np.frombuffer(b"".join(g["centroid"]), np.float64).reshape(len(g), -1) for d, g in found.groupby("dim")}
    return coarse | fine


def margin(threshold: float, dim: int, reach: float | None) -> float:
    """The distance to a bisector up to which a cell is visited; without reach, that which no link can exceed."""
    if threshold <= 0:
        return 2.0
    sine = (1 - min(threshold, 1.0) ** 2) ** 0.5
    return (sine if reach is None else min(sine, reach * sine / threshold / max(dim - 1, 1) ** 0.5)) + 1e-6


def _visits(frames: Iterator[pd.DataFrame], centroids: dict[int, np.ndarray], threshold: float, reach: float | None) -> Iterator[pd.DataFrame]:
    """Rows (cell, home, point, weight, vector, near): a vector in its home and in each cell that it visits; near are all of them."""
    for pdf in frames:
        for dim, whole in pdf.groupby("dim"):
            c, far = centroids.get(dim), margin(threshold, dim, reach)
            for at in range(0, len(whole), 1024):
                part = whole.iloc[at : at + 1024]
                if c is None or len(c) == 1:
                    row, cell, own = np.arange(len(part)), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                else:
                    near = _matrix(part["vector"]) @ c.T
                    own = near.argmax(1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[own] @ c.T)))
                    row, cell = np.nonzero(near[np.arange(len(own)), own][:, None] - near <= far * apart)
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                lists = [cell[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                out = part.iloc[row]
                yield pd.DataFrame({
                    "dim": dim, "cell": cell, "home": own[row], "point": out["point"], "weight": out["weight"], "vector": out["vector"], "near": [lists[i] for i in row],
                })


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest places that each place can reach over pairs a-b and those joined in root before."""
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up


def _blocked(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows (p, q, links): each vector's links between this block's visitors and residents, and a forest of links p-q.

    A visitor's link with a resident counts for it, and for the resident if that doesn't meet it elsewhere:
    if both visit each other's home, the pair is counted in the cell of the smaller number.
    """
    visit, home = pdf[pdf["visits"]].reset_index(drop=True), pdf[~pdf["visits"]].reset_index(drop=True)
    none = pd.DataFrame({"p": [], "q": [], "links": []}).astype({"p": "int64", "q": "Int64", "links": "int64"})
    if visit.empty or home.empty:
        return none
    x, y = _matrix(visit["vector"]), _matrix(home["vector"])
    p, q, cell = visit["point"].to_numpy(), home["point"].to_numpy(), int(home["cell"].iloc[0])
    wp, wq, from_ = visit["weight"].to_numpy().astype(np.float64), home["weight"].to_numpy().astype(np.float64), visit["home"].to_numpy()
    # Residents that visit each home of these visitors, which is looked up where a pair is found.
    lists = [np.frombuffer(v, np.int32) for v in home["near"]]
    visits = np.unique(np.repeat(np.arange(len(lists)), [len(v) for v in lists]).astype(np.int64) << 32 | np.concatenate(lists))
    ids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    ip, iq, root = at[: len(p)], at[len(p) :], np.arange(len(ids))
    links = np.zeros(len(ids))
    # Single precision finds the candidates of some rows at a time, double precision decides.
    y32, step = np.ascontiguousarray(y.T, np.float32), max(1, (1 << 21) // len(y))
    for lo in range(0, len(x), step):
        a, b = np.nonzero(x[lo : lo + step].astype(np.float32) @ y32 >= threshold - 1e-5)
        a += lo
        keep = p[a] != q[b]
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        ok = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], y[b[k : k + 65536]]) >= threshold for k in range(0, len(a), 65536)])
        a, b = a[ok], b[ok]
        key = b.astype(np.int64) << 32 | from_[a]
        place = np.minimum(np.searchsorted(visits, key), len(visits) - 1)
        both = (visits[place] == key) & (from_[a] != cell)
        here = ~both | (from_[a] > cell)
        a, b = a[here], b[here]
        other = from_[a] != cell
        links += np.bincount(ip[a], wq[b], len(ids)) + np.bincount(iq[b[other]], wp[a[other]], len(ids))
        root = _united(root, ip[a], iq[b])
    tied, counted = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(links)
    return pd.DataFrame({
        "p": np.concatenate([ids[counted], ids[tied]]), "q": pd.array([*[None] * len(counted), *ids[root[tied]].tolist()], "Int64"),
        "links": np.concatenate([links[counted], np.zeros(len(tied))]).astype(np.int64),
    })


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, reach: float | None = REACH, sample: int = SAMPLE, cells: float = CELLS, block: int = BLOCK) -> DataFrame:
    """Link vectors whose cosine, in double precision, is threshold or more; without reach, all of them for certain.

    vectors: vec_id (long), embedding (array of numbers); other columns are ignored. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; those of different lengths don't
    link. Returns one row per input row: vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable), kept (vec_id equals it). Rows that repeat a vec_id count as rows of their
    own, each a link of the other if they are alike; null vec_ids come last in that order. An empty table gives an empty result.
    """
    base = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # Ids pass Python as strings, since pandas would make floats of numbers with nulls among them.
    units = materialize(base.mapInPandas(_units, UNITS).withColumn("vec_id", F.col("vec_id").cast("long")), "units")
    first = F.min(F.struct("uid", "dim", "vector")).alias("first")
    points = units.where("digest is not null").groupBy("digest").agg(first, F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    points = materialize(points.select("digest", F.col("first.uid").alias("point"), "first.dim", "first.vector", "weight", "least"), "points")
    centroids = fit_cells(points, count(points), sample, cells)
    shape = "dim int, cell int, home int, point long, weight long, vector binary, near binary"
    visits = points.select("dim", "point", "weight", "vector").mapInPandas(partial(_visits, centroids=centroids, threshold=threshold, reach=reach), shape)
    visits = materialize(visits, "visits")
    resides = F.col("home") == F.col("cell")
    sizes = visits.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("v"), F.count_if(resides).alias("h"))
    fit = F.least(F.lit(block), F.greatest(F.lit(256), F.floor(F.lit(BLOCK_BYTES) / 8 / F.col("dim"))))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / fit)).cast("int")
    rows = visits.join(F.broadcast(sizes.select("dim", "cell", blocks("v").alias("vb"), blocks("h").alias("hb"))), ["dim", "cell"])
    mine = lambda c: F.pmod(F.xxhash64("point"), F.col(c)).cast("int")
    others = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    fields = ["home", "point", "weight", "vector"]
    asked = rows.select("dim", "cell", mine("vb").alias("i"), others("hb").alias("j"), F.lit(True).alias("visits"), *fields, F.lit(b"").alias("near"))
    there = rows.where(resides).select("dim", "cell", others("vb").alias("i"), mine("hb").alias("j"), F.lit(False).alias("visits"), *fields, "near")
    found = asked.union(there).groupBy("dim", "cell", "i", "j").applyInPandas(lambda pdf: _blocked(pdf, threshold), "p long, q long, links long")
    found = materialize(found, "links")
    links = found.where("q is null").groupBy("p").agg(F.sum("links").alias("links")).withColumnRenamed("p", "point")
    roots = connected_components(found.where("q is not null"), "p", "q").withColumnRenamed("node", "point")
    named = points.select("digest", "point", "weight", "least").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(links, "point", "left").join(least, "root").select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = units.select("vec_id", "digest").join(known, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))
