"""Logistic regressions of a grid side by side, over terms that lie in blocks on all tasks.

A fit's weights are a sum of its training rows, w = X'b, so that all its vectors can be as long as there are rows and none
as long as there are terms. What it needs of the terms is K v = X(X'v), which is a sum over terms: tasks hold blocks of
them, the driver holds a few vectors a candidate (8 bytes a row each). All candidates advance at once, a job for each
step of theirs, as a term's df and idf don't depend on the candidate; its length of runs and least df only choose terms. A term of one
training row adds to the diagonal of K alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.operators import tfidf
from lettermill.session import materialize

MOST_ITERATIONS = 2000
#: Characters of text for each block (about a term and a run in eight). Rows packed at a time.
BLOCK_CHARS, SLICE = 4_000_000, 1024
#: Bytes of vectors that come to the driver at once, which bounds the candidates that advance at once.
GATHERED = 64_000_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def newton(y: np.ndarray, strength: float, iterations: int = MOST_ITERATIONS, tolerance: float = 1e-8) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """The b of w = X'b that minimises |w|^2 / 2 + C * sum of class-balanced logistic losses; yields vectors v and is sent K v.

    The steps are those of model.fit_logistic.
    """
    n = len(y)
    classes = np.bincount(y.astype(int), minlength=2)
    if classes.min() == 0:
        raise ValueError("training data must contain both labels")
    cost = strength * (n / (2 * classes))[y.astype(int)]
    sign = np.where(y == 1, 1.0, -1.0)
    b, z = np.zeros(n), np.zeros(n)

    def value(b: np.ndarray, z: np.ndarray) -> float:
        return b @ z / 2 + (cost * np.logaddexp(0, -sign * z)).sum()

    start = None
    for _ in range(iterations):
        p = 1 / (1 + np.exp(np.clip(sign * z, -500, 500)))
        pull = cost * sign * p
        grad, kgrad = b - pull, z - (yield pull)
        size = np.sqrt(max(0.0, grad @ kgrad))
        start = size if start is None else start
        if size <= tolerance * max(1.0, start):
            break
        curve = cost * p * (1 - p)
        step, kstep, r, kr = np.zeros(n), np.zeros(n), -grad, -kgrad
        d, kd, rr = r, kr, r @ kr
        for _ in range(200):
            bent = curve * kd
            hd, khd = d + bent, kd + (yield bent)
            a = rr / (hd @ kd)
            step, kstep, r, kr = step + a * d, kstep + a * kd, r - a * hd, kr - a * khd
            new = r @ kr
            if new <= 0.01 * min(0.25, size) * size * size:
                break
            d, kd, rr = r + new / rr * d, kr + new / rr * kd, new
        now, slope, length = value(b, z), grad @ kstep, 1.0
        while value(b + length * step, z + length * kstep) > now + 1e-4 * length * slope and length > 1e-10:
            length /= 2
        b, z = b + length * step, z + length * kstep
    return b


_FEW = np.log(np.maximum(1, np.arange(256))) + 1


def _many(tf: np.ndarray) -> np.ndarray:
    return np.take(_FEW, tf) if tf.dtype == np.uint8 else np.log(tf) + 1


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.int32)


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns that are sorted together."""
    n = len(sorted_[0])
    return np.flatnonzero(np.r_[True, np.any([np.diff(x) != 0 for x in sorted_], axis=0)][:n]) if n else np.zeros(0, np.int64)


def _entries(batch: pa.RecordBatch, places: tuple[np.ndarray, np.ndarray], longest: int, buckets: int) -> Iterator[tuple]:
    """(kind, bucket, keys, parents, rows, tfs) of rows (id, hashes): runs of kind words by key, where parent is the key without the last word.

    A parent and a key tell the last word's hash, so runs of equal key and parent are equal, if those of one word less are told apart.
    """
    flat, own = tfidf._lists(pa.Table.from_batches([batch]), "hashes")
    row = places[1][np.searchsorted(places[0], batch["id"].to_numpy())].astype(np.int32)
    word = flat.astype(np.int64).view(np.uint64)
    key, parent, at = word, word, own
    for kind in range(1, longest + 1):
        if kind > 1:
            # A run of kind words begins where one of kind - 1 does, if the word after it is of the same row.
            whole = own[kind - 1 :] == at[: len(own) - kind + 1] if len(own) >= kind else np.zeros(0, bool)
            parent = key[: len(whole)]
            key = parent * _MIX + word[kind - 1 :][: len(whole)]
            at = np.where(whole, at[: len(whole)], -1)
        kept = at >= 0
        k, p, a = key[kept], parent[kept], at[kept]
        order = np.lexsort((a, p, k))
        k, p, a = k[order], p[order], a[order]
        first = _starts(k, p, a)
        tf, k, p, a = np.diff(np.r_[first, len(k)]), k[first], p[first], row[a[first]]
        bucket = ((k ^ (k >> np.uint64(32))) * _MIX >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, k, p, a, tf = bucket[order], k[order], p[order], a[order], tf[order].astype(np.int32)
        cut = np.r_[_starts(bucket), len(bucket)]
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield kind, int(bucket[lo]), k[lo:hi].tobytes(), p[lo:hi].tobytes() if kind > 1 else b"", a[lo:hi].tobytes(), tf[lo:hi].tobytes()


def _by_row(row: np.ndarray, column: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rows, where each begins, columns, tf), by row."""
    order = np.argsort(row, kind="stable")
    row = row[order]
    first = _starts(row)
    return row[first], first.astype(np.int32), column[order].astype(np.int32), _small(tf[order])


def _block(kind: int, key: np.ndarray, parent: np.ndarray, row: np.ndarray, tf: np.ndarray, n: int) -> tuple[bool, bytes, bytes]:
    """(whether two terms have one key, what fits need, what else scores need) of a block's entries; rows from n on are scored."""
    order = np.lexsort((row, key))
    key, row, tf = key[order], row[order], tf[order]
    first = _starts(key)
    column = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    clash = kind > 1 and bool((parent[order] != parent[order][first][column]).any())
    known = row < n
    df = np.bincount(column[known], minlength=len(first))
    several = df > 1
    number = np.cumsum(several) - 1
    inner, outer = known & several[column], ~known & several[column]
    fit = {"kind": kind, "df": df[several].astype(np.int32), "row": row[inner], "tf": _small(tf[inner]), "by_row": _by_row(row[inner], number[column[inner]], tf[inner])}
    lone, asked = known & (df == 1)[column], ~known & (df == 1)[column]
    holder, held = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
    holder[column[lone]], held[column[lone]] = row[lone], tf[lone]
    length = np.bincount(row[lone], _many(tf[lone]) ** 2) if lone.any() else np.zeros(0)
    rows = np.flatnonzero(length)
    score = {
        "lone": (rows.astype(np.int32), length[rows]), "by_row": _by_row(row[outer], number[column[outer]], tf[outer]),
        "asked": (row[asked], tf[asked], holder[column[asked]], held[column[asked]]),
    }
    return clash, pickle.dumps(fit), pickle.dumps(score)


def _squares(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1.0 + n) / (df + 1.0)) + 1) ** 2


def _gather(total: np.ndarray, u: np.ndarray, by_row: tuple[np.ndarray, ...], columns: np.ndarray, many: np.ndarray) -> None:
    if len(columns):
        x = np.take(u, columns, mode="clip")
        x *= many
        total[by_row[0]] += np.add.reduceat(x, by_row[1])


def _columns(fit: dict, sets: list[tuple[int, int]], v: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(candidate, idf squared * X'v) of a block, for the candidates that choose its kind. v is scaled by rows."""
    if not len(fit["df"]):
        return
    row, many, first = fit["row"].astype(np.int64), _many(fit["tf"]), np.cumsum(fit["df"]) - fit["df"]
    square = _squares(fit["df"], n)
    for i, (longest, least) in enumerate(sets):
        if fit["kind"] <= longest:
            x = np.take(v[i], row, mode="clip")
            x *= many
            yield i, np.add.reduceat(x, first) * square * (fit["df"] >= least)


def _multiply(total: np.ndarray, fit: dict, _: dict | None, sets: list[tuple[int, int]], v: np.ndarray, n: int) -> None:
    own = fit["by_row"]
    columns, many = own[2].astype(np.int64), _many(own[3])
    for i, u in _columns(fit, sets, v, n):
        _gather(total[i], u, own, columns, many)


def _score(total: np.ndarray, fit: dict, score: dict, sets: list[tuple[int, int]], v: np.ndarray, n: int) -> None:
    own = score["by_row"]
    columns, many = own[2].astype(np.int64), _many(own[3])
    for i, u in _columns(fit, sets, v, n):
        _gather(total[i], u, own, columns, many)
    row, tf, holder, held = score["asked"]
    if len(row):
        both = _many(tf) * _many(held) * _squares(np.ones(1), n)
        for i, (longest, least) in enumerate(sets):
            if fit["kind"] <= longest and least <= 1:
                total[i] += np.bincount(row, both * v[i][holder], total.shape[1])


def _lengths(total: np.ndarray, fit: dict, score: dict, sets: list[tuple[int, int]], _: None, n: int) -> None:
    """Squared lengths of all rows, and after them what terms of one training row add to those."""
    rows = total.shape[1] - n
    for i, (longest, least) in enumerate(sets):
        if fit["kind"] > longest:
            continue
        square = _squares(fit["df"], n) * (fit["df"] >= least)
        for own in (fit["by_row"], score["by_row"]):
            _gather(total[i], square, own, own[2].astype(np.int64), _many(own[3]) ** 2)
        if least <= 1:
            one = _squares(np.ones(1), n)
            own, length = score["lone"]
            total[i, own] += length * one
            total[i, own + rows] += length * one
            row, tf = score["asked"][:2]
            total[i, :rows] += np.bincount(row, _many(tf) ** 2 * one, rows)[:rows] if len(row) else 0.0


def _summed(blocks: DataFrame, work: Callable, sets: list[tuple[int, int]], v: np.ndarray | None, n: int, shape: tuple[int, int], tasks: int) -> np.ndarray:
    """The sum over all blocks of what work adds to an array of some shape."""
    own = blocks.select("fit") if work is _multiply else blocks.select("fit", "score")
    own = own.coalesce(tasks)
    shared = blocks.sparkSession.sparkContext.broadcast(v)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [pickle.loads(column[i].as_buffer()) for column in batch.columns]
                total = np.zeros(shape) if total is None else total
                work(total, parts[0], parts[1] if len(parts) > 1 else None, sets, shared.value, n)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    total, conf = np.zeros(shape), blocks.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, "1")  # a task holds one block at a time
    try:
        parts = own.mapInArrow(added, "total binary").toArrow()["total"]
    finally:
        conf.set(_BATCH, before)
    for part in parts:
        total += np.frombuffer(part.as_buffer()).reshape(shape)
    shared.destroy()
    return total


def _blocks(rows: DataFrame, text: str, longest: int, places: tuple[np.ndarray, np.ndarray], n: int) -> DataFrame:
    """Blocks (fit, score) of the terms of rows (id, text) that a row of a place before n holds."""
    spark = rows.sparkSession
    words = rows.select("id", tfidf.words(F.col(text)).alias("words"))
    terms = words.select(F.explode(F.array_distinct("words")).alias("term")).distinct()
    buckets = 1 + (rows.agg(F.sum(F.length(text))).first()[0] or 0) // BLOCK_CHARS
    shared = spark.sparkContext.broadcast(places)
    names = ["kind", "bucket", "keys", "parents", "rows", "tfs"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(lo, SLICE) for x in batches for lo in range(0, x.num_rows, SLICE)):
            for entry in _entries(batch, shared.value, longest, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(entry, types, strict=True)], names=names)

    def built(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]])
        clash, *parts = _block(table["kind"][0].as_py(), read("keys", np.uint64), read("parents", np.uint64), read("rows", np.int32), read("tfs", np.int32), n)
        return pa.table([pa.array([clash]), *(pa.array([p], pa.binary()) for p in parts)], names=["clash", "fit", "score"])

    seed = 0
    while True:
        if terms.groupBy(F.xxhash64(F.lit(seed), "term").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            hashed = words.select("id", F.transform("words", lambda w: F.xxhash64(F.lit(seed), w)).alias("hashes"))  # noqa: B023
            entries = hashed.mapInArrow(packed, "kind int, bucket int, keys binary, parents binary, rows binary, tfs binary")
            blocks = materialize(entries.groupBy("kind", "bucket").applyInArrow(built, "clash boolean, fit binary, score binary"), "blocks")
            if blocks.where("clash").isEmpty():
                return blocks
        seed += 1


def margins(rows: DataFrame, text: str, grid: list[dict]) -> DataFrame:
    """(id, margins) of the rows of the split validation, a margin for each candidate of the grid fitted on the split train.

    rows: id (a number of its own), split, corpus_label, and the text.
    """
    spark = rows.sparkSession
    table = rows.select("id", "split", "corpus_label").toArrow()
    ids, train, label = table["id"].to_numpy(), np.array([s == "train" for s in table["split"].to_pylist()], bool), table["corpus_label"].to_numpy()
    order = np.argsort(ids)
    ids, train, label = ids[order], train[order], label[order]
    n, every = int(train.sum()), len(ids)
    place = np.where(train, np.cumsum(train) - 1, n + np.cumsum(~train) - 1).astype(np.int32)
    y = label[train].astype(int)
    blocks = _blocks(rows, text, max(g["ngram"] for g in grid), (ids, place), n)
    chosen = [(g["ngram"], g["min_df"]) for g in grid]
    found = np.zeros((len(grid), every - n))
    kinds = list(dict.fromkeys(chosen))
    tasks = spark.sparkContext.defaultParallelism
    scale, diagonal = {}, {}
    for kind in kinds:  # of a few; each is as long as the rows twice
        both = _summed(blocks, _lengths, [kind], None, n, (1, every + n), tasks)[0]
        scale[kind] = 1 / np.sqrt(np.where(both[:every] > 0, both[:every], 1))
        diagonal[kind] = both[every:] * scale[kind][:n] ** 2
    most = max(1, GATHERED // (8 * max(1, every) * tasks))
    for lo in range(0, len(grid), most):
        own = range(lo, min(len(grid), lo + most))
        fits, asks, b = {i: newton(y, float(grid[i]["C"])) for i in own}, {}, {}
        for i, fit in fits.items():
            asks[i] = next(fit)
        while asks:
            active = list(asks)
            v = np.array([asks[i] * scale[chosen[i]][:n] for i in active])
            product = _summed(blocks, _multiply, [chosen[i] for i in active], v, n, (len(active), n), tasks)
            for i, kv in zip(active, product, strict=True):
                try:
                    asks[i] = fits[i].send(kv * scale[chosen[i]][:n] + diagonal[chosen[i]] * asks[i] + asks[i].sum())
                except StopIteration as end:
                    b[i] = end.value
                    del asks[i]
        v = np.array([b[i] * scale[chosen[i]][:n] for i in own])
        total = _summed(blocks, _score, [chosen[i] for i in own], v, n, (len(own), every), tasks)
        for i, t in zip(own, total, strict=True):
            found[i] = t[n:] * scale[chosen[i]][n:] + b[i].sum()
    shared = spark.sparkContext.broadcast((ids[~train], found))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        for batch in batches:
            own = values[:, np.searchsorted(known, batch["id"].to_numpy())].T
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(list(own), pa.list_(pa.float64()))], names=["id", "margins"])

    scored = materialize(rows.where("split = 'validation'").select("id").mapInArrow(looked_up, "id long, margins array<double>"), "margins")
    shared.destroy()
    return scored
