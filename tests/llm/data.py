"""Small documents with the cases that operators must stand: nulls, empty and long texts, repeats, ties."""

import random

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long, h long, score double, k int, spans string, root long"


def documents(spark, rows):
    """rows of (doc_id, text, source), with other columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, None, s, len(t or ""), 7, 8, 0.5, 9, "sp", 3) for i, t, s in rows], SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def near_copies(seed=5, groups=12):
    """Texts with exact and near copies of several degrees."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = words(rng, rng.choice((2, 3, 30, 80)), 5000).split()
        for c in range(rng.choice((1, 2, 5))):
            copy = list(base)
            for _ in range(c * rng.choice((0, 1, 1, 2))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy), f"s{g % 3}"))
    return rows


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


__all__ = ["Row", "by_id", "documents", "near_copies", "words"]
