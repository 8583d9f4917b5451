"""Train, validation and test splits that keep similarity groups together."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def apportion(count: int, train: float, validation: float) -> dict[str, int]:
    """Whole numbers near the shares: what rounding down leaves goes to the largest remainders, earlier first."""
    exact = [count * share for share in (train, validation, 1 - train - validation)]
    whole = [int(x) for x in exact]
    by_rest = sorted(range(3), key=lambda i: (whole[i] - exact[i], i))
    for i in by_rest[: count - sum(whole)]:
        whole[i] += 1
    return dict(zip(SPLITS, whole, strict=True))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _fold(groups: pd.DataFrame, targets: dict[str, int], seed: int) -> pd.DataFrame:
    """Give each group, largest first, to the split that it fills least."""
    order = sorted(zip(groups["similarity_group_id"], groups["members"], strict=True), key=lambda g: (-g[1], _sha(f"{seed}:{g[0]}")))
    filled = dict.fromkeys(targets, 0)
    chosen = {}
    for gid, n in order:
        fill = {s: ((filled[s] + n) / t if t else float("inf"), _sha(f"{seed}:{gid}:{s}")) for s, t in targets.items()}
        chosen[gid] = min(fill, key=fill.get)
        filled[chosen[gid]] += n
    return groups[["similarity_group_id"]].assign(split=[chosen[g] for g in groups["similarity_group_id"]])


def assign(groups: DataFrame, targets: dict[str, int], seed: int) -> DataFrame:
    """(similarity_group_id, split) for groups (source, similarity_group_id, members).

    One fold a source, as each choice depends on those before. A fold gets one row a group, not a message.
    """
    shape = "similarity_group_id string, split string"
    return groups.select("source", "similarity_group_id", "members").groupBy("source").applyInPandas(lambda g: _fold(g, targets, seed), shape)


def pivot(manifest: DataFrame) -> DataFrame:
    """Messages by source and split."""
    return manifest.groupBy("source").pivot("split", list(SPLITS)).count().na.fill(0)


def leaking(manifest: DataFrame) -> DataFrame:
    """Groups in more than one split."""
    return manifest.groupBy("similarity_group_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")
