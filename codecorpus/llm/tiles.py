"""All pairs inside blocks of any size, in tiles of bounded size, without emitting a pair."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import Group, over_groups, written

KEYS = ["block", "g1", "t1", "g2", "t2"]


def compare_tiles(
    members: DataFrame,
    payload: DataFrame,
    work: Callable,
    schema: str,
    ratio: float,
    rows: int = 128,
    weight: int = 2_000_000,
    together: int = 0,
) -> DataFrame:
    """Compare all members of a block whose sizes differ by no more than ``ratio``.

    ``members``: block long, id long, size long (1 or more) and what else ``work`` needs;
    ``payload``: id and the large columns it needs, joined when the tiles are known.
    Sizes fall into classes of that ratio, so only a class and the next can match. A class
    of a block is dealt by id into tiles of about ``rows`` members and ``weight`` of size;
    each pair of tiles is one task's group. A block that fits one tile stays whole.
    ``work(left, right)`` gets two tiles, or one tile and None, as arrays without repeated
    ids, and returns rows of ``schema``. With ``together`` it gets a list of such pairs, of about so many rows in all.
    """
    sized = members.withColumn("g", F.floor(F.log(F.col("size")) / F.lit(math.log(1 / ratio) * (1 + 1e-9))).cast("int"))
    counts = sized.groupBy("block", "g").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    block, line = Window.partitionBy("block"), Window.partitionBy("block").orderBy("g")
    counts = (
        counts.withColumn("n_tiles", F.ceil(F.greatest(F.col("n") / rows, F.col("w") / weight)).cast("int"))
        .withColumn("whole", (F.sum("n").over(block) <= rows) & (F.sum("w").over(block) <= weight))
        .withColumn("before", F.when(F.lag("g").over(line) == F.col("g") - 1, F.lag("n_tiles").over(line)).otherwise(0))
        .withColumn("after", F.when(F.lead("g").over(line) == F.col("g") + 1, F.lead("n_tiles").over(line)).otherwise(0))
        .select("block", "g", "n_tiles", "whole", "before", "after")
    )
    counts = written(counts, "tiles", narrow=True)
    dealt = sized.join(counts, ["block", "g"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("n_tiles")).cast("int"))

    def key(g1, t1, g2, t2, side):
        return F.struct(
            g1.cast("int").alias("g1"), t1.cast("int").alias("t1"), g2.cast("int").alias("g2"), t2.cast("int").alias("t2"), F.lit(side).alias("side")
        )

    zero, g, t = F.lit(0), F.col("g"), F.col("t")

    def upto(n):
        return F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))

    own = F.transform(
        upto(F.col("n_tiles")),
        lambda j: F.when(j > t, key(g, t, g, j, 0)).when(j < t, key(g, j, g, t, 1)).otherwise(key(g, t, g, t, 0)),
    )
    above = F.transform(upto(F.col("after")), lambda j: key(g, t, g + 1, j, 0))
    below = F.transform(upto(F.col("before")), lambda j: key(g - 1, j, g, t, 1))
    tiles = F.when(F.col("whole"), F.array(key(zero, zero, zero, zero, 0))).otherwise(F.concat(own, above, below))
    columns = [*members.columns, *[c for c in payload.columns if c != "id"]]
    tiled = dealt.select(*members.columns, tiles.alias("tiles")).hint("merge").join(payload, "id")
    placed = tiled.select(*columns, F.explode("tiles").alias("tile")).select(*columns, "tile.*")

    def tiles_of(group: Group) -> tuple[Group, Group | None] | None:
        if group["g1"][0] == group["g2"][0] and group["t1"][0] == group["t2"][0]:
            only = _once(group)
            return (only, None) if len(only["id"]) > 1 else None
        left, right = (_once({c: v[group["side"] == side] for c, v in group.items()}) for side in (0, 1))
        return (left, right) if len(left["id"]) and len(right["id"]) else None

    def run(group: Group) -> list[tuple] | None:
        found = tiles_of(group)
        return work(*found) if found else None

    def run_all(groups: list[Group]) -> list[tuple]:
        return work([found for found in map(tiles_of, groups) if found])

    return over_groups(placed, KEYS, run_all if together else run, schema, least=2, together=together)


def _once(group: Group) -> Group:
    """Rows without those whose id has come before."""
    ids, first = np.unique(group["id"], return_index=True)
    return group if len(ids) == len(group["id"]) else {c: v[np.sort(first)] for c, v in group.items()}


class Forest:
    """Union-find over positions; ``join`` tells whether two parts have met for the first time."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True
