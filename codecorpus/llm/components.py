"""Connected components of edges of any number: contraction in tasks, then pointers to smaller nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import written

#: Edges that a task contracts at a time.
CHUNK = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the least of its component, and that least node."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        root = root[root]
        if np.array_equal(root, before):
            break
    lower = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[lower], nodes[root[lower]]


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0

    def done() -> pd.DataFrame:
        frame = pd.concat(held)
        u, v = contracted(frame.u.to_numpy(), frame.v.to_numpy())
        return pd.DataFrame({"u": u, "v": v})

    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= CHUNK:
            yield done()
            held, n = [], 0
    if n:
        yield done()


def _settled(pairs: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no node is on both sides."""
    ends = pairs.select("u", F.lit(1).alias("lower"), F.lit(0).alias("upper")).unionAll(
        pairs.select(F.col("v").alias("u"), F.lit(0), F.lit(1))
    )
    odd = ends.groupBy("u").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper"))
    return odd.where("lower > 1 or (lower = 1 and upper = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of edges ``a, b`` (longs); root is the least node of its component.

    Edges with a null and loops count for nothing. An edge points from its larger node to the
    smaller one and is shuffled by the larger, so the many members around one hub are spread.
    Tasks contract what they hold, a bounded number of edges at a time, to pointers to the
    least node they know. Then pointers are followed one step, in a plain join that Spark
    splits where a hub is hot, and so on until all nodes point to a root. Stars take one
    round, chains about log n. Every round is written, so a lost executor costs one round at most.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        pairs = written(pairs.repartition("u").mapInPandas(_contract, "u long, v long"), "components", narrow=True)
        if _settled(pairs):
            break
        upper = pairs.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w"))
        pairs = pairs.join(upper, "v", "left").select("u", F.coalesce("w", "v").alias("v")).unionAll(upper.select(F.col("v").alias("u"), F.col("w").alias("v")))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
