"""Helpers shared by the operators: written tables, row keys, streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.session import scratch_path


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """The frame as a table in the shared folder: a lost executor costs a re-read, not a re-run.

    ``narrow`` rows, a few numbers each, are dealt out evenly again, to a file per core or a sixteenth of the shuffle's
    partitions: a file costs more than its rows there, and on a local file system an executor starts programs for each.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    if narrow:
        frame = frame.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't have, so that extra columns never clash."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(identity: Column, text: Column) -> tuple[Column, Column]:
    """Two longs, never null, that tell rows apart by id and text; equal rows share them.

    Null ids are told apart by their texts, so they don't meet in one task.
    """
    return F.coalesce(identity.cast("long"), F.lit(-1)), F.xxhash64(identity, F.isnull(identity), F.isnull(text), text)


def in_slices(frames: Iterator[pd.DataFrame], column: str, most: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """The same rows in pieces of about ``most`` characters, so memory follows the piece and not the batch."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64) + 64
        piece = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(frame)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield frame.iloc[start:stop]


Group = dict[str, np.ndarray]


def in_groups(frames: Iterator[pd.DataFrame], keys: list[str], least: int = 1) -> Iterator[Group]:
    """Groups of equal keys, as arrays, out of batches that are sorted by them.

    Only one group is held back. Groups of fewer than ``least`` rows are passed over at once.
    """
    held: list[Group] = []
    for frame in frames:
        if not len(frame):
            continue
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        changed = np.zeros(len(frame) - 1, dtype=bool)
        for k in keys:
            changed |= columns[k][1:] != columns[k][:-1]
        cuts = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(frame)]])

        def part(i: int, columns: Group = columns, cuts: np.ndarray = cuts) -> Group:
            return {c: v[cuts[i] : cuts[i + 1]] for c, v in columns.items()}

        last = len(cuts) - 2
        if held and any(held[-1][k][-1] != columns[k][0] for k in keys):
            yield _joined(held)
            held = []
        first = 0
        if held:
            held.append(part(0))
            first = 1
            if last > 0:
                yield _joined(held)
                held = []
        for i in np.flatnonzero(np.diff(cuts) >= least):
            if first <= i < last:
                yield part(i)
        if last >= first:
            held = [part(last)]
    if held:
        yield _joined(held)


def in_lists(groups: Iterator[Group], rows: int) -> Iterator[list[Group]]:
    """Groups in lists of about so many rows."""
    held, n = [], 0
    for group in groups:
        held.append(group)
        n += len(next(iter(group.values())))
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def _joined(parts: list[Group]) -> Group:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def over_groups(frame: DataFrame, keys: list[str], work: Callable, schema: str, least: int = 1, together: int = 0) -> DataFrame:
    """``work`` on every group of equal keys: one shuffle, a sort in each partition, a stream of groups.

    Thousands of groups pass through one Python call; a batch of results is handed on at a time.
    ``work`` gets the columns as arrays and returns rows of ``schema``. With ``together`` it gets a list of groups,
    of about so many rows in all; such work is worth more than its bytes tell, so every partition of the shuffle is a task.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list[tuple] = []
        groups = in_groups(frames, keys, least)
        for group in in_lists(groups, together) if together else groups:
            ready += work(group) or []
            if len(ready) > 20_000:
                yield as_frame(ready, names)
                ready = []
        if ready:
            yield as_frame(ready, names)

    dealt = frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if together else frame.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInPandas(run, schema)


def as_frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as a frame; whole numbers stay whole where a column has nulls."""
    return pd.DataFrame({n: pd.Series(c, dtype=object) if None in c else list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
