"""Truncation, per-repository limits and the processing order.

The per-repository operators work on (repo, path, size, priority) alone and hold
for a repository that owns a large part of all files: no task ever receives all
rows of one repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions.arrays import empty_array
from codecorpus.functions.text import exceeds_lines, first_lines
from codecorpus.operators.common import FILE
from codecorpus.session import cut


def truncate_lines(files: DataFrame, max_lines: int = fixed.MAX_LINES) -> DataFrame:
    """Keep the first lines of each file and flag the files that had more.  ``size`` stays."""
    content = F.col("content")
    return files.withColumns(
        {"truncated": exceeds_lines(content, max_lines), "content": first_lines(content, max_lines)}
    )


def limit_files(files: DataFrame, n: int = fixed.MAX_SCAN_FILES) -> DataFrame:
    """The first ``n`` files of each repository by path, for any ``n``.

    Positions come from a sort over all tasks, so no task ever gets a whole repository.
    Content does not take part in the sort.
    """
    keys = ranked(files, "repo", ["path"], "_rank").filter(F.col("_rank") <= n)
    return files.join(keys.select(*FILE), FILE, "left_semi")


# Rows of a repository that one step of the budget walks at most; the result does not depend on it.
HEAD = 512


def _admit(rows: Column, room: Column, count: Column, max_files: int) -> Column:
    """Walk at most ``max_files`` rows in path order and take what still fits."""
    start = F.struct(
        room.cast("long").alias("room"), count.cast("int").alias("count"), empty_array("string").alias("kept")
    )

    def step(acc: Column, row: Column) -> Column:
        fits = (row["size"] <= acc["room"]) & (acc["count"] < max_files)
        return F.when(
            fits,
            F.struct(
                (acc["room"] - row["size"]).alias("room"),
                (acc["count"] + 1).alias("count"),
                F.concat(acc["kept"], F.array(row["path"])).alias("kept"),
            ),
        ).otherwise(acc)

    return F.aggregate(rows, start, step)


def _first_files(left: DataFrame, max_files: int) -> DataFrame:
    """Files of each repository before the first that doesn't fit, with room, count, last path and whether any is left.

    ``left`` holds repo, path, size, room and count, in no order. Sizes are summed up within
    tasks of a sort over all; what a repository has in earlier tasks is added from a table with
    one row per task and repository. Sums only grow, so what fits is a prefix of the path order.
    """
    placed = cut(left.orderBy("repo", "path").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("repo", "_part").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("repo", "_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("repo").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "repo", "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_bytes", "_rows")]
    )
    running = placed.withColumns({"_bytes": F.sum("size").over(inside), "_rows": F.count("*").over(inside)})
    upto = running.join(before, ["repo", "_part"]).withColumns(
        {"_bytes": F.col("_bytes") + F.col("_bytes_before"), "_rows": F.col("_rows") + F.col("_rows_before")}
    )
    fits = (F.col("_bytes") <= F.col("room")) & (F.col("count") + F.col("_rows") <= max_files)
    return cut(upto.select("repo", "path", "size", "room", "count", "_bytes", "_rows", fits.alias("fits")))


def admit_within_budget(
    files: DataFrame, max_total: int = fixed.MAX_SCAN_BYTES, max_files: int = fixed.MAX_SCAN_FILES
) -> DataFrame:
    """Per repository, in path order, take every file that still fits the byte budget, up to a number.

    A file that does not fit is skipped and the walk goes on.  Room only shrinks, so a file
    larger than the present room never fits again and is dropped at once.  Each round first
    takes all files before the first misfit, however many, by sums over all tasks; then it
    walks the next ``HEAD`` files that fit the present room, which decide the walk up
    to the last of them.  Rounds follow the misfits and not the number of files; no task ever
    gets more than ``HEAD`` rows of a repository together.
    """
    slim = cut(files.select("repo", "path", F.col("size").cast("long").alias("size")))
    left = slim.withColumns({"room": F.lit(max_total).cast("long"), "count": F.lit(0).cast("long")})
    admitted = None

    def take(kept: DataFrame) -> None:
        nonlocal admitted
        admitted = kept if admitted is None else admitted.unionByName(kept)

    while True:
        first = _first_files(left.filter(F.col("size") <= F.col("room")), max_files)
        take(first.filter("fits").select("repo", "path"))
        state = first.groupBy("repo").agg(
            (F.first("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("_bytes"))), F.lit(0))).alias("room"),
            (F.first("count") + F.coalesce(F.max(F.when(F.col("fits"), F.col("_rows"))), F.lit(0))).alias("count"),
        )
        state = state.filter(F.col("count") < max_files)
        rest = first.filter(~F.col("fits")).select("repo", "path", "size").join(state, "repo")
        left = cut(rest.filter(F.col("size") <= F.col("room")))
        order = Window.partitionBy("repo").orderBy("path")
        head = (
            left.withColumn("_rank", F.row_number().over(order))
            .filter(F.col("_rank") <= HEAD)
            .groupBy("repo")
            .agg(
                F.array_sort(F.collect_list(F.struct("path", "size"))).alias("rows"),
                F.first("room").alias("room"),
                F.first("count").alias("count"),
            )
        )
        walked = cut(
            head.withColumn("end", _admit(F.col("rows"), F.col("room"), F.col("count"), max_files)).select(
                "repo",
                F.col("end")["kept"].alias("kept"),
                F.col("end")["room"].alias("room"),
                F.col("end")["count"].cast("long").alias("count"),
                F.when(
                    (F.size("rows") == HEAD) & (F.col("end")["count"] < max_files),
                    F.element_at("rows", -1)["path"],
                ).alias("after"),
            )
        )
        take(walked.select("repo", F.explode("kept").alias("path")))
        still_open = walked.filter(F.col("after").isNotNull()).select("repo", "room", "count", "after")
        if still_open.isEmpty():
            break
        left = cut(
            left.select("repo", "path", "size")
            .join(still_open, "repo")
            .filter((F.col("path") > F.col("after")) & (F.col("size") <= F.col("room")))
            .drop("after")
        )
    return files.join(admitted, FILE, "left_semi")


def ranked(rows: DataFrame, group: str, order: list[str], name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Position 1..n of each row within its group, also for groups that exceed one task.

    Rows are sorted over all tasks by (group, order).  Within a task, positions
    follow from the order in which it holds them; the rows a group has in earlier tasks are added
    from a table with one row per task and group.  ``keep`` names columns to carry along.
    """
    slim = cut(rows.select(group, *order, *keep))
    placed = cut(
        slim.orderBy(group, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    runs = placed.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"))
    return placed.join(runs, [group, "_part"]).select(
        group, *order, *keep, (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int").alias(name)
    )


def priority_queue(classified: DataFrame) -> DataFrame:
    """Per repository the processing order: ascending priority, then path, as ``queue_pos`` 1..n."""
    return ranked(classified, "repo", ["priority", "path"], "queue_pos").select("repo", "path", "priority", "queue_pos")


def next_file(classified: DataFrame) -> DataFrame:
    """Head of each repository's queue; found by an aggregate, without ordering the rest."""
    head = F.min(F.struct("priority", "path")).alias("head")
    return classified.groupBy("repo").agg(head).select("repo", "head.path", "head.priority")
