"""Balanced contiguous shards by global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import fresh, written

#: Counted for every row besides its text.
ROW_BYTES = 16


def sharded(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with ``size``, ``shard`` (0 to shards - 1) and ``slot`` (place in its shard, gapless from 0).

    Rows are ordered by id (nulls first), then content, over all partitions. Each partition's
    total is summed first; the running sum of these few totals gives every partition its
    offset, and sums inside a partition do the rest, so no task sees more than its share.
    A row that begins at byte b of t in all goes to shard floor(b * shards / t): shards are
    contiguous and differ from t / shards by no more than one document.

    size: UTF-8 bytes of the text (null: none) plus ``ROW_BYTES``. Equal rows are spread by
    their place of reading, so even one row repeated very often is dealt out; which of them
    comes first makes no difference. With fewer documents than shards some shards are empty.
    ``keep_text=False`` shuffles all columns but the text. Columns ``size, shard, slot`` of
    the input are replaced.
    """
    docs = docs.drop("size", "shard", "slot")
    content, spread, part, before, upto, row, start, first = fresh(docs, "content", "spread", "part", "before", "upto", "row", "start", "first")
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + ROW_BYTES
    sized = docs.withColumns({"size": size, content: F.xxhash64(text_column), spread: F.monotonically_increasing_id()})
    if not keep_text:
        sized = sized.drop(text_column)
    order = [F.col(id_column).asc_nulls_first(), F.col("size"), F.col(content), F.col(spread)]
    ordered = written(sized.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ordered")
    of_parts = ordered.groupBy(part).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    line = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_parts.select(
        part, F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias(before), F.coalesce(F.sum("n").over(line), F.lit(0)).alias(first)
    )
    total = of_parts.agg(F.sum("bytes")).first()[0] or 0
    inside = Window.partitionBy(part).orderBy(*order)
    # One row for each partition of the ordered table, so its size is bounded by their number.
    placed = ordered.join(F.broadcast(offsets), part).withColumns(
        {start: F.col(before) + F.sum("size").over(inside) - F.col("size"), row: F.col(first) + F.row_number().over(inside) - 1}
    )
    share = F.expr(f"cast(`{start}` as decimal(38,0)) * cast({shards} as decimal(9,0)) div cast({max(total, 1)} as decimal(38,0))")
    placed = placed.withColumn("shard", share.cast("int"))
    placed = written(placed.drop(content, spread, part, before, first, start), "placed")
    firsts = placed.groupBy("shard").agg(F.min(row).alias(upto))
    # One row for each shard.
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col(row) - F.col(upto)).drop(row, upto)
