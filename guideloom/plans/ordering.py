"""Globally ordered data: range partitions, sorted inside, so that no group needs one task.

A group whose rows fill many partitions is cut at partition bounds. The operators that use this
module stream each sorted partition once and afterwards join what they learned at the bounds:
per partition only its first and its last group can continue elsewhere, so the rows that describe
the bounds number at most two per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_sorted(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in range partitions by ``order``, each sorted by it.

    All order columns must be deterministic, since a lost partition is computed again.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def partition_no() -> int:
    """Number of the partition a task works on; rises with the sort order of range_sorted."""
    return TaskContext.get().partitionId()


def codes(column: pa.Array) -> np.ndarray:
    """Small integers, equal where the values of the batch are equal; null is -1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def starts(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Mask of rows that begin a new group, given the group's values in the row before the batch."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if not n:
        return new
    for column in columns:
        c = codes(column)
        new[1:] |= c[1:] != c[:-1]
    new[0] = before is None or before != tuple(c[0].as_py() for c in columns)
    return new


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The non-empty batches."""
    return (b for b in it if b.num_rows)


def _local_prefix_sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted (key, item, value): sums of the key's earlier values in this partition, and its bounds' totals."""
    pid = partition_no()
    names = ["key", "item", "before", "pid", "bound"]

    def made(key, item, before, bound: bool) -> pa.RecordBatch:
        k = len(key)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(item, pa.int64()), pa.array(before, pa.int64()), pa.array([pid] * k, pa.int32()), pa.array([bound] * k)], names)

    open_key, total, first = None, 0, True
    for batch in batches(it):
        key, item, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = starts([batch.column(0)], None if open_key is None else (open_key,))
        at = np.flatnonzero(new)
        earlier = np.cumsum(value) - value
        head = at[0] if len(at) else len(key)
        before = earlier - earlier[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        before[:head] = earlier[:head] + total
        turn = at[int(open_key is None) :]  # where the partition's second and later keys begin
        if first and len(turn):
            t = int(turn[0])
            yield made([open_key if open_key is not None else int(key[0])], [-1], [int(before[t - 1] + value[t - 1]) if t else total], True)
            first = False
        yield made(key, item, before, False)
        open_key, total = int(key[-1]), int(before[-1] + value[-1])
    if open_key is not None:
        yield made([open_key], [-1], [total], True)


def prefix_sums(df: DataFrame, scratch, key: str, item: str, value: str) -> DataFrame:
    """(key, item, before): for each row the sum of ``value`` over the key's rows with a smaller item.

    All three are whole numbers, not null. One range sort; a key may fill many partitions.
    """
    rows = df.select(*(F.col(c).cast("long").alias(n) for c, n in ((key, "key"), (item, "item"), (value, "value"))))
    local = scratch.written(range_sorted(rows, "key", "item").mapInArrow(_local_prefix_sums, "key long, item long, before long, pid int, bound boolean"))
    earlier = Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.where("bound").select("key", "pid", F.coalesce(F.sum("before").over(earlier), F.lit(0)).alias("carry")).where("carry > 0")
    placed = local.where("not bound").join(F.broadcast(carry), ["key", "pid"], "left")  # at most two rows of each partition
    return placed.select(F.col("key").alias(key), F.col("item").alias(item), (F.col("before") + F.coalesce("carry", F.lit(0))).alias("before"))


def with_next(df: DataFrame, scratch, key: str, item: str) -> DataFrame:
    """(key, item, next): for each row the key's next larger item, or null. Both are whole numbers, not null."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(item).cast("long").alias("item"))
    placed = scratch.written(range_sorted(rows, "key", "item").withColumn("at", F.monotonically_increasing_id()))
    # The row after a partition's last one is the first of the next partition with rows; one row for each partition.
    bounds = placed.groupBy(F.shiftright("at", 33).alias("pid")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    jumps = bounds.select("last", F.lead("first").over(Window.orderBy("pid")).alias("jump"))
    here = placed.join(F.broadcast(jumps), F.col("at") == F.col("last"), "left")
    here = here.select("key", "item", F.coalesce("jump", F.when(F.col("last").isNull(), F.col("at") + 1)).alias("then"))
    there = placed.select(F.col("at").alias("then"), F.col("key").alias("next_key"), F.col("item").alias("next_item"))
    both = here.join(there, "then", "left")
    return both.select(F.col("key").alias(key), F.col("item").alias(item), F.when(F.col("key") == F.col("next_key"), F.col("next_item")).alias("next"))
