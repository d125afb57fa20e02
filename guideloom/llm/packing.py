"""Items packed into containers of fixed capacity (problem 9).

Method: hierarchical residual packing. Each partition packs its items best-fit, largest first;
bins that are nearly full, or that no item of the whole collection could still enter, are done.
Underfull bins go on as items of their fill, and the tree of rounds merges them: a round's
partitions hold a fixed number of bins, so tasks stay bounded, and rounds end when one partition
was enough or a round no longer saves bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guideloom.plans.ordering import batches
from guideloom.plans.scratch import Scratch

NEARLY_FULL = 0.995
BINS_PER_TASK = 20_000
LEAST_SAVING = 0.005
BIN = T.StructType([T.StructField("item", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("size", T.LongType())])


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin number of each size (given largest first) and the fill of each bin; an item enters the fullest bin it fits in."""
    place: list[int] = []
    fill: list[int] = []
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    for size in sizes:
        k = bisect_left(open_bins, (size, -1))
        if k < len(open_bins):
            room, b = open_bins.pop(k)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        place.append(b)
        fill[b] += size
        if room > size:
            insort(open_bins, (room - size, b))
    return place, fill


def _pack(capacity: int, schema: pa.Schema):
    """Packs one partition of (item, size); a bin is named by the least item in it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches(it))
        if not held:
            return
        table = pa.Table.from_batches(held)
        item, size = (table.column(i).to_numpy() for i in range(2))
        order = np.lexsort((item, -size))
        item, size = item[order], size[order]
        heavy = int((size > 0).sum())
        place, fill = best_fit(size[:heavy].tolist(), capacity)
        bins = max(1, len(fill))
        place = np.concatenate([np.array(place, np.int64), np.arange(len(item) - heavy) % bins])  # items without size are spread over the bins
        name = np.full(bins, np.iinfo(np.int64).max)
        np.minimum.at(name, place, item)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(name[place]), pa.array(size)], schema=schema)

    return run


def split_oversized(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, start, size): an item within the capacity is one part; a larger one is divided into full parts and a rest."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    rows = rows.select("key", "size", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    start = F.col("part").cast("long") * capacity
    return rows.select("key", "part", start.alias("start"), F.least(F.col("size") - start, F.lit(capacity)).alias("size"))


def pack_items(df: DataFrame, key: str, size: str, capacity: int, bins_per_task: int = BINS_PER_TASK) -> DataFrame:
    """Columns container_id, key, part, start, size: every part of every item in exactly one container.

    A container's sizes add up to at most ``capacity``. Items larger than it are divided into full
    parts and a rest (start is the offset); no other item is divided. Null and negative sizes count
    as 0; items without size go into containers that exist. Repeated rows are packed each. An empty
    table gives no rows. Other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    scratch = Scratch(df.sparkSession, "packing")
    sized = df.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    parts = split_oversized(sized, "key", "size", capacity)
    items = scratch.written(parts.withColumn("item", F.monotonically_increasing_id()))
    smallest = items.where("size > 0").agg(F.min("size")).first()[0]
    run = _pack(capacity, to_arrow_schema(BIN))

    count = items.count()
    todo = items.select("item", "size")
    maps: list[DataFrame] = []
    while count:
        tasks = -(-count // bins_per_task)
        spread = todo.repartition(tasks, F.xxhash64("item", F.lit(len(maps))))
        packed = scratch.written(spread.mapInArrow(run, BIN))
        maps.append(packed.select("item", "bin"))
        fills = packed.groupBy("bin").agg(F.sum("size").alias("size"))
        under = fills.where((F.col("size") < NEARLY_FULL * capacity) & (F.col("size") + (smallest or capacity) <= capacity))
        todo = scratch.written(under.select(F.col("bin").alias("item"), "size"))
        now = todo.count()
        if tasks == 1 or (len(maps) > 1 and now > (1 - LEAST_SAVING) * count):
            break
        count = now

    placed = items
    at = "item"
    for i, step in enumerate(maps):
        step = step.select(F.col("item").alias(f"from{i}"), F.col("bin").alias(f"to{i}"))
        placed = placed.join(step, F.col(at) == F.col(f"from{i}"), "left").withColumn(f"at{i}", F.coalesce(f"to{i}", at))
        at = f"at{i}"
    return placed.select(F.col(at).alias("container_id"), F.col("key").alias(key), "part", "start", "size")
