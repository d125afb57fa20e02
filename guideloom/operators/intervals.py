"""Continuous spans and gaps of intervals per entity (problem 7).

Method: sort by start per entity, compare each start with the running maximum of the previous
ends, label islands cumulatively, aggregate spans and derive gaps. The sort is one range
partitioning over (entity, start, end), so an entity with a third of all rows fills many
partitions; each partition merges its own run of intervals, and the running maximum and the open
island's label are then carried over the partition bounds, two rows of state per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guideloom.plans.ordering import batches, partition_no, range_sorted, starts
from guideloom.plans.scratch import Scratch

LOWEST = -(2**62)


def _running_maximum(values: np.ndarray, group_no: np.ndarray, carried: int) -> np.ndarray:
    """Inclusive maximum within each group; the first group goes on from ``carried``."""
    out = values.copy()
    bounds = np.flatnonzero(np.diff(group_no)) + 1
    if len(bounds) * 8 > len(values):  # many short groups: rank the values, so that groups can be told apart by offset
        ranked, order = np.unique(values, return_inverse=True)
        lifted = np.maximum.accumulate(order + (group_no - group_no[0]) * (len(ranked) + 1))
        out = ranked[lifted - (group_no - group_no[0]) * (len(ranked) + 1)]
    else:
        for a, b in zip([0, *bounds], [*bounds, len(values)], strict=True):
            out[a:b] = np.maximum.accumulate(values[a:b])
    same = group_no == group_no[0]
    out[same] = np.maximum(out[same], carried)
    return out


def _local_islands(schema: pa.Schema):
    """Streams one sorted partition: its intervals merged as far as the partition alone allows.

    Rows with ``bound`` describe the partition's first and last entity: the largest end seen.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = partition_no()
        before: tuple | None = None
        carried = LOWEST  # largest end so far of the open entity
        island: list = []  # entity, start, end, largest end before it
        bound: list = []
        first = True  # still in the partition's first entity

        def table(ent: pa.Array, lo, hi, prev, bound: bool = False) -> pa.RecordBatch:
            k = len(ent)
            columns = [ent, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(prev, pa.int64(), mask=np.asarray(prev) == LOWEST)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(k, pid), pa.int32()), pa.array([bound] * k, pa.bool_())], schema=schema)

        def single(row: list, bound: bool = False) -> pa.RecordBatch:
            return table(pa.array(row[:1], schema.field(0).type), *([x] for x in row[1:]), bound)

        for batch in batches(it):
            ent = batch.column(0)
            lo, hi = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            new_entity = starts([ent], before)
            upto = _running_maximum(hi, np.cumsum(new_entity), LOWEST if new_entity[0] else carried)
            prev = np.append(carried, upto[:-1])
            prev[new_entity] = LOWEST
            at = np.flatnonzero((prev == LOWEST) | (lo > prev + 1))
            head = at[0] if len(at) else len(lo)
            if first and (turn := np.flatnonzero(new_entity)[int(before is None) :]).size:
                first = False
                bound = [before[0] if before else ent[0].as_py(), None, int(upto[turn[0] - 1]) if turn[0] else carried, LOWEST]
            if head:  # the open island goes on
                island[2] = max(island[2], int(upto[head - 1]))
            if len(at):
                if island:
                    yield single(island)
                ends = upto[np.append(at[1:], len(lo)) - 1]
                if len(at) > 1:
                    yield table(ent.take(pa.array(at[:-1])), lo[at[:-1]], ends[:-1], prev[at[:-1]])
                z = int(at[-1])
                island = [ent[z].as_py(), int(lo[z]), int(ends[-1]), int(prev[z])]
            carried, before = int(upto[-1]), (ent[len(lo) - 1].as_py(),)
        if island:
            yield single(island)
            yield single([before[0], None, carried, LOWEST], True)
            if bound:
                yield single(bound, True)

    return run


def spans_and_gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Columns entity, span_kind (`merged` or `gap`), start, end of the continuous spans and the gaps between them.

    Both coordinates are included; a segment that starts right after another's last base continues
    it. Rows with a null coordinate or start > end take no part. A null entity is an entity.
    Repeated rows change nothing; an empty table gives no rows. Other columns are not read.
    """
    rows = df.select(F.col(entity).alias("ent"), F.col(start).cast("long").alias("lo"), F.col(end).cast("long").alias("hi")).where("lo <= hi")
    local_type = T.StructType(
        [T.StructField("ent", rows.schema["ent"].dataType)]
        + [T.StructField(x, T.LongType()) for x in ("lo", "hi", "prev")]
        + [T.StructField("pid", T.IntegerType()), T.StructField("bound", T.BooleanType())]
    )
    ordered = range_sorted(rows, "ent", "lo", "hi")
    local = Scratch(df.sparkSession, "spans").written(ordered.mapInArrow(_local_islands(to_arrow_schema(local_type)), local_type))
    islands = local.where("not bound").drop("bound")

    # At most two rows of each partition: what earlier partitions hold of its first and last entity.
    earlier = Window.partitionBy("ent").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    seen = local.where("bound").groupBy("ent", "pid").agg(F.max("hi").alias("hi"))
    wide = Window.partitionBy("ent")
    carry = (
        seen.select("ent", "pid", F.max("hi").over(earlier).alias("carry"), F.count(F.lit(1)).over(wide).alias("parts"))
        .where("parts > 1")
        .select(F.col("ent").alias("c_ent"), F.col("pid").alias("c_pid"), "carry")
    )
    placed = islands.join(F.broadcast(carry), F.col("ent").eqNullSafe(F.col("c_ent")) & (F.col("pid") == F.col("c_pid")), "left")
    placed = placed.withColumn("prev", F.greatest("prev", "carry")).withColumn("new", F.col("prev").isNull() | (F.col("lo") > F.col("prev") + 1))
    across = placed.where("c_pid is not null")
    label = (
        across.groupBy("ent", "pid")
        .agg(F.max(F.when(F.col("new"), F.col("lo"))).alias("last"))
        .select(F.col("ent").alias("l_ent"), F.col("pid").alias("l_pid"), F.max("last").over(earlier).alias("label"))
    )
    merged = (
        across.join(F.broadcast(label), F.col("ent").eqNullSafe(F.col("l_ent")) & (F.col("pid") == F.col("l_pid")), "left")
        .groupBy("ent", F.when(F.col("new"), F.col("lo")).otherwise(F.col("label")).alias("lo"))
        .agg(F.max("hi").alias("hi"))
    )
    spans = placed.where("c_pid is null").select("ent", "lo", "hi").unionByName(merged).withColumn("span_kind", F.lit("merged"))
    gaps = placed.where("new and prev is not null").select("ent", (F.col("prev") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"), F.lit("gap").alias("span_kind"))
    return spans.unionByName(gaps).select(F.col("ent").alias(entity), "span_kind", F.col("lo").alias(start), F.col("hi").alias(end))
