"""The N best items of every group, however large a group is (problem 4).

Method: global range-partitioned sort on group, score and identifier; counts per partition and
group are prefix-summed into exact positions, and positions up to N are kept. A partition passes
on at most N items of each of its groups, so what remains of a group that fills many partitions
is N rows for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guideloom.plans.ordering import batches, codes, partition_no, range_sorted, starts
from guideloom.plans.scratch import Scratch


def _local_best(n: int, schema: pa.Schema):
    """Streams one sorted partition: of each group the first n rows with different items."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = partition_no()
        held: list[tuple] = []  # kept rows of the group that is still open
        seen: set = set()
        before: tuple | None = None
        done: list[tuple] = []
        first = True

        def close(edge: bool) -> None:
            done.extend((*row, pid, pos, edge) for pos, row in enumerate(held, 1))
            held.clear()
            seen.clear()

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return made

        for batch in batches(it):
            grp, item, ident = batch.columns
            new = starts([grp], before)
            bounds = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), batch.num_rows]
            # Of an item that comes more often in a group only the first row of the batch is looked at.
            which = codes(item)
            fresh = np.sort(np.unique(np.stack([np.cumsum(new), which]), axis=1, return_index=True)[1])
            for a, b in zip(bounds, bounds[1:], strict=False):
                if new[a] and before is not None:
                    close(edge=first)  # the partition's first group may have begun before it
                    first = False
                before = (grp[a].as_py(),)
                if len(held) == n:
                    continue
                for i in fresh[np.searchsorted(fresh, a) : np.searchsorted(fresh, b)].tolist():
                    if len(held) == n:
                        break
                    if (x := item[i].as_py()) not in seen:
                        seen.add(x)
                        held.append((before[0], x, ident[i].as_py()))
            if done:
                yield emit()
        close(edge=True)
        if done:
            yield emit()

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, ident: str, n: int) -> DataFrame:
    """Columns group, item, ident, position (1..n): the n best different items of each group.

    An item counts once in a group, by its row with the highest score, then the smallest ident.
    Items rank by score descending, then item ascending (byte order; a null item ranks before
    others and is one item). Rows with a null group, or a null or NaN score, take no part.
    Repeated rows change nothing; an empty table gives no rows. Other columns are not read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(
        F.col(group).alias("grp"), F.col(item).alias("item"), F.col(ident).alias("ident"), F.col(score).cast("double").alias("score")
    ).where("grp is not null and score is not null and not isnan(score)")
    ordered = range_sorted(rows, F.col("grp"), F.col("score").desc(), F.col("item").asc_nulls_first(), F.col("ident"))
    kinds = {f.name: f.dataType for f in rows.schema}
    local_type = T.StructType(
        [T.StructField(x, kinds[x]) for x in ("grp", "item", "ident")]
        + [T.StructField("pid", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("edge", T.BooleanType())]
    )
    kept = Scratch(df.sparkSession, "topn").written(
        ordered.select("grp", "item", "ident").mapInArrow(_local_best(n, to_arrow_schema(local_type)), local_type)
    )
    # Groups at partition bounds: at most 2 n rows of each partition.
    edge = kept.where("edge")
    by_item = Window.partitionBy("grp", "item").orderBy("pid", "pos")
    edge = edge.withColumn("copy", F.row_number().over(by_item)).where("copy = 1").drop("copy")
    local = Window.partitionBy("grp", "pid").orderBy("pos")
    edge = edge.withColumn("pos", F.row_number().over(local).cast("long"))
    counts = edge.groupBy("grp", "pid").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("grp", "pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = edge.join(offsets, ["grp", "pid"]).withColumn("pos", F.col("pos") + F.col("offset")).where(F.col("pos") <= n)
    both = kept.where("not edge").select("grp", "item", "ident", "pos").unionByName(placed.select("grp", "item", "ident", "pos"))
    return both.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("ident").alias(ident), F.col("pos").cast("int").alias("position"))
