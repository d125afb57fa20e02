"""Per-key aggregates where a few keys hold most rows (problem 1).

Method: multi-level tree aggregation. Each input split (a chunk of fixed size,
``spark.sql.files.maxPartitionBytes``) combines its own rows per key; the partial states then
meet in rounds of bounded fan-in. In round r a state belongs to node ``split mod fan_in^(R-r)``,
so a task merges at most about ``fan_in`` states of one key, and the last round sees ``fan_in``
states of a key however many splits there were. R is the logarithm of the number of splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Partial:
    """A mergeable aggregate: ``first`` makes a state of rows, ``merge`` one of states."""

    first: Column
    merge: str  # sum, min, max, bit_or
    name: str

    def again(self) -> Column:
        return getattr(F, self.merge)(F.col(self.name)).alias(self.name)


def count_of(name: str, condition: Column | None = None) -> Partial:
    """Rows, or rows that meet a condition (null counts as not met)."""
    first = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return Partial(first.alias(name), "sum", name)


def sum_of(name: str, value: Column) -> Partial:
    return Partial(F.sum(value).alias(name), "sum", name)


def min_of(name: str, value: Column) -> Partial:
    return Partial(F.min(value).alias(name), "min", name)


def max_of(name: str, value: Column) -> Partial:
    return Partial(F.max(value).alias(name), "max", name)


def tree_rounds(splits: int, fan_in: int) -> int:
    """Rounds of merging that ``splits`` chunks need; at least one."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    rounds = 1
    while fan_in**rounds < splits:
        rounds += 1
    return rounds


def estimated_splits(df: DataFrame) -> int:
    """Number of chunks of df's input by the size of its sources as Spark's plan states it; nothing is run."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    chunk = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    splits = 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        rows_in_memory = leaf.getClass().getSimpleName() == "LogicalRDD"  # has partitions, but no size
        splits += leaf.rdd().getNumPartitions() if rows_in_memory else -(-int(str(leaf.stats().sizeInBytes())) // chunk)
    return max(spark.sparkContext.defaultParallelism, splits)


def tree_aggregate(df: DataFrame, keys: list[str], partials: list[Partial], fan_in: int = 8, splits: int | None = None) -> DataFrame:
    """One row per distinct value of ``keys`` (null is a value) with the aggregates.

    Columns: the keys, then each partial's name. An empty table gives no rows. Rows are neither
    sampled nor dropped; repeated rows count as often as they occur. Other columns of df, of
    whatever name, are not read. Empty and very long key strings are ordinary keys. ``splits``
    is about the number of df's partitions; it is estimated if not given.
    """
    names = [p.name for p in partials]
    if clash := set(keys) & set(names):
        raise ValueError(f"aggregates named like keys: {sorted(clash)}")
    if "__node" in keys or "__node" in names:
        raise ValueError("__node is reserved")
    rounds = max(2, tree_rounds(splits or estimated_splits(df), fan_in))  # never all partials of a key in one task at once
    key_columns = [F.col(k) for k in keys]
    node = F.pmod(F.spark_partition_id(), F.lit(fan_in ** (rounds - 1)))
    level = df.withColumn("__node", node).groupBy(*key_columns, "__node").agg(*(p.first for p in partials))
    for r in range(2, rounds):
        level = (
            level.withColumn("__node", F.pmod("__node", F.lit(fan_in ** (rounds - r))))
            .groupBy(*key_columns, "__node")
            .agg(*(p.again() for p in partials))
        )
    return level.groupBy(*key_columns).agg(*(p.again() for p in partials))


def stacked_keys(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """A row (key_field, key_value, kept columns) per row and key field, in one pass over df."""
    pairs = F.array(*(F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields))
    return df.select(F.inline(pairs), *keep) if keep else df.select(F.inline(pairs))


def heavy_keys(df: DataFrame, fields: list[str], per: int = 50, fan_in: int = 8) -> DataFrame:
    """(key_field, key_value) of non-null values that hold at least 1/per of all rows of df.

    A null value is no case but its row counts among all rows. An empty table gives no rows.
    """
    counts = tree_aggregate(stacked_keys(df, fields, []), ["key_field", "key_value"], [count_of("n")], fan_in)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col("key_value").isNotNull() & (F.col("n") * per >= total)).select("key_field", "key_value")


__all__ = ["Partial", "count_of", "heavy_keys", "max_of", "min_of", "stacked_keys", "sum_of", "tree_aggregate", "tree_rounds"]
