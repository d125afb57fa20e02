"""Occurrence and record counts of every value or n-gram (problem 6).

Method: a suffix array over the records' tokens, in Spark a global range-partitioned sort of all
suffixes (cut to the longest n-gram asked for) with the record as tie-break. Neighbours' common
prefix lengths bound, for each n, the intervals of equal n-grams: an interval's length is the
occurrence count, and its record count is that length less the adjacencies of one record within
it. An interval that touches a partition bound may go on in the next partition: it is handed on
as counts per (n-gram, record), which are added up in a shuffle on both, so that a term that holds
a third of all rows is spread by record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guideloom.plans.ordering import batches, codes, range_sorted
from guideloom.plans.scratch import Scratch

BLOCK = 200_000  # suffixes held at once in a task; an interval cut here counts as one at a bound


def _token_table(suffixes: pa.Array, top: int) -> np.ndarray:
    """Row by row the suffix's first ``top`` tokens (of a string: its characters) as numbers, -1 after its end."""
    if pa.types.is_string(suffixes.type):
        units = np.array(suffixes.to_pylist(), dtype=f"U{top}").view(np.uint32).reshape(len(suffixes), top)
        size = pc.utf8_length(suffixes).to_numpy(zero_copy_only=False)
        return np.where(np.arange(top) < size[:, None], units.astype(np.int64), -1)
    size = suffixes.value_lengths().to_numpy(zero_copy_only=False)
    inside = np.arange(top) < size[:, None]
    table = np.full((len(suffixes), top), -1, dtype=np.int64)
    table[inside] = codes(suffixes.flatten())
    return table


def _common_prefix(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: length of the common prefix with the row before it, and its own length."""
    same = (table[1:] == table[:-1]) & (table[1:] >= 0)
    lcp = np.zeros(len(table), dtype=np.int64)
    lcp[1:] = np.minimum.accumulate(same, axis=1).sum(axis=1)
    return lcp, (table >= 0).sum(axis=1)


def _interval_counts(top: int, min_n: int, schema: pa.Schema):
    """Streams one sorted partition of (suffix, record) and yields the intervals' counts."""

    def counted(suffixes: pa.Array, records: pa.Array) -> Iterator[pa.RecordBatch]:
        lcp, lengths = _common_prefix(_token_table(suffixes, top))
        record = codes(records)
        for n in range(min_n, top + 1):
            long = np.flatnonzero(lengths >= n)
            if not len(long):
                continue
            # Rows too short for n only stand at the head of a shared prefix, so the cut is the least of what lies between.
            cut = np.minimum.reduceat(lcp, long) if len(long) == len(lcp) else np.array([lcp[a + 1 : b + 1].min() for a, b in zip(np.append(-1, long[:-1]), long, strict=True)])
            cut[0] = 0
            interval = np.cumsum(cut < n) - 1
            rec = record[long]
            order = np.lexsort((rec, interval))
            again = np.zeros(len(long), dtype=bool)
            again[1:] = (interval[order][1:] == interval[order][:-1]) & (rec[order][1:] == rec[order][:-1])
            tf = np.bincount(interval)
            df = tf - np.bincount(interval[order], weights=again).astype(np.int64)
            head = long[np.flatnonzero(cut < n)]
            bound = np.zeros(len(tf), dtype=bool)
            bound[0] = bound[-1] = True
            inner = np.flatnonzero(~bound)
            if len(inner):
                yield rows(suffixes, head[inner], n, tf[inner], df[inner], None)
            at_bound = np.flatnonzero(bound[interval[order]] & ~again)  # first row of each (n-gram, record)
            ends = np.append(np.flatnonzero(~again)[1:], len(long))[np.searchsorted(np.flatnonzero(~again), at_bound)]
            yield rows(suffixes, long[order][at_bound], n, ends - at_bound, np.ones(len(at_bound), np.int64), records.take(pa.array(long[order][at_bound])))

    def rows(suffixes: pa.Array, at: np.ndarray, n: int, tf, df, records) -> pa.RecordBatch:
        cut = pc.utf8_slice_codeunits if pa.types.is_string(suffixes.type) else pc.list_slice
        grams = cut(suffixes.take(pa.array(at)), 0, n)
        k = len(at)
        bound = records is not None
        columns = [grams.cast(schema.field(0).type), pa.array(np.full(k, n), pa.int32()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())]
        columns += [records if bound else pa.nulls(k, pa.string()), pa.array(np.full(k, bound), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches(it):
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                block = pa.Table.from_batches(held).combine_chunks()
                held = []
                yield from counted(block.column(0).chunk(0), block.column(1).chunk(0))
        if held:
            block = pa.Table.from_batches(held).combine_chunks()
            yield from counted(block.column(0).chunk(0), block.column(1).chunk(0))

    return run


def ngram_counts(df: DataFrame, tokens: Column, record: Column, max_n: int = 1, min_n: int = 1, tie: Column | None = None) -> DataFrame:
    """Columns ngram, n, occurrences, records: counts of all n-grams of min_n to max_n tokens.

    ``tokens`` is an array of strings (n-grams are arrays) or a string (its characters are the
    tokens, n-grams are strings; for short strings, as cutting costs their length squared: give long
    texts as arrays). Rows where it or ``record`` is null take no part, an empty one
    has no n-grams, a null token counts as an empty string. ``tie`` only spreads rows with equal
    suffix and record over partitions; it must be deterministic. Every row counts, also repeated
    ones. An empty table gives no rows. Other columns are not read.
    """
    if not 1 <= min_n <= max_n:
        raise ValueError("1 <= min_n <= max_n must hold")
    base = df.select(tokens.alias("toks"), record.cast("string").alias("rec"), (F.xxhash64(tie) if tie is not None else F.lit(0)).alias("tie")).where(
        "toks is not null and rec is not null"
    )
    kind = base.schema["toks"].dataType
    if isinstance(kind, T.StringType):
        at = F.transform(F.sequence(F.lit(1), F.length("toks") - min_n + 1), lambda i: F.substring("toks", i, F.lit(max_n)))
        suffixes = base.where(F.length("toks") >= min_n).select(F.explode(at).alias("suffix"), "rec", "tie")
    else:
        clean = F.transform("toks", lambda x: F.coalesce(x, F.lit("")))
        if max_n == 1:
            suffixes = base.select(F.explode(F.transform(clean, lambda x: F.array(x))).alias("suffix"), "rec", "tie")
        else:
            at = F.transform(F.sequence(F.lit(1), F.size("toks") - min_n + 1), lambda i: F.slice("toks", i, max_n))
            suffixes = base.withColumn("toks", clean).where(F.size("toks") >= min_n).select(F.explode(at).alias("suffix"), "rec", "tie")
    ordered = range_sorted(suffixes, "suffix", "rec", "tie").select("suffix", "rec")
    local_type = T.StructType(
        [T.StructField("ngram", suffixes.schema["suffix"].dataType), T.StructField("n", T.IntegerType())]
        + [T.StructField(x, T.LongType()) for x in ("occurrences", "records")]
        + [T.StructField("rec", T.StringType()), T.StructField("bound", T.BooleanType())]
    )
    local = Scratch(df.sparkSession, "ngrams").written(ordered.mapInArrow(_interval_counts(max_n, min_n, to_arrow_schema(local_type)), local_type))
    by_record = local.where("bound").groupBy("ngram", "n", "rec").agg(F.sum("occurrences").alias("occurrences"))
    bounds = by_record.groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    return local.where("not bound").select("ngram", "n", "occurrences", "records").unionByName(bounds)
