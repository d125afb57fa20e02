"""Union, frequencies, filters and summaries of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guideloom.plans.scratch import Scratch

# The order in which search types win, and the limit of the frequency filters.
PRIORITY = ("Exact", "Mismatch", "Indel")
FREQUENCY_LIMIT = 10
HOT_TARGETS = 10
HIT_COLUMNS = ["query_name", "query_seq", "target_name", "target_seq", "distance", "search_type"]


def priority(search_type: Column) -> Column:
    """0 for the kinds of the mismatch search, 1 for the indel search."""
    return F.when(search_type == "Indel", 1).otherwise(0)


def combine_priority(hits: DataFrame) -> DataFrame:
    """One hit per (query_name, target_name): those of the mismatch search first, then the least distance, then the sequences.

    The best row is kept by partial aggregation, so a pair delivered often costs no more than once
    after the first exchange. Nulls in the names are values of their own.
    """
    order = F.struct(priority(F.col("search_type")).alias("p"), "distance", "target_seq", "query_seq", "search_type")
    best = hits.groupBy("query_name", "target_name").agg(F.min(order).alias("b"))
    return best.select("query_name", F.col("b.query_seq"), "target_name", F.col("b.target_seq"), F.col("b.distance"), F.col("b.search_type"))


def with_frequency(hits: DataFrame) -> DataFrame:
    """Adds genomic_frequency: the number of combined hits with the same query_name and target_seq.

    Counted by aggregation and joined back, so that a frequent pair is not one window's partition.
    """
    counts = hits.groupBy("query_name", "target_seq").agg(F.count(F.lit(1)).cast("int").alias("genomic_frequency"))
    keyed = counts.withColumnsRenamed({"query_name": "c_query", "target_seq": "c_seq"})
    same = F.col("query_name").eqNullSafe(F.col("c_query")) & F.col("target_seq").eqNullSafe(F.col("c_seq"))
    return hits.join(keyed, same).drop("c_query", "c_seq")


def raw_hits(hits: DataFrame) -> DataFrame:
    """The seven columns of the raw result: combined hits with their frequency."""
    combined = Scratch(hits.sparkSession, "hits").written(combine_priority(hits))  # read to count and to join
    return with_frequency(combined).select(*HIT_COLUMNS, "genomic_frequency")


def query_summary(scored: DataFrame) -> DataFrame:
    """Per query: hits by kind, distinct targets, hot flag and success rate (product of 1 - score / 2 over inexact hits).

    The product is a sum of logarithms, which aggregates partially; factors of zero are counted.
    Distinct targets are counted over (query, target) first, so a query of a third of all rows is
    spread. Null and NaN scores are left out of the product. Null query names form no summary.
    """
    rows = scored.where("query_name is not null")
    factor = F.when((F.col("search_type") != "Exact") & ~F.isnan("score"), 1 - F.col("score") / 2)
    by_target = rows.groupBy("query_name", "target_name").agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("search_type") == kind).alias(kind.lower()) for kind in PRIORITY),
        F.sum(F.when(F.abs(factor) > 0, F.log(F.abs(factor)))).alias("logs"),
        F.count_if(factor == 0).alias("zeros"),
        F.count_if(factor < 0).alias("negative"),
    )
    sums = by_target.groupBy("query_name").agg(
        *(F.sum(c).alias(c) for c in ("total", "exact", "mismatch", "indel", "zeros", "negative")),
        F.count("target_name").alias("uniq"),
        F.coalesce(F.sum("logs"), F.lit(0.0)).alias("logs"),
    )
    sign = F.when(F.col("negative") % 2 == 1, -1.0).otherwise(1.0)
    rate = F.when(F.col("zeros") > 0, F.lit(0.0)).otherwise(sign * F.exp("logs"))
    return sums.select("query_name", "total", "exact", "mismatch", "indel", "uniq", rate.alias("success_rate"), (F.col("uniq") <= HOT_TARGETS).alias("hot"))


def ordered_summary(summary: DataFrame) -> DataFrame:
    """The summary in report order."""
    return summary.orderBy("uniq", "query_name")


def sequence_counts(df: DataFrame, sequence: str) -> DataFrame:
    """(seq, n): number of rows of each non-null sequence."""
    return df.where(F.col(sequence).isNotNull()).groupBy(F.col(sequence).alias("seq")).agg(F.count(F.lit(1)).alias("n"))


def count_filter(df: DataFrame, sequence: str, limit: int = FREQUENCY_LIMIT) -> DataFrame:
    """Rows whose sequence occurs at most ``limit`` times; rows without a sequence are left out."""
    frequent = sequence_counts(df, sequence).where(F.col("n") > limit).select(F.col("seq").alias("f_seq"))
    return df.where(F.col(sequence).isNotNull()).join(frequent, F.col(sequence) == F.col("f_seq"), "left_anti")


def over_represented(df: DataFrame, sequence: str, limit: int = FREQUENCY_LIMIT) -> DataFrame:
    """(seq, n, record): sequences that occur more often, each once, with a FASTA record."""
    counts = sequence_counts(df, sequence).where(F.col("n") > limit)
    return counts.withColumn("record", F.concat(F.lit(">count_"), F.col("n").cast("string"), F.lit("\n"), F.col("seq")))


def on_target_filter(df: DataFrame, counts: DataFrame, ident: str, sequence: str, limit: int = FREQUENCY_LIMIT) -> DataFrame:
    """(ident, seq, n): the first row by ``ident`` of each sequence whose count in ``counts`` (0 if it is not there) is within ``limit``."""
    first = df.where(F.col(sequence).isNotNull()).groupBy(F.col(sequence).alias("seq")).agg(F.min(ident).alias(ident))
    return first.join(counts, "seq", "left").select(ident, "seq", F.coalesce("n", F.lit(0).cast("long")).alias("n")).where(F.col("n") <= limit)


def code_uniqueness(df: DataFrame, code: str) -> DataFrame:
    """One row: rows, distinct codes and their ratio."""
    by_code = df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return by_code.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_codes")).withColumn(
        "uniqueness", F.when(F.col("total") > 0, F.col("unique_codes") / F.col("total"))
    )


