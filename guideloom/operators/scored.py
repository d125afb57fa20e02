"""Scores of hits: padded targets from the genome, best alignment, relabelled hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guideloom.functions.scoring import best_alignment_udf, details_json
from guideloom.functions.sequences import bound, parsed_name, reverse_complement
from guideloom.operators.extraction import slices
from guideloom.params import SearchParams
from guideloom.plans.scratch import Scratch


def padded_targets(names: DataFrame, contigs: DataFrame, params: SearchParams) -> DataFrame:
    """``names`` (target_name) -> (target_name, padded): the site with max_indel more bases on its far side from the PAM, oriented.

    Padding ends at the contig's end. Names that cannot be read, unknown contigs and sites that
    leave their contig give no row.
    """
    sites = names.select("target_name").where("target_name is not null").distinct().select("target_name", bound(*parsed_name(F.col("target_name"))))
    lo, hi = F.col("start_1based") - 1, F.col("end_1based")
    left_is_far = ~F.col("is_reverse") if params.upstream else F.col("is_reverse")
    wanted = sites.where("start_1based >= 1 and start_1based <= end_1based").select(
        F.struct("target_name", "is_reverse").alias("item"),
        "chrom",
        F.when(left_is_far, F.greatest(lo - params.max_indel, F.lit(0))).otherwise(lo).alias("lo"),
        F.when(left_is_far, hi).otherwise(hi + params.max_indel).alias("hi"),
        hi.alias("need"),
    )
    found = slices(wanted, contigs)
    seq = F.col("seq")
    return found.select(F.col("item.target_name").alias("target_name"), F.when(F.col("item.is_reverse"), reverse_complement(seq)).otherwise(seq).alias("padded"))


def scored_hits(hits: DataFrame, contigs: DataFrame, params: SearchParams) -> DataFrame:
    """The scored result: raw columns, with distance and search_type by the best alignment, and score and details.

    Alignments are computed once for each distinct pair of query and padded target. Hits without
    a padded target or an alignment are left out.
    """
    padded = padded_targets(hits, contigs, params).withColumnRenamed("target_name", "p_name")
    rows = hits.where("query_seq is not null").withColumn("query_seq", F.upper("query_seq")).join(padded, F.col("target_name") == F.col("p_name")).drop("p_name")
    rows = Scratch(hits.sparkSession, "scored").written(rows)  # read for the pairs and for the result
    pairs = rows.select(F.col("query_seq").alias("q"), F.col("padded").alias("t")).distinct()
    best = pairs.select("q", "t", F.inline(F.array(best_alignment_udf(params.max_indel, params.max_mismatch, params.upstream)("q", "t")))).where("score is not null")
    both = rows.join(best, (F.col("query_seq") == F.col("q")) & (F.col("padded") == F.col("t")))
    events = F.col("details")
    kind = F.when(F.size(events) == 0, "Exact").when(F.exists(events, lambda e: e["op"] != "sub"), "Indel").otherwise("Mismatch")
    return both.select(
        "query_name", "query_seq", "target_name", "target_seq", F.size(events).alias("distance"), kind.alias("search_type"), "genomic_frequency", "score", details_json(events).alias("details")
    )
