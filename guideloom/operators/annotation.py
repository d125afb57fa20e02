"""Sequences of genes and transcripts from annotation features and the genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guideloom.functions.sequences import reverse_complement
from guideloom.operators.extraction import slices

# Names of features, and the mark that a transcript's number follows.
GENE, TRANSCRIPTS, PARTS = "gene", ("mrna", "transcript"), ("exon", "cds")
TRANSCRIPT_MARK = "-mRNA"
SEQ_TYPES = ("gene", "mrna", "cds")


def latest_features(features: DataFrame) -> DataFrame:
    """The last delivery of each feature by loaded_at and row_id; feature in lower case, parent without blanks around.

    A gene, a transcript or another feature is known by its id, and has one. A part (exon or CDS) is
    known by all of id, parent, kind and place: the parts of a CDS may share an id, and parts
    without an id count as well. Features of a file have a column gene_id: there a gene, a
    transcript and a part may share an id, and a part is also known by its gene.
    """
    kept = ["seqid", "start_1based", "end_1based", "strand", "phase"]
    kind, parent = F.lower("feature"), F.nullif(F.btrim("parent"), F.lit(""))
    is_part = F.coalesce(kind.isin(*PARTS), F.lit(False))
    keys = [F.col("id"), is_part.alias("is_part"), *(F.when(is_part, c).alias(f"part{i}") for i, c in enumerate((parent, kind, F.col("seqid"), F.col("start_1based"), F.col("end_1based"))))]
    if "gene_id" in features.columns:
        kept.append("gene_id")
        keys += [F.when(kind == GENE, 0).when(kind.isin(*TRANSCRIPTS), 1).otherwise(2).alias("level"), F.when(is_part, F.col("gene_id")).alias("part_gene")]
    row = F.struct("loaded_at", "row_id", kind.alias("feature"), parent.alias("parent"), *kept)
    best = features.where(F.col("id").isNotNull() | is_part).groupBy(*keys).agg(F.max(row).alias("r"))
    return best.select("id", "r.feature", "r.parent", *(f"r.{k}" for k in kept))


def gene_of(ident):
    """A gene's id from a transcript's: what stands before the transcript mark."""
    return F.regexp_replace(ident, f"{TRANSCRIPT_MARK}.*$", "")


def transcript_parts(features: DataFrame) -> DataFrame:
    """(transcript_id, gene_id, strand, kind, id, seqid, start_1based, end_1based, phase): exons and CDS parts of the transcripts.

    A part with a gene_id of its own belongs to that gene, any other to the gene of its transcript's
    row or, without one, of the transcript's id. A transcript lies on the reverse strand if its own
    row or one of its parts in the same gene says so.
    """
    rows = latest_features(features)
    parts = rows.where(F.col("feature").isin(*PARTS) & F.col("parent").isNotNull())
    own = rows.where(F.col("feature").isin(*TRANSCRIPTS)).select(F.col("id").alias("transcript_id"), gene_of(F.coalesce("parent", "id")).alias("up"), "strand")
    gene = F.coalesce("up", gene_of(F.col("parent")))
    if "gene_id" in parts.columns:
        gene = F.coalesce("gene_id", gene)
    parts = parts.join(own.select(F.col("transcript_id").alias("parent"), "up"), "parent", "left").select(
        F.col("parent").alias("transcript_id"), gene.alias("gene_id"), "strand", F.col("feature").alias("kind"), "id", "seqid", "start_1based", "end_1based", "phase"
    )
    of = ["transcript_id", "gene_id"]
    says = parts.select(*of, "strand").unionByName(own.select("transcript_id", F.col("up").alias("gene_id"), "strand"))
    strand = says.groupBy(*of).agg(F.when(F.count_if(F.col("strand") == "-") > 0, "-").otherwise("+").alias("t_strand"))
    return parts.join(strand, of).select(*of, F.col("t_strand").alias("strand"), "kind", "id", "seqid", "start_1based", "end_1based", "phase")


def annotation_sequences(features: DataFrame, contigs: DataFrame, seq_type: str, gene: str | None = None) -> DataFrame:
    """(name, seq) of every gene (`gene`) or transcript (`mrna`, `cds`) whose parts all lie in the genome; with ``gene`` of this one only.

    Parts are put together by start; each part of a CDS first loses ``phase`` bases at its left
    end in the genome; reverse strands are complemented at the end. Empty results give no row.
    """
    if seq_type not in SEQ_TYPES:
        raise ValueError(f"seq_type must be one of {SEQ_TYPES}")
    if seq_type == "gene":
        rows = latest_features(features).where(F.col("feature") == GENE)
        rows = rows.select(F.col("id").alias("name"), F.col("id").alias("gene_id"), "id", F.when(F.col("strand") == "-", "-").otherwise("+").alias("strand"), "seqid", "start_1based", "end_1based", F.lit(0).alias("trim"))
    else:
        kind = "exon" if seq_type == "mrna" else "cds"
        trim = F.coalesce("phase", F.lit(0)) if seq_type == "cds" else F.lit(0)
        rows = transcript_parts(features).where(F.col("kind") == kind)
        rows = rows.select(F.col("transcript_id").alias("name"), "gene_id", "id", "strand", "seqid", "start_1based", "end_1based", trim.alias("trim"))
    if gene is not None:
        rows = rows.where(F.col("gene_id") == gene)
    wanted = rows.select(
        F.struct("name", "gene_id", "id", "seqid", "start_1based", "end_1based", "strand", "trim").alias("item"), F.col("seqid").alias("chrom"), (F.col("start_1based") - 1).alias("lo"), F.col("end_1based").alias("hi"), F.col("end_1based").alias("need")
    )
    parts = slices(wanted, contigs).select("item.*", F.expr("substring(seq, item.trim + 1)").alias("seq"))
    whole = parts.groupBy("name", "gene_id").agg(F.sort_array(F.collect_list(F.struct("start_1based", "end_1based", "id", "seq"))).alias("parts"), F.max("strand").alias("strand"))
    needed = rows.groupBy("name", "gene_id").agg(F.count(F.lit(1)).alias("n"))
    joined = whole.join(needed, ["name", "gene_id"]).where(F.size("parts") == F.col("n")).select("name", "strand", F.array_join(F.col("parts.seq"), "").alias("seq"))
    return joined.where("seq <> ''").select("name", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
