"""Sequence, annotation and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guideloom.functions.scoring import score_text_udf
from guideloom.operators.annotation import GENE, PARTS, TRANSCRIPTS
from guideloom.sources.annotation_lines import loaded, parse_annotation_lines

# Column names of the result files.
RAW_COLUMNS = ["QueryName", "QuerySeq", "TargetName", "TargetSeq", "Distance", "SearchType", "GenomicFrequency"]
SCORED_COLUMNS = [*RAW_COLUMNS, "Score", "Details"]
RAW_FIELDS = ["query_name", "query_seq", "target_name", "target_seq", "distance", "search_type", "genomic_frequency"]


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(at, head, body): records that begin with ``mark`` at a line's start; gzip is read as well."""
    chunks = spark.read.option("lineSep", f"\n{mark}").text(path).withColumn("at", F.monotonically_increasing_id())
    text = F.regexp_replace("value", f"^\\{mark}|\\r", "")
    first_line = F.substring_index(text, "\n", 1)
    return chunks.select("at", first_line.alias("head"), F.substring(text, F.length(first_line) + 2, 2**31 - 1).alias("body"))


def _named(records: DataFrame, sequence: Column) -> DataFrame:
    name = F.regexp_extract("head", r"^(\S*)", 1)
    return records.select(F.col("at").alias("chrom_idx"), name.alias("chrom_name"), F.upper(F.regexp_replace(sequence, r"\s", "")).alias("chrom_sequence")).where("chrom_name <> '' or chrom_sequence <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_idx, chrom_name, chrom_sequence): names up to the first blank; sequences joined, in upper case.

    chrom_idx rises with the place in the file. A missing file raises Spark's error.
    """
    return _named(_records(spark, path, ">"), F.col("body"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """The same of FASTQ with one quality line per record; a quality line that begins with @ is told apart by its missing + line."""
    records = _records(spark, path, "@").where(F.col("body").rlike(r"(?m)^\+"))
    return _named(records, F.regexp_extract("body", r"(?s)^(.*?)(?:^|\n)\+", 1))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of GFF3 or GTF files, rejects among them; see parse_annotation_lines (not strict)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"), F.input_file_name().alias("file_name"))
    return parse_annotation_lines(lines, strict=False)


def attribute(attributes: Column, name: str) -> Column:
    """Value of the first attribute with exactly this name, written `name=value` or `name "value"`; blanks and quotes around it stripped, null if missing."""
    masked = F.replace(attributes, F.lit('\\"'), F.lit("\\\u0001"))
    parts = F.regexp_extract_all(masked, F.lit(r'(?:[^;"]|"[^"]*")+'), F.lit(0))
    own = F.filter(parts, lambda p: p.rlike(rf"^\s*{name}(?:[=\s]|$)"))
    value = F.regexp_replace(F.try_element_at(own, F.lit(1)), rf"^\s*{name}[=\s]?", "")
    return F.replace(F.regexp_replace(value, r'^[\s"]+|[\s"]+$', ""), F.lit("\u0001"), F.lit('"'))


def annotation_features(parsed: DataFrame) -> DataFrame:
    """Features (seqid, loaded_at, row_id, feature, start_1based, end_1based, strand, phase, id, parent, gene_id) of the valid parsed lines.

    A gene's id is its ID, gene_id, gene_name or Name, a transcript's its ID or transcript_id; the
    parent of an exon or CDS part is its Parent or transcript_id, and each part is a feature of its
    own, whatever its ID. Lines without these, and other features, are left out. gene_id is null
    where a part has none of its own; transcript_parts then takes it from the transcript.
    """

    def first(*names: str) -> Column:
        return F.coalesce(*(F.nullif(attribute(F.col("attributes"), n), F.lit("")) for n in names))

    feature = F.lower("feature")
    gene, transcript, part = feature == GENE, feature.isin(*TRANSCRIPTS), feature.isin(*PARTS)
    rows = loaded(parsed).where(gene | transcript | part).select(
        "seqid", F.lit(0).alias("loaded_at"), F.col("line_no").alias("row_id"), feature.alias("feature"), "start_1based", "end_1based", "strand", "phase",
        F.when(gene, first("ID", "gene_id", "gene_name", "Name")).when(transcript, first("ID", "transcript_id")).otherwise(F.col("line_no").cast("string")).alias("id"),
        F.when(transcript, first("Parent", "gene_id")).when(part, first("Parent", "transcript_id")).alias("parent"),
        F.when(part, first("gene_id")).alias("gene_id"),
    )
    return rows.where(F.col("id").isNotNull() & (~F.col("feature").isin(*PARTS) | F.col("parent").isNotNull()))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """A scored result file as text columns; lines with fewer than nine columns are left out."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"))
    cells = F.split("line", "\t")
    rows = lines.where((F.size(cells) >= len(SCORED_COLUMNS)) & ~F.col("line").startswith("QueryName\t"))
    return rows.select(*(cells[i].alias(c) for i, c in enumerate(SCORED_COLUMNS)))


def scored_rows(text: DataFrame) -> DataFrame:
    """What read_scored gives as scored hits: named and typed like those of a search; what is no number is null."""
    kinds = {"distance": "int", "genomic_frequency": "int", "score": "double"}
    names = dict(zip([*RAW_FIELDS, "score", "details"], SCORED_COLUMNS, strict=True))
    return text.select(*(F.col(c).try_cast(kinds[n]).alias(n) if n in kinds else F.col(c).alias(n) for n, c in names.items()))


def _tab_line(columns: list[Column]) -> Column:
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).alias("value")


def raw_lines(hits: DataFrame) -> DataFrame:
    """(value): lines of the raw result file, without the header."""
    return hits.select(_tab_line([F.col(c) for c in RAW_FIELDS]))


def scored_lines(scored: DataFrame) -> DataFrame:
    """(value): lines of the scored result file, without the header; scores with twelve digits."""
    return scored.select(_tab_line([*(F.col(c) for c in RAW_FIELDS), score_text_udf("score"), F.col("details")]))


def hit_lines(hits: DataFrame) -> DataFrame:
    """(value): the older form with five columns."""
    return hits.select(_tab_line([F.col(c) for c in RAW_FIELDS[:5]]))


def write_lines(lines: DataFrame, path: str, columns: list[str]) -> None:
    """Text files in ``path``/data, and the header as ``path``/header; concatenated they are the result file."""
    spark = lines.sparkSession
    spark.range(1).select(F.lit("\t".join(columns)).alias("value")).write.mode("overwrite").text(f"{path}/header")
    lines.write.mode("overwrite").text(f"{path}/data")
