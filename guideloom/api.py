"""The search as a user starts it: modes, parameters, results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guideloom.operators.annotation import annotation_sequences
from guideloom.operators.extraction import extract_sites, genome
from guideloom.operators.hits import ordered_summary, query_summary
from guideloom.operators.report import Progress, write_report
from guideloom.operators.scored import scored_hits
from guideloom.operators.search import indel_hits, mismatch_hits, raw_search
from guideloom.params import LONGEST_SPACER, SearchParams
from guideloom.plans.scratch import Scratch
from guideloom.sources.files import read_fasta, read_scored, scored_rows


def search_files(spark: SparkSession, queries: str, targets: str, length: int | None = None, limit: int = 4, indels: bool = False) -> DataFrame:
    """Hits between the sequences of two FASTA files, taken as sites: by mismatches, or by indels.

    Sequences of one length are compared with each other: of ``length`` or, without it, of every
    length that the queries have. Then none may be longer than LONGEST_SPACER, and for indels none
    as short as twice the limit; others would have no hits without a word and raise an error.
    """
    q, t = (read_fasta(spark, path).select(F.col("chrom_name").alias("name"), F.col("chrom_sequence").alias("seq")) for path in (queries, targets))
    hits_of = indel_hits if indels else mismatch_hits
    if length is not None:
        return hits_of(q, t, length, limit)
    least = 2 * limit + 1 if indels else 1
    wrong = q.where(~F.length("seq").between(least, LONGEST_SPACER)).limit(1).count()
    if wrong:
        raise ValueError(f"query sequences must have {least}..{LONGEST_SPACER} bases")
    found = [r[0] for r in q.select(F.length("seq")).distinct().collect()]  # at most LONGEST_SPACER numbers
    parts = [hits_of(q, t, n, limit) for n in sorted(found)] or [hits_of(q, t, least, limit)]
    return reduce(DataFrame.unionByName, parts)


def report_file(spark: SparkSession, scored: str, html: str) -> None:
    """The report of a scored result file, without a search; ``html`` is a folder of text files, see write_report."""
    write_report(scored_rows(read_scored(spark, scored)), html)


@dataclass
class OffTargetSession:
    """Searches with one set of parameters. The tool's cut modes are the same plans: contigs are always tiled."""

    spark: SparkSession
    params: SearchParams = SearchParams()
    progress: Progress | None = None
    tag: str = field(default_factory=lambda: f"search-{uuid.uuid4().hex[:8]}")

    def query_sites(self, queries: DataFrame) -> DataFrame:
        """Sites of query sequences (chrom_idx, chrom_name, chrom_sequence), beside the primary PAM only."""
        return extract_sites(genome(queries), self.params, both_pams=False)

    def target_sites(self, contigs: DataFrame) -> DataFrame:
        """Sites of the genome, beside both PAMs."""
        return extract_sites(genome(contigs), self.params, both_pams=True)

    def gene_queries(self, features: DataFrame, contigs: DataFrame, gene: str, seq_type: str) -> DataFrame:
        """Query sequences of one gene (its transcripts for `mrna` and `cds`); an error if there are none.

        ``features`` are rows like those of annotation_features, which makes them from a file.
        """
        own = annotation_sequences(features, genome(contigs), seq_type, gene)
        rows = own.select(F.xxhash64("name").alias("chrom_idx"), F.col("name").alias("chrom_name"), F.col("seq").alias("chrom_sequence"))
        if not rows.limit(1).count():
            raise ValueError(f"nothing extracted for {gene}")
        return rows

    def raw(self, queries: DataFrame, contigs: DataFrame) -> DataFrame:
        """Raw hits of query sequences in a genome."""
        return self._hits(*self._sites(queries, contigs))

    def _sites(self, queries: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
        scratch = Scratch(self.spark, "sites")  # both are read several times
        return scratch.written(self.query_sites(queries).select("name", "seq")), scratch.written(self.target_sites(contigs).select("name", "seq"))

    def _hits(self, query_sites: DataFrame, target_sites: DataFrame) -> DataFrame:
        p = self.params
        return raw_search(query_sites, target_sites, p.spacer_length, p.max_mismatch, p.max_indel)

    def scored(self, queries: DataFrame, contigs: DataFrame) -> DataFrame:
        """Scored hits of query sequences in a genome."""
        return scored_hits(self.raw(queries, contigs), genome(contigs), self.params)

    def run(self, queries: DataFrame, contigs: DataFrame, raw: bool = False, html: str | None = None) -> DataFrame:
        """Raw or scored hits and, for scored ones, the report. All work is done here: the result is a written table.

        Its jobs run under the session's tag, so that cancel() in another thread stops them; then
        this raises Spark's error. With ``progress`` each stage is written before the next begins,
        so that its events say when it ran.
        """
        if raw and html:
            raise ValueError("a report needs scores: choose raw or html")
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            if self.progress:
                return self._told(self.progress, queries, contigs, raw, html)
            hits = Scratch(self.spark, "result").written(self.raw(queries, contigs) if raw else self.scored(queries, contigs))
            if html:
                write_report(hits, html)
            return hits
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def _told(self, progress: Progress, queries: DataFrame, contigs: DataFrame, raw: bool, html: str | None) -> DataFrame:
        """run() stage by stage, with its events."""
        began, done, stages = time.monotonic(), 0, 2 + (not raw) + bool(html)
        scratch = Scratch(self.spark, "stages")

        def stage(ident: str, title: str, work: Callable):
            nonlocal done
            with progress.step(ident, title):
                result = work()
            done += 1
            progress.event("progress", id=ident, done=done, total=stages, unit="stages", percent=done * 100 // stages)
            return result

        n, total, longest = self._sizes(contigs)
        progress.event("genome", chromosomes=n, total_genome_mbp=total, longest_chromosome_mbp=longest)
        sites = stage("extract", "Extract the sites", lambda: self._sites(queries, contigs))
        hits = stage("search", "Search the sites", lambda: scratch.written(self._hits(*sites)))
        if not raw:
            hits = stage("score", "Score the hits", lambda found=hits: scratch.written(scored_hits(found, genome(contigs), self.params)))
        if html:
            stage("report", "Write the report", lambda: write_report(hits, html))
        progress.event("complete", total_seconds=round(time.monotonic() - began, 3), **({"html": html} if html else {}))
        return hits

    def cancel(self) -> None:
        """Stops the jobs of a run() in another thread; does nothing where none runs."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)  # a tag of the session would hold in its own thread only

    def summary(self, scored: DataFrame) -> DataFrame:
        return ordered_summary(query_summary(scored))

    def _sizes(self, contigs: DataFrame) -> tuple[int, float, float]:
        """Number of contigs, and millions of bases of all and of the longest."""
        sizes = genome(contigs).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), F.coalesce(F.max("len"), F.lit(0)).alias("longest")).first()
        return sizes["n"], sizes["total"] / 1e6, sizes["longest"] / 1e6
