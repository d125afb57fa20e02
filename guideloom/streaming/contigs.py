"""Contigs that arrive while a search runs.

Extraction needs no state, so arriving contigs go through the same plan as a batch; hits of each
micro-batch are combined and appended under the batch's number, which makes a repeated batch
replace its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from guideloom.operators.extraction import extract_sites, genome
from guideloom.operators.hits import combine_priority
from guideloom.operators.search import search
from guideloom.params import SearchParams

CONTIGS = T.StructType([T.StructField("chrom_idx", T.LongType()), T.StructField("chrom_name", T.StringType()), T.StructField("chrom_sequence", T.StringType())])


def stream_sites(spark: SparkSession, path: str, params: SearchParams, files_per_trigger: int = 16) -> DataFrame:
    """Streaming DataFrame of the target sites of Parquet files of contigs that arrive in ``path``."""
    contigs = spark.readStream.schema(CONTIGS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return extract_sites(genome(contigs), params, both_pams=True)


def stream_search(sites: DataFrame, queries: DataFrame, params: SearchParams, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Searches each micro-batch of sites with the same queries (name, seq); hits go to ``out``/batch=N."""

    def search_batch(batch: DataFrame, number: int) -> None:
        kept = batch.select("name", "seq").persist()
        try:
            hits = search(queries, kept, params.spacer_length, params.max_mismatch, params.max_indel)
            combine_priority(hits).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            kept.unpersist()

    return sites.writeStream.foreachBatch(search_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
