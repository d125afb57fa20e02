from pyspark.sql import functions as F

from guideloom.operators.extraction import extract_sites, genome
from guideloom.operators.hits import combine_priority
from guideloom.operators.search import search
from guideloom.params import SearchParams
from guideloom.streaming.contigs import CONTIGS, stream_search, stream_sites
from tests.conftest import rows


def test_stream_equals_batch(spark, tmp_path):
    q = "CTCGAGCGTCGCGTGGAGTC"
    data = [(i, f"c{i}", "GATTACATT" + (q if i % 2 else q[:9] + "A" + q[10:]) + "CGGACGT" * (i + 1)) for i in range(6)]
    params = SearchParams()
    for k in range(3):
        spark.createDataFrame(data[2 * k : 2 * k + 2], CONTIGS).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    queries = spark.createDataFrame([("q", q)], "name string, seq string")
    stream_search(stream_sites(spark, str(tmp_path / "in"), params, 1), queries, params, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    sites = extract_sites(genome(spark.createDataFrame(data, CONTIGS)), params, both_pams=True)
    want = combine_priority(search(queries, sites, 20, params.max_mismatch, params.max_indel))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select(F.countDistinct("batch")).first()[0] == 3
    assert rows(got.drop("batch")) == rows(want) and want.count() >= 6
