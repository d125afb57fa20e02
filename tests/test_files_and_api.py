import gzip
import json
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from guideloom.api import OffTargetSession, report_file, search_files
from guideloom.operators.annotation import annotation_sequences
from guideloom.operators.extraction import genome
from guideloom.operators.report import Progress, report_lines
from guideloom.params import SearchParams
from guideloom.sources.files import RAW_COLUMNS, SCORED_COLUMNS, annotation_features, attribute, raw_lines, read_annotation, read_fasta, read_fastq, read_scored, scored_lines, write_lines
from tests.conftest import rows

FASTA = ">a first > one\r\nacgt\r\nNN\r\n>b\nAC\n\nGT\n>empty\n>c:1 x\nTTTT"
T = "ACGTACGTTAGGCCATTGCAACGGTTAACCGGATATCGCGNNAGGTTT"


def test_fasta_plain_and_gzip(spark, tmp_path):
    want = [("a", "ACGTNN"), ("b", "ACGT"), ("c:1", "TTTT"), ("empty", "")]
    (tmp_path / "x.fasta").write_bytes(FASTA.encode())
    with gzip.open(tmp_path / "y.fasta.gz", "wb") as f:
        f.write(FASTA.encode())
    for name in ("x.fasta", "y.fasta.gz"):
        assert rows(read_fasta(spark, str(tmp_path / name)).select("chrom_name", "chrom_sequence")) == want


def test_fastq_quality_may_begin_with_at(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n")
    assert rows(read_fastq(spark, str(tmp_path / "x.fq")).select("chrom_name", "chrom_sequence")) == [("r1", "ACGT"), ("r2", "GG")]


def test_attributes(spark):
    text = 'Alias=x; ID "g 1"; Note="a;ID=no"; Say=\\"hi\\"; Empty=; ID=second'
    df = spark.createDataFrame([(text,)], "a string")
    got = df.select(*(attribute(F.col("a"), n).alias(n) for n in ("ID", "Note", "Say", "Empty", "Gone", "lias"))).first()
    assert tuple(got) == ("g 1", "a;ID=no", '\\"hi\\"', "", None, None)


def test_annotation_file(spark, tmp_path):
    (tmp_path / "x.gff").write_text("##gff\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g\nbad\n")
    got = read_annotation(spark, str(tmp_path / "x.gff"))
    assert rows(got.select("reason", "seqid", "end_1based")) == [("columns", None, None), (None, "c", 9)]


def scored(spark):
    data = [("q<1>", "ACGT", "t&2", "ACGT", 0, "Exact", 1, 1.0, "[]"), ("q<1>", "ACGT", "t3", "ACGA", 1, "Mismatch", 1, 0.0724903564815, '[["sub",-1,"T","A"]]'), ("p", "A", "t", None, 1, "Indel", 2, 1e-7, "[]")]
    return spark.createDataFrame(data, "query_name string, query_seq string, target_name string, target_seq string, distance int, search_type string, genomic_frequency int, score double, details string")


def test_result_files(spark, tmp_path):
    df = scored(spark)
    assert rows(raw_lines(df))[0] == ("p\tA\tt\t\t1\tIndel\t2",)
    write_lines(scored_lines(df), str(tmp_path / "out"), SCORED_COLUMNS)
    back = read_scored(spark, str(tmp_path / "out/*"))
    assert rows(back.select("QueryName", "Score", "Details")) == [("p", "1e-07", "[]"), ("q<1>", "0.0724903564815", '[["sub",-1,"T","A"]]'), ("q<1>", "1.0", "[]")]
    assert RAW_COLUMNS == SCORED_COLUMNS[:7]


def test_report_of_a_result_file(spark, tmp_path):
    df = scored(spark)
    write_lines(scored_lines(df), str(tmp_path / "out"), SCORED_COLUMNS)
    report_file(spark, str(tmp_path / "out/*"), str(tmp_path / "page"))
    page = sorted(r.value for r in spark.read.text(str(tmp_path / "page")).collect())
    assert page == sorted(r.value for r in report_lines(df).collect())


def test_cancel_stops_a_run(spark):
    slow = F.udf(lambda s: time.sleep(60) or s)
    rows_of = spark.createDataFrame([(0, "c", "TTCTCGAGCGTCGCGTGGAGTCCGG")], "chrom_idx long, chrom_name string, chrom_sequence string")
    session, ended = OffTargetSession(spark), []
    session.cancel()  # nothing runs yet

    def run():
        try:
            ended.append(session.run(rows_of, rows_of.withColumn("chrom_sequence", slow("chrom_sequence"))))
        except Exception as error:
            ended.append(str(error))

    thread = threading.Thread(target=run)
    began = time.monotonic()
    thread.start()
    while thread.is_alive() and time.monotonic() - began < 50:
        time.sleep(1)
        session.cancel()
    thread.join(1)
    assert len(ended) == 1 and "cancel" in ended[0].lower() and time.monotonic() - began < 50


def test_report_is_in_order_and_escaped(spark):
    page = [r.value for r in report_lines(scored(spark)).collect()]
    text = "\n".join(page)
    assert page[0].startswith("<!doctype") and page[-1] == "</table>" and "q<1>" not in text and "q&lt;1&gt;" in text
    assert [x for x in page if "<a href" in x][0].count(">p<") == 1 and text.index("t&amp;2") > text.index("GenomicFrequency" if "GenomicFrequency" in text else "genomic_frequency")


def test_progress():
    said = []
    with Progress(said.append, as_json=True).step("a", "A"):
        pass
    with pytest.raises(KeyError), Progress(said.append, as_json=True).step("b", "B"):
        raise KeyError("x")
    assert [json.loads(x)["event"] for x in said] == ["step_start", "step_done", "step_start", "error"]


def test_search_files(spark, tmp_path):
    (tmp_path / "q.fa").write_text(">q\nACGTACGT\n")
    (tmp_path / "t.fa").write_text(">t1\nACGTACGA\n>t2\nCGTACGTA\n>long\nACGTACGTA\n")
    paths = [str(tmp_path / x) for x in ("q.fa", "t.fa")]
    assert rows(search_files(spark, *paths, 8, 1)) == [("q", "ACGTACGT", "t1", "ACGTACGA", 1, "Mismatch")]
    assert rows(search_files(spark, *paths, 8, 1, indels=True)) == [("q", "ACGTACGT", "t1", "ACGTACGA", 1, "Indel"), ("q", "ACGTACGT", "t2", "CGTACGTA", 1, "Indel")]
    (tmp_path / "q2.fa").write_text(">q\nACGTACGT\n>r\nACGTACGTA\n")
    paths = [str(tmp_path / x) for x in ("q2.fa", "t.fa")]
    assert rows(search_files(spark, *paths, limit=1)) == [("q", "ACGTACGT", "t1", "ACGTACGA", 1, "Mismatch"), ("r", "ACGTACGTA", "long", "ACGTACGTA", 0, "Exact")]
    (tmp_path / "q2.fa").write_text(">q\n" + "ACGT" * 9)
    with pytest.raises(ValueError):
        search_files(spark, *paths, limit=1)


def features(spark, strand):
    data = [(1, "gene", 3, 30, strand, None, "gene:G1", None), (2, "mRNA", 3, 30, strand, None, "gene:G1-mRNA1", "gene:G1"), (3, "exon", 3, 10, strand, None, "e1", "gene:G1-mRNA1"), (4, "exon", 15, 22, strand, None, "e2", " gene:G1-mRNA1 "), (5, "CDS", 5, 10, strand, 0, "c1", "gene:G1-mRNA1"), (6, "CDS", 15, 20, strand, 2, "c2", "gene:G1-mRNA1"), (7, "gene", 40, 400, "+", None, "gene:out", None), (8, "exon", 1, 4, "+", None, "e3", "gene:out-mRNA1"), (9, "exon", 44, 99, "+", None, "e4", "gene:out-mRNA1")]
    return spark.createDataFrame([("T", 0, *x) for x in data], "seqid string, loaded_at int, row_id long, feature string, start_1based long, end_1based long, strand string, phase int, id string, parent string")


def test_parts_with_a_shared_id_or_none_all_count(spark):
    data = [(1, "gene", 3, 30, "+", None, "ENSG1", None), (2, "mRNA", 3, 30, "+", None, "ENST1", "ENSG1"), (3, "exon", 3, 10, "+", None, None, "ENST1"), (4, "exon", 15, 22, "+", None, None, "ENST1"), (5, "CDS", 5, 10, "+", 0, "cds1", "ENST1"), (6, "CDS", 15, 20, "+", 1, "cds1", "ENST1")]
    schema = "seqid string, loaded_at int, row_id long, feature string, start_1based long, end_1based long, strand string, phase int, id string, parent string"
    df = spark.createDataFrame([("T", 0, *x) for x in data] + [("T", 1, 9, "cds", 15, 20, "+", 2, "cds1", " ENST1 ")], schema)  # the last line delivered again
    session = OffTargetSession(spark)
    contigs = spark.createDataFrame([(0, "T", T)], "chrom_idx long, chrom_name string, chrom_sequence string")
    for kind, want in (("mrna", "GTACGTTAATTGCAAC"), ("cds", "ACGTTATGCA")):
        assert rows(session.gene_queries(df, contigs, "ENSG1", kind).select("chrom_name", "chrom_sequence")) == [("ENST1", want)]


@pytest.mark.parametrize("strand,want", [("+", ("GTACGTTAGGCCATTGCAACGGTTAACC", "GTACGTTAATTGCAAC", "ACGTTATGCA")), ("-", ("GGTTAACCGTTGCAATGGCCTAACGTAC", "GTTGCAATTAACGTAC", "TGCATAACGT"))])
def test_annotation_sequences(spark, strand, want):
    contigs = genome(spark.createDataFrame([(0, "T", T)], "chrom_idx long, chrom_name string, chrom_sequence string"))
    for kind, name, seq in zip(("gene", "mrna", "cds"), ("gene:G1", "gene:G1-mRNA1", "gene:G1-mRNA1"), want):
        assert rows(annotation_sequences(features(spark, strand), contigs, kind)) == [(name, seq)]


def test_session(spark, tmp_path):
    query = spark.createDataFrame([(0, "QUERY", "TTCTCGAGCGTCGCGTGGAGTCCGG")], "chrom_idx long, chrom_name string, chrom_sequence string")
    genome_rows = spark.createDataFrame([(0, "c1", "GATTACATTCTCGAGCGTCGCGTGGAGTCCGGACGTACGTCTCGAGCGTCATGTGGAGTCAGGT"), (1, "c2", "ACGTATTCTCGAGCGTCCGTGGAGTCTGGTTTT")], query.schema)
    session = OffTargetSession(spark, SearchParams(), Progress(lambda _: None))
    got = {(r.target_name, r.search_type) for r in session.run(query, genome_rows, html=str(tmp_path / "page")).collect()}
    assert got == {("c1:10-29:+", "Exact"), ("c1:41-60:+", "Mismatch"), ("c2:7-26:+", "Indel")}
    raw = session.run(query, genome_rows, raw=True).collect()
    assert {r.target_name for r in raw} >= {x for x, _ in got}
    assert session.summary(session.scored(query, genome_rows)).first().total == 3
    with pytest.raises(ValueError):
        session.run(query, genome_rows, raw=True, html="x")
    one = session.gene_queries(features(spark, "+"), spark.createDataFrame([(0, "T", T)], query.schema), "gene:G1", "mrna")
    assert one.first().chrom_sequence == "GTACGTTAATTGCAAC"
    with pytest.raises(ValueError):
        session.gene_queries(features(spark, "+"), genome_rows, "gene:none", "gene")


def test_entry_without_the_text_subpackage():
    code = "import sys; sys.modules['guideloom.llm'] = None; import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[0] == 'p' and n[1].isdigit()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests", 1)[0]).stdout
    assert "p1_found" in out and "p4_found" not in out


GTF = """#!gtf
T\ts\tgene\t3\t30\t.\t-\t.\tgene_id "G1"; gene_name "one";
T\ts\ttranscript\t3\t30\t.\t-\t.\tgene_id "G1"; transcript_id "G1";
T\ts\texon\t3\t10\t.\t-\t.\tgene_id "G1"; transcript_id "G1";
T\ts\texon\t15\t22\t.\t-\t.\tgene_id "G1"; transcript_id "G1";
T\ts\tCDS\t5\t10\t.\t-\t0\tgene_id "G1"; transcript_id "G1";
T\ts\tCDS\t15\t20\t.\t-\t.\tgene_id "G1"; transcript_id "G1";
T\ts\texon\t1\t4\t.\t+\t.\tgene_id "G10"; transcript_id "G1";
T\ts\tgene\t1\t4\t.\t+\t.\tgene_name "named";
T\ts\tgene\t1\t4\t.\t+\t.\tnote "no name";
T\ts\texon\t1\t4\t.\t+\t.\tgene_id "G1";
"""
GFF = """##gff-version 3
T\ts\tgene\t3\t30\t.\t+\t.\tID=gene:G2
T\ts\tmRNA\t3\t30\t.\t+\t.\tID=transcript:A;Parent=gene:G2
T\ts\texon\t3\t10\t.\t+\t.\tParent=transcript:A
T\ts\texon\t15\t22\t.\t+\t.\tParent=transcript:A
T\ts\tCDS\t5\t10\t.\t+\t0\tID=cds;Parent=transcript:A
T\ts\tCDS\t15\t20\t.\t+\t2\tID=cds;Parent=transcript:A
T\ts\texon\t1\t4\t.\t+\t.\tParent=G3-mRNA1
"""


def test_search_from_a_gene_of_a_file(spark, tmp_path):
    (tmp_path / "x.gtf").write_text(GTF)
    (tmp_path / "x.gff").write_text(GFF)
    contigs = spark.createDataFrame([(0, "T", T)], "chrom_idx long, chrom_name string, chrom_sequence string")
    session = OffTargetSession(spark)

    def of(name, gene, kind):
        parsed = read_annotation(spark, str(tmp_path / name))
        assert not parsed.where("reason is not null").count()
        return rows(session.gene_queries(annotation_features(parsed), contigs, gene, kind).select("chrom_name", "chrom_sequence"))

    assert of("x.gtf", "G1", "gene") == [("G1", "GGTTAACCGTTGCAATGGCCTAACGTAC")]
    assert of("x.gtf", "G1", "mrna") == [("G1", "GTTGCAATTAACGTAC")]
    assert of("x.gtf", "G1", "cds") == [("G1", "TGCAATTAACGT")]
    assert of("x.gtf", "G10", "mrna") == [("G1", "ACGT")] and of("x.gtf", "named", "gene") == [("named", "ACGT")]
    assert of("x.gff", "gene:G2", "mrna") == [("transcript:A", "GTACGTTAATTGCAAC")]
    assert of("x.gff", "gene:G2", "cds") == [("transcript:A", "ACGTTATGCA")] and of("x.gff", "G3", "mrna") == [("G3-mRNA1", "ACGT")]
    with pytest.raises(ValueError):
        of("x.gff", "G2", "mrna")


def test_run_tells_of_all_its_stages(spark, tmp_path):
    query = spark.createDataFrame([(0, "QUERY", "TTCTCGAGCGTCGCGTGGAGTCCGG")], "chrom_idx long, chrom_name string, chrom_sequence string")
    contigs = spark.createDataFrame([(0, "c1", "GATTACATTCTCGAGCGTCGCGTGGAGTCCGGACG")], query.schema)
    said = []
    session = OffTargetSession(spark, SearchParams(), Progress(said.append, as_json=True))
    told = session.run(query, contigs, html=str(tmp_path / "page"))
    events = [json.loads(x) for x in said]
    steps = [(e, s) for s in ("extract", "search", "score", "report") for e in ("step_start", "step_done", "progress")]
    assert [(e["event"], e.get("id")) for e in events] == [("genome", None), *steps, ("complete", None)]
    assert events[0]["chromosomes"] == 1 and events[-2]["percent"] == 100
    assert rows(told) == rows(OffTargetSession(spark).run(query, contigs)) != []
    said.clear()
    session.run(query, contigs, raw=True)
    assert [json.loads(x)["event"] for x in said] == ["genome", *["step_start", "step_done", "progress"] * 2, "complete"]
