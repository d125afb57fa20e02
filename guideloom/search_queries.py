"""Queries of the search pipeline over the whole test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guideloom.functions import sequences as S
from guideloom.functions.scoring import event_distance as event_distance_of
from guideloom.functions.scoring import score_text_udf
from guideloom.operators import hits as H
from guideloom.operators.annotation import annotation_sequences, transcript_parts
from guideloom.operators.extraction import extract_sites, genome, sites_by_name, slices
from guideloom.operators.report import report_lines
from guideloom.operators.scored import padded_targets, scored_hits
from guideloom.operators.search import indel_hits, mismatch_hits, raw_search
from guideloom.params import SearchParams
from guideloom.pipeline_queries import RECORD_LINES
from guideloom.sources.annotation_lines import loaded, parse_annotation_lines
from guideloom.sources.files import annotation_features, attribute, hit_lines, raw_lines, scored_lines
from guideloom.tables import Query, table

PARAMS = SearchParams()
QUERY_STEP = 20  # mismatch_join and indel_join take as queries the sites whose id is divisible by it, against all targets
SITE_COLUMNS = ["chrom_idx", "start0", "is_reverse", "seq"]


def _genome(spark: SparkSession, d: str) -> DataFrame:
    return genome(table(spark, d, "contigs"))


def contig_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number of contigs with a sequence, their bases and the longest."""
    return _genome(spark, d).agg(F.count(F.lit(1)).alias("n_contigs"), F.sum("len").alias("total_bases"), F.max("len").alias("longest"))


def sites_single_pam(spark: SparkSession, d: str) -> DataFrame:
    return extract_sites(_genome(spark, d), PARAMS, both_pams=False, dust=False).select(*SITE_COLUMNS)


def sites_dual_pam(spark: SparkSession, d: str) -> DataFrame:
    return extract_sites(_genome(spark, d), PARAMS, both_pams=True, dust=False).select(*SITE_COLUMNS, "name")


def sites_down(spark: SparkSession, d: str) -> DataFrame:
    return extract_sites(_genome(spark, d), SearchParams(direction="down"), both_pams=True, dust=False).select(*SITE_COLUMNS)


def sites_unequal_pams(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of different lengths, one pass each; NGR is literal on + and any base on -."""
    return extract_sites(_genome(spark, d), SearchParams(pam="NGR", alt_pam="NNAG"), both_pams=True, dust=False).select(*SITE_COLUMNS)


def dust_filter(spark: SparkSession, d: str) -> DataFrame:
    return extract_sites(_genome(spark, d), PARAMS, both_pams=True).select(*SITE_COLUMNS)


def _located(spark: SparkSession, d: str) -> DataFrame:
    """(site_id, name, seq): spacer_locations with their oriented sequences; sites that leave their contig have no row."""
    contigs = _genome(spark, d)
    sites = table(spark, d, "spacer_locations")
    wanted = sites.select(
        F.struct("site_id", "is_reverse").alias("item"), "chrom_idx", F.col("start_pos").alias("lo"), (F.col("start_pos") + F.col("spacer_length")).alias("hi"), (F.col("start_pos") + F.col("spacer_length")).alias("need")
    )
    # Sites name contigs by index: the index takes the place of the name.
    by_index = contigs.select("chrom_idx", F.col("chrom_idx").cast("string").alias("chrom"), "seq", "len")
    found = slices(wanted.withColumn("chrom", F.col("chrom_idx").cast("string")), by_index)
    seq = F.when(F.col("item.is_reverse"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return found.select(F.col("item.site_id").alias("site_id"), seq.alias("seq"))


def site_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Oriented sequence and low-complexity score of each spacer location."""
    return _located(spark, d).select("site_id", "seq", S.dust_score(F.col("seq")).alias("dust"))


def site_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of each spacer location: two bits per base, the strict form, and one bit per base and channel."""
    seq = F.col("seq")
    return _located(spark, d).select("site_id", S.code_2bit(seq).alias("code"), S.strict_code(seq).alias("strict"), *(S.channel(seq, b).alias(f"bits_{b.lower()}") for b in S.BASES))


def code_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return H.code_uniqueness(_located(spark, d).select(S.code_2bit(F.col("seq")).alias("code")), "code").select("total", "unique_codes", F.round("uniqueness", 9).alias("uniqueness"))


def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits")
    return hits.select("hit_id", S.reverse_complement(F.upper("target_seq")).alias("rc"))


def hit_regions(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each target's name."""
    return table(spark, d, "search_hits").select("hit_id", *S.parsed_name(F.col("target_name")))


def hit_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of each hit's sequences: different characters, and right-anchored edits up to the limit."""
    hits = table(spark, d, "search_hits").where("query_seq is not null and target_seq is not null").select("hit_id", F.upper("query_seq").alias("q"), F.upper("target_seq").alias("t"))
    first = S.base_number(F.substring("t", 1, 1)).alias("first_base")
    return hits.select("hit_id", first, S.hamming(F.col("q"), F.col("t")).alias("hamming"), S.right_anchored_distance(F.col("q"), F.col("t"), PARAMS.max_indel).alias("right_anchored"))


def event_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edits of each distinct pair of sequences, with a run of indels counted once."""
    pairs = table(spark, d, "search_hits").select("query_seq", "target_seq").where("query_seq is not null and target_seq is not null").distinct()
    return pairs.withColumn("events", event_distance_of(F.col("query_seq"), F.col("target_seq"), PARAMS.max_mismatch))


def _search_sides(spark: SparkSession, d: str, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The spacer locations (those that meet ``where``) as queries and all targets of the genome."""
    located = _located(spark, d) if where is None else _located(spark, d).where(where)
    queries = located.select(F.col("site_id").cast("string").alias("name"), "seq")
    return queries, sites_by_name(_genome(spark, d), PARAMS, both_pams=True)


def _stated_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set of the joins (every twentieth spacer location) and all targets."""
    return _search_sides(spark, d, F.col("site_id") % QUERY_STEP == 0)


def mismatch_join(spark: SparkSession, d: str) -> DataFrame:
    return mismatch_hits(*_stated_sides(spark, d), PARAMS.spacer_length, PARAMS.max_mismatch, by_name=True)


def indel_join(spark: SparkSession, d: str) -> DataFrame:
    return indel_hits(*_stated_sides(spark, d), PARAMS.spacer_length, PARAMS.max_indel, by_name=True)


def genome_search(spark: SparkSession, d: str) -> DataFrame:
    """Raw result of both searches of all spacer locations on the genome: union by priority, and frequency."""
    queries, targets = _search_sides(spark, d)
    return raw_search(queries, targets, PARAMS.spacer_length, PARAMS.max_mismatch, PARAMS.max_indel, by_name=True)


def combine_priority(spark: SparkSession, d: str) -> DataFrame:
    return H.combine_priority(table(spark, d, "search_hits"))


def raw_hits(spark: SparkSession, d: str) -> DataFrame:
    return H.raw_hits(table(spark, d, "search_hits"))


def raw_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the raw result file."""
    return raw_lines(raw_hits(spark, d))


def hit_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the older result file with five columns."""
    return hit_lines(combine_priority(spark, d))


def report_page(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the HTML report of the scored results, in order."""
    scored = table(spark, d, "scored_results").join(table(spark, d, "search_hits").select("hit_id", "query_seq", "target_seq", "genomic_frequency"), "hit_id", "left")
    return report_lines(scored).select("part", "uniq", "query_name", "rank", "value")


def scored_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the scored result file."""
    return scored_lines(scored_genome_hits(spark, d))


def padded(spark: SparkSession, d: str) -> DataFrame:
    """Padded targets of all hits."""
    return padded_targets(table(spark, d, "search_hits"), _genome(spark, d), PARAMS)


def scored_genome_hits(spark: SparkSession, d: str) -> DataFrame:
    """Scores and details of the raw hits."""
    return scored_hits(raw_hits(spark, d), _genome(spark, d), PARAMS)


def score_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_results").where("score is not null and not isnan(score)").select("result_id", score_text_udf("score").alias("score_text"))


def query_summary(spark: SparkSession, d: str) -> DataFrame:
    summary = H.query_summary(table(spark, d, "scored_results"))
    return summary.withColumn("success_rate", F.round("success_rate", 6))


def count_filter(spark: SparkSession, d: str) -> DataFrame:
    return H.count_filter(table(spark, d, "search_hits"), "target_seq").select("hit_id", "target_seq")


def over_represented(spark: SparkSession, d: str) -> DataFrame:
    return H.over_represented(table(spark, d, "search_hits"), "target_seq").select("seq", "n", "record")


def on_target_filter(spark: SparkSession, d: str) -> DataFrame:
    """First hit of each query sequence that is a target sequence at most ten times."""
    hits = table(spark, d, "search_hits")
    return H.on_target_filter(hits, H.sequence_counts(hits, "target_seq"), "hit_id", "query_seq")


def line_attributes(spark: SparkSession, d: str) -> DataFrame:
    """ID, Parent and gene_id of the annotation lines that parse."""
    records = loaded(parse_annotation_lines(table(spark, d, "raw_annotation")))
    return records.select("line_no", *(attribute(F.col("attributes"), n).alias(n.lower()) for n in ("ID", "Parent", "gene_id")))


def transcript_segments(spark: SparkSession, d: str) -> DataFrame:
    """Exons and CDS parts with their transcript and gene."""
    return transcript_parts(table(spark, d, "annotation_features"))


def line_segments(spark: SparkSession, d: str) -> DataFrame:
    """Exons and CDS parts of the annotation lines, as a search from a gene of a file takes them."""
    return transcript_parts(annotation_features(parse_annotation_lines(table(spark, d, "raw_annotation"), strict=False)))


def _annotation(seq_type: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return annotation_sequences(table(spark, d, "annotation_features"), _genome(spark, d), seq_type)

    return query


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        contig_stats, sites_single_pam, sites_dual_pam, sites_down, sites_unequal_pams, dust_filter, site_sequences, site_codes, code_uniqueness, reverse_complement, hit_regions,
        hit_distances, event_distance, mismatch_join, indel_join, genome_search, combine_priority, raw_hits, raw_file, hit_file, scored_file, report_page, padded, scored_genome_hits, score_texts, query_summary,
        count_filter, over_represented, on_target_filter, line_attributes, line_segments, transcript_segments,
    )
} | {f"anno_{t}": _annotation(t) for t in ("gene", "mrna", "cds")}

_G = "g AS (SELECT chrom_idx, chrom_name AS chrom, upper(chrom_sequence) AS seq, length(chrom_sequence) AS len FROM contigs WHERE chrom_sequence <> '')"
_RC = "reverse(translate(regexp_replace({0}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


def _sites_sql(passes: list[tuple[int, str, str]], up: bool = True, dust: bool = False) -> str:
    """CTEs ending in ``s``; a pass is the pattern's length and its regular expressions on both strands."""
    parts = []
    for i, (size, plus, minus) in enumerate(passes):
        left, right = "j - 20", f"j + {size}"
        parts.append(f"""p{i} AS (SELECT chrom_idx, chrom, seq, len, unnest(range(0, len - {size} + 1)) AS j FROM g WHERE len >= {size}),
m{i} AS (
  SELECT chrom_idx, chrom, seq, len, false AS is_reverse, {left if up else right} AS start0 FROM p{i} WHERE regexp_full_match(substr(seq, j + 1, {size}), '{plus}')
  UNION ALL SELECT chrom_idx, chrom, seq, len, true, {right if up else left} FROM p{i} WHERE regexp_full_match(substr(seq, j + 1, {size}), '{minus}'))""")
    union = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(passes)))
    body = ",\n".join(parts) + f""",
u AS ({union}),
o AS (SELECT chrom_idx, chrom, is_reverse, start0, substr(seq, start0 + 1, 20) AS w FROM u WHERE start0 >= 0 AND start0 + 20 <= len),
s AS (SELECT chrom_idx, chrom, is_reverse, start0, CASE WHEN is_reverse THEN {_RC.format("w")} ELSE w END AS seq,
  chrom || ':' || (start0 + 1) || '-' || (start0 + 20) || CASE WHEN is_reverse THEN ':-' ELSE ':+' END AS name FROM o)"""
    if dust:
        body += f""",
sd AS (SELECT * FROM s WHERE {_DUST} <= 12)"""
    return f"WITH {_G},\n{body}\n"


_TRI = "list_filter([substr(seq, i::BIGINT, 3) for i in range(1, length(seq) - 1)], lambda t: regexp_full_match(t, '[ACGT]{3}'))"
_DUST = f"coalesce(list_sum([c * (c - 1) // 2 for c in map_values(list_histogram({_TRI}))]), 0)"
_NGG_NAG = (3, ".[GA]G", "C[CT].")
_SITE = "chrom_idx, start0, is_reverse, seq"
_LOCATED = f"""WITH {_G},
w AS (SELECT l.site_id, l.is_reverse, substr(g.seq, l.start_pos + 1, l.spacer_length) AS w FROM spacer_locations l JOIN g ON l.chrom_idx = g.chrom_idx
  WHERE l.start_pos >= 0 AND l.start_pos + l.spacer_length <= g.len),
loc AS (SELECT site_id, CASE WHEN is_reverse THEN {_RC.format("w")} ELSE w END AS seq FROM w)
"""
_CODE = "list_sum([(strpos('CGT', substr(seq, i::BIGINT, 1)) << (2 * (20 - i)))::BIGINT for i in range(1, 21)])::BIGINT"
_COMBINED = """b AS (
  SELECT *, row_number() OVER (PARTITION BY query_name, target_name
    ORDER BY search_type = 'Indel', distance NULLS FIRST, target_seq NULLS FIRST, query_seq NULLS FIRST, search_type) AS r FROM search_hits),
k AS (SELECT query_name, query_seq, target_name, target_seq, distance, search_type FROM b WHERE r = 1)"""
_RAW = f"{_COMBINED}, f AS (SELECT *, CAST(count(*) OVER (PARTITION BY query_name, target_seq) AS INTEGER) AS genomic_frequency FROM k)"
_LATEST = """x AS (SELECT id, lower(feature) AS feature, nullif(trim(parent), '') AS parent, seqid, start_1based, end_1based, strand, phase, loaded_at, row_id FROM annotation_features),
l AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM x WHERE id IS NOT NULL AND (feature IS NULL OR feature NOT IN ('exon', 'cds'))) WHERE rn = 1
  UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, parent, feature, seqid, start_1based, end_1based ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn
    FROM x WHERE feature IN ('exon', 'cds')) WHERE rn = 1)"""
_PARTS = f"""{_LATEST},
t AS (SELECT id AS transcript_id, coalesce(parent, id) AS up, strand FROM l WHERE feature IN ('mrna', 'transcript')),
e AS (SELECT * FROM l WHERE feature IN ('exon', 'cds') AND parent IS NOT NULL),
z AS (SELECT transcript_id, CASE WHEN count(*) FILTER (WHERE strand = '-') > 0 THEN '-' ELSE '+' END AS strand
  FROM (SELECT transcript_id, strand FROM t UNION ALL SELECT parent, strand FROM e) GROUP BY transcript_id),
v AS (SELECT e.parent AS transcript_id, regexp_replace(coalesce(t.up, e.parent), '-mRNA.*$', '') AS gene_id, z.strand, e.feature AS kind, e.id, e.seqid, e.start_1based, e.end_1based, e.phase
  FROM e JOIN z ON e.parent = z.transcript_id LEFT JOIN t ON e.parent = t.transcript_id)"""
_LAST_CONTIG = f"{_G}, c AS (SELECT chrom, arg_max(seq, chrom_idx) AS seq, arg_max(len, chrom_idx) AS len FROM g GROUP BY chrom)"


def _annotation_sql(rows: str) -> str:
    """``rows``: (name, id, strand, seqid, start_1based, end_1based, trim)."""
    return f"""WITH {_LAST_CONTIG}, {_PARTS},
r AS ({rows}),
q AS (SELECT r.*, substr(substr(c.seq, start_1based, end_1based - start_1based + 1), trim + 1) AS part,
  c.chrom IS NOT NULL AND start_1based >= 1 AND start_1based <= end_1based AND end_1based <= c.len AS good FROM r LEFT JOIN c ON r.seqid = c.chrom),
j AS (SELECT name, max(strand) AS strand, string_agg(part, '' ORDER BY start_1based, end_1based, id NULLS FIRST, part) AS seq FROM q GROUP BY name HAVING bool_and(coalesce(good, false)))
SELECT name, CASE WHEN strand = '-' THEN {_RC.format("seq")} ELSE seq END AS seq FROM j WHERE seq <> ''"""



def _sides_sql(where: str = "") -> str:
    return (
        _sites_sql([_NGG_NAG], dust=True)
        + f""", w AS (SELECT l.site_id, l.is_reverse, substr(g.seq, l.start_pos + 1, l.spacer_length) AS w FROM spacer_locations l JOIN g ON l.chrom_idx = g.chrom_idx
  WHERE l.start_pos >= 0 AND l.start_pos + l.spacer_length <= g.len{where}),
q AS (SELECT CAST(site_id AS VARCHAR) AS query_name, CASE WHEN is_reverse THEN {_RC.format("w")} ELSE w END AS query_seq FROM w WHERE length(w) = 20),
n AS (SELECT DISTINCT name AS target_name, seq AS target_seq FROM sd)"""
    )


_STATED_SIDES = _sides_sql(f" AND l.site_id % {QUERY_STEP} = 0")
_MISMATCHES = """dq AS (SELECT DISTINCT query_seq, regexp_replace(query_seq, '[^ACGT]', 'A', 'g') AS a FROM q),
dt AS (SELECT DISTINCT target_seq, regexp_replace(target_seq, '[^ACGT]', 'A', 'g') AS b FROM n),
x AS (SELECT query_seq, target_seq, hamming(a, b) AS distance FROM dq, dt WHERE hamming(a, b) <= 4),
mm AS (SELECT query_name, x.query_seq, target_name, x.target_seq, CAST(distance AS INTEGER) AS distance, CASE WHEN distance = 0 THEN 'Exact' ELSE 'Mismatch' END AS search_type
  FROM x JOIN q ON q.query_seq = x.query_seq JOIN n ON n.target_seq = x.target_seq)"""
# Levenshtein of all pairs takes DuckDB minutes, so candidates share six bases within two places, as every pair with two edits must.
_INDELS = """qk AS (SELECT DISTINCT query_seq, a, substr(query_seq, a + 1, 6) AS key FROM q, (SELECT unnest([2, 8, 14]) AS a)),
tk AS (SELECT DISTINCT target_seq, a, substr(target_seq, a + move + 1, 6) AS key FROM n, (SELECT unnest([2, 8, 14]) AS a), (SELECT unnest([-2, -1, 0, 1, 2]) AS move) WHERE a + move + 6 <= 20),
near AS (SELECT DISTINCT query_seq AS s, target_seq AS t FROM qk JOIN tk ON qk.a = tk.a AND qk.key = tk.key),
y AS (SELECT s, t, least(levenshtein(s, t), levenshtein(substr(s, 2), t), levenshtein(substr(s, 3), t), levenshtein(s, substr(t, 2)), levenshtein(s, substr(t, 3))) AS distance FROM near),
ii AS (SELECT query_name, query_seq, target_name, target_seq, CAST(distance AS INTEGER) AS distance, 'Indel' AS search_type
  FROM y JOIN q ON q.query_seq = y.s JOIN n ON n.target_seq = y.t WHERE distance <= 2)"""


def _attribute(name: str) -> str:
    """SQL of the first attribute of this name, from the masked ninth column ``m``."""
    first = f"""list_filter(regexp_extract_all(m, '(?:[^;"]|"[^"]*")+'), lambda x: regexp_matches(x, '^\\s*{name}([=\\s]|$)'))[1]"""
    return f"""replace(regexp_replace(regexp_replace(regexp_replace({first}, '^\\s*{name}[=\\s]?', ''), '^[\\s"]+', ''), '[\\s"]+$', ''), chr(1), '"')"""


_PADDED = """nm AS (SELECT DISTINCT target_name FROM search_hits WHERE regexp_matches(target_name, '^(.*):(\\d+)-(\\d+):([+-])$')),
pp AS (SELECT target_name, regexp_extract(target_name, '^(.*):\\d+-\\d+:[+-]$', 1) AS chrom, CAST(regexp_extract(target_name, ':(\\d+)-\\d+:[+-]$', 1) AS BIGINT) - 1 AS lo,
  CAST(regexp_extract(target_name, '-(\\d+):[+-]$', 1) AS BIGINT) AS hi, target_name LIKE '%-' AS rev FROM nm),
ps AS (SELECT target_name, rev, CASE WHEN rev THEN substr(seq, lo + 1, hi + 2 - lo) ELSE substr(seq, greatest(lo - 2, 0) + 1, hi - greatest(lo - 2, 0)) END AS w
  FROM pp JOIN c ON pp.chrom = c.chrom WHERE lo >= 0 AND lo < hi AND hi <= len),
pd AS (SELECT target_name, CASE WHEN rev THEN """ + _RC.format("w") + """ ELSE w END AS padded FROM ps)"""
# Every alignment of each distinct pair, one base or gap a step; then the events' weights in their order.
_SCORED = f"""{_LAST_CONTIG}, {_PADDED}, {_RAW},
hp AS (SELECT f.*, upper(query_seq) AS q, padded AS t FROM f JOIN pd ON f.target_name = pd.target_name WHERE query_seq IS NOT NULL),
dq AS (SELECT q, t, row_number() OVER () AS pid FROM (SELECT DISTINCT q, t FROM hp)),
wk AS (
  SELECT pid, reverse(q) AS a, reverse(t) AS b, 0 AS i, 0 AS j, 0 AS subs, 0 AS gaps, '' AS moves, []::STRUCT(op VARCHAR, pos INTEGER, q VARCHAR, t VARCHAR)[] AS ev FROM dq
  UNION ALL
  SELECT pid, a, b, CASE WHEN o < 2 THEN i + 1 ELSE i END, CASE WHEN o <> 1 THEN j + 1 ELSE j END, subs + CASE WHEN o = 0 AND NOT same THEN 1 ELSE 0 END, gaps + CASE WHEN o > 0 THEN 1 ELSE 0 END, moves || o,
    CASE WHEN o = 0 AND same THEN ev WHEN o = 0 THEN list_append(ev, {{'op': 'sub', 'pos': -(i + 1), 'q': x, 't': y}}) WHEN o = 1 THEN list_append(ev, {{'op': 'del', 'pos': -(i + 1), 'q': x, 't': '-'}})
      ELSE list_append(ev, {{'op': 'ins', 'pos': -(i + 1), 'q': '-', 't': y}}) END
  FROM (SELECT *, substr(a, i + 1, 1) AS x, substr(b, j + 1, 1) AS y, substr(a, i + 1, 1) = substr(b, j + 1, 1) AS same FROM wk WHERE i < length(a)), (SELECT unnest([0, 1, 2]) AS o)
  WHERE CASE WHEN o = 0 THEN j < length(b) AND (same OR subs < CASE WHEN gaps > 0 THEN 2 - gaps ELSE 4 END) WHEN o = 1 THEN subs + gaps < 2 ELSE subs + gaps < 2 AND j < length(b) END),
sw AS (SELECT pid, moves, ev, len(ev) AS n, list_reduce(list_prepend({{'z': 1.0::DOUBLE, 'i': 99, 'op': '', 'n': 0}}, list_transform(list_sort(ev), lambda e: {{'z': 0.0::DOUBLE, 'i': abs(e.pos), 'op': e.op, 'n': len(ev)}})),
  lambda s, e: {{'z': (CASE WHEN e.op <> 'sub' THEN s.z * (0.0014::DOUBLE * e.i * e.i + 0.0021::DOUBLE * e.i + 0.3055::DOUBLE - 0.23::DOUBLE - e.i * 0.01::DOUBLE) / e.n WHEN e.n > 4 THEN 1e-7::DOUBLE
    ELSE s.z * (0.0014::DOUBLE * e.i * e.i + 0.0021::DOUBLE * e.i + 0.3055::DOUBLE) / CASE e.n WHEN 1 THEN 1.0::DOUBLE WHEN 4 THEN 4.0::DOUBLE ELSE 1.8::DOUBLE END END)
    * CASE WHEN abs(e.i - s.i) = 1 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 'i': e.i, 'op': e.op, 'n': e.n}}).z AS score FROM wk WHERE i = length(a)),
bw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, moves) AS rk FROM sw) WHERE rk = 1),
sc AS (SELECT query_name, hp.q AS query_seq, target_name, target_seq, CAST(bw.n AS INTEGER) AS distance, CASE WHEN bw.n = 0 THEN 'Exact' WHEN len(list_filter(ev, lambda e: e.op <> 'sub')) > 0 THEN 'Indel' ELSE 'Mismatch' END AS search_type,
  genomic_frequency, score, '[' || array_to_string(list_transform(list_reverse(ev), lambda e: '["' || e.op || '",' || e.pos || ',"' || e.q || '","' || e.t || '"]'), ',') || ']' AS details
  FROM hp JOIN dq ON hp.q = dq.q AND hp.t = dq.t JOIN bw ON dq.pid = bw.pid)"""


SQL = {
    "contig_stats": f"WITH {_G} SELECT count(*) AS n_contigs, CAST(sum(len) AS BIGINT) AS total_bases, max(len) AS longest FROM g",
    "sites_single_pam": _sites_sql([(3, ".GG", "CC.")]) + f"SELECT {_SITE} FROM s",
    "sites_dual_pam": _sites_sql([_NGG_NAG]) + f"SELECT {_SITE}, name FROM s",
    "sites_down": _sites_sql([_NGG_NAG], up=False) + f"SELECT {_SITE} FROM s",
    "sites_unequal_pams": _sites_sql([(3, ".GR", ".C."), (4, "..AG", "CT..")]) + f"SELECT {_SITE} FROM s",
    "dust_filter": _sites_sql([_NGG_NAG], dust=True) + f"SELECT {_SITE} FROM sd",
    "site_sequences": _LOCATED + f"SELECT site_id, seq, CAST({_DUST} AS BIGINT) AS dust FROM loc",
    "site_codes": _LOCATED
    + f"""SELECT site_id, {_CODE} AS code, CASE WHEN regexp_full_match(seq, '[ACGT]{{1,32}}') THEN {_CODE} END AS strict, """
    + ", ".join(f"list_sum([CASE WHEN substr(seq, i::BIGINT, 1) = '{b}' THEN 1 << (20 - i) ELSE 0 END for i in range(1, 21)])::BIGINT AS bits_{b.lower()}" for b in S.BASES)
    + " FROM loc",
    "code_uniqueness": _LOCATED + f"SELECT count(*) AS total, count(DISTINCT code) AS unique_codes, round(count(DISTINCT code) / count(*), 9) AS uniqueness FROM (SELECT {_CODE} AS code FROM loc)",
    "reverse_complement": f"SELECT hit_id, {_RC.format('upper(target_seq)')} AS rc FROM search_hits",
    "hit_regions": r"""SELECT hit_id, CASE WHEN ok THEN regexp_extract(target_name, p, 1) END AS chrom, CASE WHEN ok THEN CAST(regexp_extract(target_name, p, 2) AS BIGINT) END AS start_1based,
  CASE WHEN ok THEN CAST(regexp_extract(target_name, p, 3) AS BIGINT) END AS end_1based, CASE WHEN ok THEN regexp_extract(target_name, p, 4) = '-' END AS is_reverse
FROM (SELECT hit_id, target_name, '^(.*):(\d+)-(\d+):([+-])$' AS p, regexp_matches(target_name, '^(.*):(\d+)-(\d+):([+-])$') AS ok FROM search_hits)""",
    "hit_distances": """WITH h AS (SELECT hit_id, upper(query_seq) AS q, upper(target_seq) AS t FROM search_hits WHERE query_seq IS NOT NULL AND target_seq IS NOT NULL)
SELECT hit_id, CASE WHEN t = '' THEN -1 ELSE strpos('ACGT', substr(t, 1, 1)) - 1 END AS first_base, CASE WHEN length(q) <> length(t) THEN -1 ELSE hamming(q, t) END AS hamming, CASE WHEN d <= 2 THEN d END AS right_anchored
FROM (SELECT *, least(levenshtein(q, t), levenshtein(substr(q, 2), t), levenshtein(substr(q, 3), t), levenshtein(q, substr(t, 2)), levenshtein(q, substr(t, 3))) AS d FROM h)""",
    "combine_priority": f"WITH {_COMBINED} SELECT * FROM k",
    "raw_hits": f"WITH {_RAW} SELECT * FROM f",
    "raw_file": f"""WITH {_RAW} SELECT coalesce(query_name, '') || chr(9) || coalesce(query_seq, '') || chr(9) || coalesce(target_name, '') || chr(9) || coalesce(target_seq, '') || chr(9)
  || coalesce(CAST(distance AS VARCHAR), '') || chr(9) || coalesce(search_type, '') || chr(9) || genomic_frequency AS value FROM f""",
    "hit_file": f"""WITH {_COMBINED} SELECT coalesce(query_name, '') || chr(9) || coalesce(query_seq, '') || chr(9) || coalesce(target_name, '') || chr(9) || coalesce(target_seq, '') || chr(9)
  || coalesce(CAST(distance AS VARCHAR), '') AS value FROM k""",
    "mismatch_join": f"{_STATED_SIDES}, {_MISMATCHES} SELECT * FROM mm",
    "indel_join": f"{_STATED_SIDES}, {_INDELS} SELECT * FROM ii",
    "genome_search": f"""{_sides_sql()}, {_MISMATCHES}, {_INDELS},
search_hits AS (SELECT * FROM mm UNION ALL SELECT * FROM ii),
{_RAW} SELECT query_name, query_seq, target_name, target_seq, distance, search_type, genomic_frequency FROM f""",
    "line_attributes": f"{RECORD_LINES} SELECT line_no, " + ", ".join(f"{_attribute(n)} AS {n.lower()}" for n in ("ID", "Parent", "gene_id")) + " FROM j WHERE reason IS NULL",
    "line_segments": f"""{RECORD_LINES}, v AS (
  SELECT line_no, f[1] AS seqid, feat, CAST(f[4] AS BIGINT) AS start_1based, CAST(f[5] AS BIGINT) AS end_1based, f[7] AS strand, CAST(nullif(f[8], '.') AS INTEGER) AS phase,
    {", ".join(f"nullif({_attribute(n)}, '') AS a_{n.lower()}" for n in ("ID", "Parent", "gene_id", "transcript_id"))}
  FROM j WHERE (reason IS NULL OR reason = 'id' OR (reason = 'phase' AND f[8] = '.')) AND feat IN ('mrna', 'transcript', 'exon', 'cds')),
st AS (SELECT coalesce(a_id, a_transcript_id) AS transcript_id, regexp_replace(coalesce(a_parent, a_gene_id, a_id, a_transcript_id), '-mRNA.*$', '') AS up, strand, line_no
  FROM v WHERE feat IN ('mrna', 'transcript') AND coalesce(a_id, a_transcript_id) IS NOT NULL),
o AS (SELECT transcript_id, arg_max(up, line_no) AS up, arg_max(coalesce(strand, ''), line_no) AS strand FROM st GROUP BY transcript_id),
e AS (SELECT coalesce(a_parent, a_transcript_id) AS transcript_id, v.*, a_gene_id AS own FROM v WHERE feat IN ('exon', 'cds') AND coalesce(a_parent, a_transcript_id) IS NOT NULL),
g AS (SELECT e.*, coalesce(own, o.up, regexp_replace(e.transcript_id, '-mRNA.*$', '')) AS gene_id FROM e LEFT JOIN o ON e.transcript_id = o.transcript_id),
z AS (SELECT transcript_id, gene_id, CASE WHEN count(*) FILTER (WHERE strand = '-') > 0 THEN '-' ELSE '+' END AS strand
  FROM (SELECT transcript_id, gene_id, strand FROM g UNION ALL SELECT transcript_id, up, strand FROM o) GROUP BY ALL)
SELECT g.transcript_id, g.gene_id, z.strand, g.feat AS kind, CAST(line_no AS VARCHAR) AS id, seqid, start_1based, end_1based, phase FROM g JOIN z ON g.transcript_id = z.transcript_id AND g.gene_id = z.gene_id""",
    "padded": f"WITH {_LAST_CONTIG}, {_PADDED} SELECT target_name, padded FROM pd",
    "scored_genome_hits": f"WITH RECURSIVE {_SCORED} SELECT query_name, query_seq, target_name, target_seq, distance, search_type, genomic_frequency, score, details FROM sc",
    "scored_file": f"""WITH RECURSIVE {_SCORED} SELECT coalesce(query_name, '') || chr(9) || query_seq || chr(9) || target_name || chr(9) || coalesce(target_seq, '') || chr(9) || distance || chr(9) || search_type || chr(9)
  || genomic_frequency || chr(9) || CASE WHEN regexp_matches(printf('%.12g', score), '[.e]') THEN printf('%.12g', score) ELSE printf('%.12g', score) || '.0' END || chr(9) || details AS value FROM sc""",
    "event_distance": """WITH RECURSIVE d AS (SELECT DISTINCT query_seq AS a, target_seq AS b FROM search_hits WHERE query_seq IS NOT NULL AND target_seq IS NOT NULL),
n AS (SELECT *, levenshtein(a, b) AS far FROM d),
-- The rows of the edit table, each from the one before.
r AS (
  SELECT a, b, 0 AS i, range(0, length(b) + 1)::BIGINT[] AS row FROM n WHERE far <= 4
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_prepend([i + 1]::BIGINT[], [[j]::BIGINT[] for j in range(1, length(b) + 1)]),
    lambda acc, x: list_append(acc, least(row[x[1] + 1] + 1, acc[x[1]] + 1, row[x[1]] + CASE WHEN substr(a, i + 1, 1) = substr(b, x[1], 1) THEN 0 ELSE 1 END)))
  FROM r WHERE i < length(a)),
t AS (SELECT a, b, list(row ORDER BY i) AS tab FROM r GROUP BY a, b),
w AS (
  SELECT a, b, tab, length(a) AS i, length(b) AS j, false AS run, 0 AS events FROM t
  UNION ALL
  SELECT a, b, tab, CASE WHEN diag OR del THEN i - 1 ELSE i END, CASE WHEN diag OR NOT del THEN j - 1 ELSE j END, NOT diag, events + CASE WHEN diag THEN differ ELSE CASE WHEN run THEN 0 ELSE 1 END END FROM (
    SELECT *, NOT diag AND i > 0 AND coalesce(tab[i + 1][j + 1] = tab[i][j + 1] + 1, false) AS del FROM (
      SELECT *, i > 0 AND j > 0 AND coalesce(tab[i + 1][j + 1] = tab[i][j] + differ, false) AS diag FROM (
        SELECT *, CASE WHEN i > 0 AND j > 0 AND substr(a, i, 1) = substr(b, j, 1) THEN 0 ELSE 1 END AS differ FROM w WHERE i > 0 OR j > 0))))
SELECT a AS query_seq, b AS target_seq, CAST(events AS INTEGER) AS events FROM w WHERE i = 0 AND j = 0
UNION ALL SELECT a, b, CAST(far AS INTEGER) FROM n WHERE far > 4""",
    "score_texts": """SELECT result_id, CASE WHEN regexp_matches(t, '[.e]') THEN t ELSE t || '.0' END AS score_text
FROM (SELECT result_id, printf('%.12g', score) AS t FROM scored_results WHERE score IS NOT NULL AND NOT isnan(score))""",
    "query_summary": """SELECT query_name, count(*) AS total, count(*) FILTER (WHERE search_type = 'Exact') AS exact, count(*) FILTER (WHERE search_type = 'Mismatch') AS mismatch,
  count(*) FILTER (WHERE search_type = 'Indel') AS indel, count(DISTINCT target_name) AS uniq,
  round(coalesce(product(1 - score / 2) FILTER (WHERE search_type <> 'Exact' AND NOT isnan(score)), 1.0), 6) AS success_rate, count(DISTINCT target_name) <= 10 AS hot
FROM scored_results WHERE query_name IS NOT NULL GROUP BY query_name""",
    "count_filter": """SELECT hit_id, target_seq FROM search_hits WHERE target_seq IS NOT NULL
  AND target_seq NOT IN (SELECT target_seq FROM search_hits WHERE target_seq IS NOT NULL GROUP BY target_seq HAVING count(*) > 10)""",
    "over_represented": """SELECT target_seq AS seq, count(*) AS n, '>count_' || count(*) || chr(10) || target_seq AS record FROM search_hits
WHERE target_seq IS NOT NULL GROUP BY target_seq HAVING count(*) > 10""",
    "on_target_filter": """WITH c AS (SELECT target_seq AS seq, count(*) AS n FROM search_hits WHERE target_seq IS NOT NULL GROUP BY 1),
f AS (SELECT query_seq AS seq, min(hit_id) AS hit_id FROM search_hits WHERE query_seq IS NOT NULL GROUP BY 1)
SELECT hit_id, f.seq, coalesce(n, 0) AS n FROM f LEFT JOIN c ON f.seq = c.seq WHERE coalesce(n, 0) <= 10""",
    "transcript_segments": f"WITH {_PARTS} SELECT * FROM v",
    "anno_gene": _annotation_sql("SELECT id AS name, id, CASE WHEN strand = '-' THEN '-' ELSE '+' END AS strand, seqid, start_1based, end_1based, 0 AS trim FROM l WHERE feature = 'gene'"),
    "anno_mrna": _annotation_sql("SELECT transcript_id AS name, id, strand, seqid, start_1based, end_1based, 0 AS trim FROM v WHERE kind = 'exon'"),
    "anno_cds": _annotation_sql("SELECT transcript_id AS name, id, strand, seqid, start_1based, end_1based, coalesce(phase, 0) AS trim FROM v WHERE kind = 'cds'"),
}
