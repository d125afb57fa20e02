"""Queries of the problems on training data (p2, p4, p6, p8, p9, p10) and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guideloom.llm.lookalikes import CYRILLIC, GREEK, consistent_texts, look_alike_classes, look_alike_pairs
from guideloom.llm.ngrams import ngram_counts
from guideloom.llm.packing import pack_items
from guideloom.llm.splitting import sites_in_pieces, split_sequences
from guideloom.llm.tokenize import decoded_texts, token_counts, token_ids
from guideloom.llm.topn import top_n_per_group
from guideloom.plans.scratch import Scratch
from guideloom.tables import Query, table

PIECE_LIMIT, PIECE_OVERLAP = 6000, 50
CONTAINER_TOKENS = 2048


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the contigs over the size limit."""
    return split_sequences(table(spark, d, "contigs"), "chrom_idx", "chrom_sequence", max_size=PIECE_LIMIT, longer_than=PIECE_LIMIT)


def p2_sites(spark: SparkSession, d: str) -> DataFrame:
    """For each spacer site the first piece of its contig that holds it whole."""
    pieces = split_sequences(table(spark, d, "contigs"), "chrom_idx", "chrom_sequence", max_size=PIECE_LIMIT)
    return sites_in_pieces(table(spark, d, "spacer_locations"), pieces, "chrom_idx", "start_pos", "spacer_length", "site_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All contigs as texts under the limit, with the least cut penalties and imbalance in sum."""
    return split_sequences(table(spark, d, "contigs"), "chrom_idx", "chrom_sequence", max_size=PIECE_LIMIT, objective="balanced", with_text=True)


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of every contig the bases that the pieces of p2_pieces cover, by their bounds and by their texts, and the number of pieces that break a limit."""
    size = F.col("piece_end") - F.col("piece_start")
    wrong = (size > PIECE_LIMIT) | (size != F.length("piece"))
    shared = PIECE_OVERLAP * (F.count(F.lit(1)) - 1)
    return p2_pieces(spark, d).groupBy("chrom_idx").agg((F.sum(size) - shared).alias("by_bounds"), (F.sum(F.length("piece")) - shared).alias("by_texts"), F.max("piece_end").alias("last_end"), F.count_if(wrong).alias("n_wrong"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best targets of each query."""
    best = top_n_per_group(table(spark, d, "scored_results"), "query_name", "target_name", "score", "result_id", 5)
    return best.select("query_name", "result_id")


def _counted_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits that count: known names, plain bases, equal deliveries once."""
    hits = table(spark, d, "search_hits").select("query_name", "target_name", F.upper("target_seq").alias("target_seq"))
    return hits.where("query_name is not null and target_name is not null and target_seq rlike '^[ACGT]+\\\\z'").distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits and queries of every target sequence, and whether it is rare or common."""
    counts = ngram_counts(_counted_hits(spark, d), F.array("target_seq"), F.col("query_name"), tie=F.col("target_name"))
    queries = table(spark, d, "search_hits").select("query_name").where("query_name is not null").distinct()
    total = queries.agg(F.count(F.lit(1))).scalar()
    mark = F.when(F.col("occurrences") == 1, "rare").when(F.col("records") * 20 >= total, "common")
    return counts.select(F.col("ngram")[0].alias("target_seq"), F.col("occurrences").alias("n_hits"), F.col("records").alias("n_queries"), mark.alias("mark"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The target sequences that are too rare or too common."""
    return p6_counts(spark, d).where("mark is not null").select("target_seq", "mark")


def p6_kmers(spark: SparkSession, d: str) -> DataFrame:
    """All runs of three to six bases in the distinct target sequences: occurrences, sequences that hold them, and whether too rare or too common."""
    sequences = _counted_hits(spark, d).select("target_seq").distinct()
    counts = ngram_counts(sequences, F.col("target_seq"), F.col("target_seq"), max_n=6, min_n=3)
    total = sequences.agg(F.count(F.lit(1))).scalar()
    mark = F.when(F.col("occurrences") == 1, "rare").when(F.col("records") * 20 >= total, "common")
    return counts.select(F.col("ngram").alias("kmer"), "n", "occurrences", "records", mark.alias("mark"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of every document, and whether decoding its ids gives its text again (true where there is none)."""
    documents = table(spark, d, "documents")
    ids = Scratch(spark, "tokens").written(token_ids(documents, "doc_id", "text"))
    decoded = decoded_texts(ids, "doc_id", "ids").withColumnRenamed("text", "decoded").join(ids.select("doc_id", F.size("ids").alias("n_tokens")), "doc_id")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return documents.select("doc_id", "text").join(decoded, "doc_id").select("doc_id", "n_tokens", same.alias("same"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text as its token ids give it back; empty where it has none."""
    return decoded_texts(token_ids(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids")


def p9_bins(spark: SparkSession, d: str) -> DataFrame:
    """Containers of the documents' texts, in tokens."""
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text")
    return pack_items(sizes, "doc_id", "n_tokens", CONTAINER_TOKENS)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers over capacity, documents whose parts don't add up or were divided without need, and whether the containers are at most a hundredth, or one, more than the least number possible."""
    documents = Scratch(spark, "tokens").written(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    bins = Scratch(spark, "bins").written(pack_items(documents, "doc_id", "n_tokens", CONTAINER_TOKENS))
    of_bin = bins.groupBy("container_id").agg(F.sum("size").alias("fill"))
    filled = of_bin.agg(F.count_if(F.col("fill") > CONTAINER_TOKENS).alias("n_over"), F.count(F.lit(1)).alias("n"), F.sum("fill").alias("tokens"))
    least = F.ceil(F.col("tokens") / CONTAINER_TOKENS)
    parts = bins.groupBy("doc_id").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("parts"))
    whole = (F.col("held") == F.col("n_tokens")) & (F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CONTAINER_TOKENS)))
    wrong = documents.join(parts, "doc_id", "left").agg(F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_wrong"))
    return filled.select("n_over", (F.col("n") <= F.greatest(least + 1, least * 1.01)).alias("is_full"), F.lit(0).alias("one")).join(wrong.withColumn("one", F.lit(0)), "one").select("n_over", "n_wrong", "is_full")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts differ but look the same."""
    pairs = look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every document with a text, and how many documents differ from it but look the same."""
    return look_alike_classes(table(spark, d, "documents"), "doc_id", "text")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """The one consistent form of every text."""
    return consistent_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p2_found, p2_sites, p2_pieces, p2_coverage, p4_found, p6_found, p6_counts, p6_kmers, p8_ids, p8_roundtrip, p8_decoded, p9_bins, p9_fill, p10_found, p10_classes, p10_texts)
}

_PIECES = """WITH RECURSIVE c AS (
  SELECT chrom_idx, chrom_sequence AS q, length(chrom_sequence) AS n FROM contigs WHERE length(chrom_sequence) > {least}),
b AS (
  SELECT chrom_idx, list(x) AS bs FROM (SELECT chrom_idx, q, n, unnest(range(10, n + 1)) AS x FROM c)
  WHERE regexp_full_match(substr(q, x - 9, 10), '[Nn]+') AND (x = n OR substr(q, x + 1, 1) NOT IN ('N', 'n')) GROUP BY chrom_idx),
t AS (SELECT c.chrom_idx, n, coalesce(bs, []::BIGINT[]) AS bs FROM c LEFT JOIN b ON c.chrom_idx = b.chrom_idx),
r AS (
  SELECT chrom_idx, n, bs, 0::BIGINT AS s, CASE WHEN n <= 6000 THEN n ELSE coalesce(list_max(list_filter(bs, lambda z: z > 3000 AND z <= 6000)), 6000) END AS e FROM t
  UNION ALL
  SELECT chrom_idx, n, bs, e - 50, CASE WHEN n - (e - 50) <= 6000 THEN n
    ELSE coalesce(list_max(list_filter(bs, lambda z: z > e - 50 + 3000 AND z <= e - 50 + 6000)), e - 50 + 6000) END FROM r WHERE e < n)
"""

_COUNTS = """WITH h AS (
  SELECT DISTINCT query_name, target_name, upper(target_seq) AS target_seq FROM search_hits
  WHERE query_name IS NOT NULL AND target_name IS NOT NULL AND regexp_full_match(upper(target_seq), '[ACGT]+')),
k AS (
  SELECT target_seq, count(*) AS n_hits, count(DISTINCT query_name) AS n_queries FROM h GROUP BY target_seq),
m AS (
  SELECT *, CASE WHEN n_hits = 1 THEN 'rare' WHEN n_queries * 20 >= (SELECT count(DISTINCT query_name) FROM search_hits) THEN 'common' END AS mark FROM k)
"""



def _plain_form(text: str) -> str:
    """SQL of a text's form by replacing and composing characters; for the kinds of characters that the tables hold."""
    letters = dict(zip(CYRILLIC[0] + GREEK[0], CYRILLIC[1] + GREEK[1], strict=True))
    odd = list(letters) + [chr(n) for n in range(0xFF01, 0xFF5F)]
    latin = list(letters.values()) + [chr(n - 0xFEE0) for n in range(0xFF01, 0xFF5F)]
    for n in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):  # letters with accents, as one character
        base, *marks = unicodedata.normalize("NFD", chr(n))
        if marks and base in letters:
            odd.append(chr(n))
            latin.append(unicodedata.normalize("NFC", letters[base] + "".join(marks)))
    pairs = [(a, b) for a, b in zip(odd, latin, strict=True) if len(b) == 1]
    quoted = lambda chars: "'" + "".join(chars).replace("'", "''") + "'"
    bare = rf"regexp_replace({text}, '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g')"
    spaced = rf"regexp_replace({bare}, '[\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({spaced}), {quoted(a for a, _ in pairs)}, {quoted(b for _, b in pairs)}))"


_FORMS = f"WITH f AS (SELECT doc_id, text, {_plain_form('text')} AS form FROM documents WHERE text <> '')"

SQL = {
    "p2_coverage": "SELECT chrom_idx, length(chrom_sequence) AS by_bounds, length(chrom_sequence) AS by_texts, length(chrom_sequence) AS last_end, 0 AS n_wrong FROM contigs WHERE chrom_sequence <> ''",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_fill": "SELECT 0 AS n_over, 0 AS n_wrong, true AS is_full FROM (SELECT count(*) FROM documents)",
    "p10_found": f"{_FORMS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_classes": f"""{_FORMS}, k AS (SELECT form, text, count(*) AS n FROM f GROUP BY form, text), c AS (SELECT form, min(doc_id) AS class_id, count(*) AS n_all FROM f GROUP BY form)
SELECT doc_id, class_id, n_all - n AS links FROM f JOIN k USING (form, text) JOIN c USING (form)""",
    "p10_texts": f"SELECT doc_id, {_plain_form('text')} AS text FROM documents",
    "p2_found": _PIECES.format(least=PIECE_LIMIT) + "SELECT chrom_idx, s AS piece_start, e AS piece_end FROM r",
    "p2_sites": _PIECES.format(least=0)
    + """SELECT l.site_id, l.chrom_idx, min(r.s) AS piece_start, min(r.e) AS piece_end FROM spacer_locations l
LEFT JOIN r ON l.chrom_idx = r.chrom_idx AND l.start_pos >= r.s AND l.start_pos + l.spacer_length <= r.e GROUP BY l.site_id, l.chrom_idx""",
    "p4_found": """WITH b AS (
  SELECT *, row_number() OVER (PARTITION BY query_name, target_name ORDER BY score DESC, result_id) AS r FROM scored_results
  WHERE query_name IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
k AS (SELECT query_name, result_id, row_number() OVER (PARTITION BY query_name ORDER BY score DESC, target_name NULLS FIRST) AS p FROM b WHERE r = 1)
SELECT query_name, result_id FROM k WHERE p <= 5""",
    "p6_counts": _COUNTS + "SELECT target_seq, n_hits, n_queries, mark FROM m",
    "p6_kmers": """WITH s AS (
  SELECT DISTINCT upper(target_seq) AS q FROM search_hits WHERE query_name IS NOT NULL AND target_name IS NOT NULL AND regexp_full_match(upper(target_seq), '[ACGT]+')),
p AS (SELECT q, unnest(range(1, length(q) + 1)) AS i FROM s),
g AS (SELECT q, n, substr(q, i, n) AS kmer FROM p, (SELECT unnest([3, 4, 5, 6]) AS n) WHERE i + n <= length(q) + 1),
c AS (SELECT kmer, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT q) AS records FROM g GROUP BY kmer, n)
SELECT *, CASE WHEN occurrences = 1 THEN 'rare' WHEN records * 20 >= (SELECT count(*) FROM s) THEN 'common' END AS mark FROM c""",
    "p6_found": _COUNTS + "SELECT target_seq, mark FROM m WHERE mark IS NOT NULL",
}
