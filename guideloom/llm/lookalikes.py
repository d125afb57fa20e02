"""One consistent form of texts that look the same but differ in their characters (problem 10).

Method: a compiled longest-match transducer over grapheme clusters. A mapping for widths, accents,
spaces and look-alike letters is computed once from the Unicode database and a short list of
letters, checked for conflicts, and applied in one pass: the longest cluster (a base, or a Hangul
syllable and letters that may join it, and all marks and widthless characters after it) that
begins at a place is replaced by its form. The mapping holds single characters and the clusters that
Unicode has a composed character for, also with look-alike and half-width bases; clusters without
end (marks in any number and order, widthless characters between, Hangul letters) get their form
by the rule the mapping is computed from.

A Cyrillic or Greek letter is listed as a Latin one if ordinary upright type draws both with the
same outline; letters that only resemble one (the Greek gamma, sigma or kappa) are not.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guideloom.plans.ordering import batches
from guideloom.plans.scratch import Scratch

# Letters that look like Latin ones, in the order of the Latin letters beside them.
CYRILLIC = ("АВСЕԌНІӀЈКМОРԚЅТѴԜХУҮасԁеһіјӏорԛѕѵԝху", "ABCEGHIIJKMOPQSTVWXYYacdehijlopqsvwxy")
GREEK = ("ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖαϲιϳνορυ", "ABCEHIJKMNOPTXYZacijvopu")
# Code points without width, as ranges.
WIDTHLESS = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0001, 0xE007F), (0xE0100, 0xE01EF))
HALF_WIDTH_MARKS = "ﾞﾟ"
# Hangul letters that may join into syllables, in half width too, and the syllables.
JAMO = "ᄀ-ᇿꥠ-ꥼힰ-ퟻ\uffa0-\uffdc"
SYLLABLES = "\uac00-\ud7a3"
KEPT_CLUSTERS = 100_000


def look_alike_letters() -> dict[str, str]:
    """Letter -> Latin letter of the same look."""
    return {a: b for odd, latin in (CYRILLIC, GREEK) for a, b in zip(odd, latin, strict=True)}


def is_widthless(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in WIDTHLESS)


def cluster_form(cluster: str, letters: dict[str, str]) -> str:
    """The one form of a grapheme cluster, by the rules the mapping is computed from."""
    out = []
    for c in cluster:
        if is_widthless(c):
            continue
        if unicodedata.category(c) == "Zs":
            c = " "
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            c = unicodedata.normalize("NFKC", c)
        out += [letters.get(x, x) for x in unicodedata.normalize("NFD", c)]
    return unicodedata.normalize("NFC", "".join(out))


def _clusters(letters: dict[str, str]) -> Iterator[str]:
    """Every spelling of a composed character with its marks apart, one after the other, also with bases that look like its own."""
    alike: dict[str, list[str]] = {}
    for odd, latin in letters.items():
        alike.setdefault(latin, []).append(odd)
    narrow: dict[str, str] = {}
    for n in range(0xFF01, 0xFFEF):
        if unicodedata.decomposition(chr(n)).startswith(("<wide>", "<narrow>")):
            narrow[unicodedata.normalize("NFKC", chr(n))] = chr(n)
    for n in range(0xC0, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(n))
        if len(parts) == 1 or 0xAC00 <= n <= 0xD7A3 or unicodedata.normalize("NFC", parts) != chr(n):
            continue
        for base in (parts[0], *alike.get(parts[0], ()), *([narrow[parts[0]]] if parts[0] in narrow else ())):
            spelled = base + parts[1:]
            for k in range(1, len(parts)):
                yield unicodedata.normalize("NFC", spelled[:k]) + spelled[k:]
    for kana in narrow.values():
        yield from (kana + mark for mark in HALF_WIDTH_MARKS)


@cache
def compiled_mapping() -> dict[str, str]:
    """Cluster -> form, for all single characters that change and the clusters of composed characters; raises where two rules conflict."""
    letters = look_alike_letters()
    known = (chr(n) for n in range(0x80, sys.maxunicode + 1))
    single = (c for c in known if unicodedata.category(c) not in ("Cn", "Co", "Cs"))
    table = {c: form for c in chain(single, _clusters(letters)) if (form := cluster_form(c, letters)) != c}
    for c, form in table.items():  # a form must be final, and ASCII must stay as it is
        if c.isascii() or form != cluster_form(form, letters) or any(table.get(x, x) != x for x in (form, *form)):
            raise ValueError(f"conflict at {c!a}")
    return table


def transducer(table: dict[str, str]) -> Callable[[str], str]:
    """A function from a text to its form; ``table`` is what compiled_mapping gives."""
    import regex

    letters = look_alike_letters()
    widthless = "".join(f"{chr(a)}-{chr(b)}" for a, b in WIDTHLESS)
    follows = rf"\p{{M}}{widthless}{HALF_WIDTH_MARKS}"
    longest = regex.compile(rf"(?:[{SYLLABLES}][{follows}]*)?[{JAMO}][{JAMO}{follows}]*|[^{follows}]?[{follows}]+|[^\x00-\x7f]", regex.DOTALL)
    others: dict[str, str] = {}  # forms by rule, kept for when they come again

    def form_of(match) -> str:
        cluster = match.group()
        got = table.get(cluster) or others.get(cluster)
        if got is None:
            if len(cluster) == 1:
                return table.get(cluster, cluster)
            got = cluster_form(cluster, letters)
            if len(others) >= KEPT_CLUSTERS:
                others.clear()
            if len(cluster) <= 16:
                others[cluster] = got
        return got

    singles = str.maketrans({c: form for c, form in table.items() if len(c) == 1})
    joins = regex.compile(rf"[{JAMO}{follows}]").search

    def apply(text: str) -> str:
        if text.isascii():
            return text
        # Where nothing joins a base, every cluster is one character, and the same table maps all at once.
        return longest.sub(form_of, text) if joins(text) else text.translate(singles)

    return apply


def consistent_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, text: every text in its one form; null stays null, empty stays empty.

    Case, punctuation, accents present or missing, line breaks and the number of spaces stay as
    they are. Whole texts are mapped. An empty table gives no rows. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("value"))
    out = T.StructType([rows.schema["key"], T.StructField("form", T.StringType())])
    schema, table = to_arrow_schema(out), compiled_mapping()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = transducer(table)
        for batch in batches(it):
            forms = [None if t is None else apply(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], schema=schema)

    return rows.mapInArrow(run, out).select(F.col("key").alias(key), F.col("form").alias(text))


def look_alike_pairs(df: DataFrame, key: str, text: str, per_task: int = 20_000) -> DataFrame:
    """Columns a, b (a < b): keys of rows whose texts differ but have one form.

    Null and empty texts take no part. Only forms with several different texts are joined, the
    texts first and then the rows of two different texts; both are spread over as many salts as
    their number needs. An empty table gives no rows.
    """
    return met_rows(_marked(df, key, text), per_task).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, class_id, links: of every row with a text its class (the least key of its form) and the number of rows whose texts differ but look the same.

    As many rows as texts, however large a class is. Null and empty texts have none. Repeated rows
    count each. An empty table gives no rows.
    """
    marked = _marked(df, key, text)
    kinds = marked.groupBy("form", "as_is").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    forms = kinds.groupBy("form").agg(F.sum("n").alias("all"), F.min("least").alias("class_id"))
    of_text = kinds.join(forms, "form").select("as_is", "class_id", (F.col("all") - F.col("n")).alias("links"))
    return marked.select("key", "as_is").join(of_text, "as_is").select(F.col("key").alias(key), "class_id", "links")


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, as_is) of the rows with a text, as digests, written."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("value")).where("value is not null and value <> ''")
    out = T.StructType([rows.schema["key"], T.StructField("form", T.BinaryType()), T.StructField("as_is", T.BinaryType())])
    schema, table = to_arrow_schema(out), compiled_mapping()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        apply = transducer(table)
        for batch in batches(it):
            texts = batch.column(1).to_pylist()
            digest = lambda values: pa.array([blake2b(v.encode(), digest_size=20).digest() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digest(map(apply, texts)), digest(texts)], schema=schema)

    return Scratch(df.sparkSession, "lookalikes").written(rows.mapInArrow(run, out))


def met_rows(marked: DataFrame, per_task: int) -> DataFrame:
    """Columns x, y: keys of the rows (key, form, as_is) of two different texts with one form, each pair of rows once."""
    kinds = marked.groupBy("form", "as_is").agg(F.count(F.lit(1)).alias("n"))
    several = kinds.groupBy("form").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = several.select("form", F.ceil(F.col("kinds") / per_task).cast("int").alias("parts"))
    kinds = Scratch(marked.sparkSession, "lookalikes").written(kinds.join(several, "form").withColumn("salts", F.ceil(F.col("n") / per_task).cast("int")))

    def salts(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    # Of two texts the one with more rows has them dealt to its salts; the other's are copied to each.
    more = kinds.select("form", F.col("as_is").alias("text_x"), F.col("n").alias("n_x"), "salts", F.pmod(F.xxhash64("as_is"), F.col("parts")).cast("int").alias("part"))
    less = kinds.select("form", F.col("as_is").alias("text_y"), F.col("n").alias("n_y"), salts("parts").alias("part"))
    pairs = more.join(less, ["form", "part"]).where("n_x > n_y or n_x = n_y and text_x > text_y").select("text_x", "text_y", salts("salts").alias("salt"))
    copied = pairs.join(marked.select(F.col("as_is").alias("text_y"), F.col("key").alias("y")), "text_y").select("text_x", "salt", "y")
    members = marked.join(kinds.select("as_is", "salts"), "as_is")
    dealt = members.select(F.col("as_is").alias("text_x"), F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.col("key").alias("x"))
    return dealt.join(copied, ["text_x", "salt"]).select("x", "y")
