"""Column expressions on nucleotide strings; all but dust_score run inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"
#: Bits 0, 2, 4 ... of a 64-bit code: one per base.
LOW_BITS = 0x5555555555555555
#: Code of each byte; -1 for other characters.
BASE_CODES = np.full(256, -1, dtype=np.int64)
BASE_CODES[[ord(c) for c in BASES]] = range(4)
PAIRED = {"A": "T", "C": "G", "G": "C", "T": "A"}


def reverse_complement(seq: Column) -> Column:
    """A<->T, C<->G, any other character N, read backwards. Upper case in, upper case out."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def reverse_complement_pam(pam: str) -> str:
    """Like reverse_complement, for a pattern: codes of several bases become N."""
    return "".join(PAIRED.get(c, "N") for c in reversed(pam.upper()))


def pam_regex(pam: str) -> str:
    """A pattern's regular expression: N stands for any character, all else for itself."""
    return "".join("." if c == "N" else f"\\Q{c}\\E" for c in pam.upper())


@F.arrow_udf(T.LongType())
def dust_score(seq: pa.Array) -> pa.Array:
    """Sum over the 64 trinucleotides of c (c - 1) / 2; triples with other characters count nothing. Null for null.

    All triples of a batch are counted in one numpy pass. Higher-order column functions give the
    same but are interpreted per triple: 95 against about 1 microsecond a site of 20 bases.
    """
    n = len(seq)
    text = seq.cast(pa.large_string())
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    codes = BASE_CODES[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if data is not None else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    inside = (np.minimum(np.minimum(first, second), third) >= 0) & (row[:-2] == row[2:]) if len(codes) > 2 else np.zeros(0, bool)
    which = row[: len(inside)][inside] * 64 + (first * 16 + second * 4 + third)[inside] if len(inside) else np.zeros(0, np.int64)
    counts = np.bincount(which, minlength=64 * n).reshape(n, 64)
    return pa.array((counts * (counts - 1) // 2).sum(axis=1), pa.int64(), mask=seq.is_null().to_numpy(zero_copy_only=False))


def code_2bit(seq: Column) -> Column:
    """A 0, C 1, G 2, T 3, two bits each from the left; any other character counts as A. At most 32 bases; longer gives null.

    The value is the unsigned code's bits in a signed 64-bit integer.
    """
    number = lambda base: F.greatest(F.position(base, F.lit(BASES)) - 1, F.lit(0)).cast("long")
    joined = F.aggregate(F.split(seq, ""), F.lit(0).cast("long"), lambda code, base: F.shiftleft(code, 2).bitwiseOR(number(base)))
    return F.when(F.length(seq) <= 32, joined)


def strict_code(seq: Column) -> Column:
    """code_2bit for one to 32 plain bases, else null."""
    return F.when(seq.rlike("^[ACGT]{1,32}$"), code_2bit(seq))


def channel(seq: Column, base: str) -> Column:
    """One bit per character, set where it is ``base``; the first character is the highest bit. At most 32 characters."""
    bits = F.translate(F.regexp_replace(seq, f"[^{base}]", "0"), base, "1")
    return F.when(F.length(seq) <= 32, F.coalesce(F.conv(bits, 2, 10).cast("long"), F.lit(0).cast("long")))


def code_distance(a: Column, b: Column) -> Column:
    """Number of different bases of two codes of one length."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_BITS)))


def hamming(a: Column, b: Column) -> Column:
    """Number of different characters; -1 if the lengths differ."""
    places = F.sequence(F.lit(1), F.length(a))
    different = F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(F.length(a) != F.length(b), -1).when(F.length(a) == 0, 0).otherwise(different)


def base_number(base: Column) -> Column:
    """A 0, C 1, G 2, T 3, other characters -1."""
    return F.when(F.length(base) == 1, F.position(base, F.lit(BASES)) - 1).otherwise(-1)


def base_counts(seq: Column) -> list[Column]:
    """Number of A, C, G and T."""
    return [(F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit("")))).alias(f"n_{b.lower()}") for b in BASES]


def right_anchored_distance(q: Column, t: Column, limit: int) -> Column:
    """Edit distance with a free prefix of up to ``limit`` characters in either string, exact up to ``limit``; above it null.

    The least of the plain distance and those with 1 to limit leading characters of one side left out.
    """
    terms = [F.levenshtein(q, t, limit)]
    for k in range(1, limit + 1):
        terms.append(F.levenshtein(q.substr(F.lit(k + 1), F.length(q)), t, limit))
        terms.append(F.levenshtein(q, t.substr(F.lit(k + 1), F.length(t)), limit))
    far = 1 << 20  # takes the place of -1, which a term over the limit gives
    return F.nullif(F.least(*(F.pmod(x, F.lit(far + 1)) for x in terms)) if len(terms) > 1 else F.pmod(terms[0], F.lit(far + 1)), F.lit(far))


def site_name(chrom: Column, start0: Column, length: Column, is_reverse: Column) -> Column:
    """`chrom:start-end:strand` with positions from 1, both ends included."""
    return F.concat(chrom, F.lit(":"), (start0 + 1).cast("string"), F.lit("-"), (start0 + length).cast("string"), F.when(is_reverse, ":-").otherwise(":+"))


NAME_PATTERN = r"^(.*):(\d+)-(\d+):([+-])$"


def parsed_name(name: Column) -> list[Column]:
    """chrom, start, end (from 1) and is_reverse of a site name, read from the right; null where it is none, and for numbers over 64 bits.

    One pass splits the name; bind the columns before filters use them, see ``bound``.
    """
    parts = F.when(name.rlike(NAME_PATTERN), F.split(F.regexp_replace(name, NAME_PATTERN, "$2\u0001$3\u0001$4\u0001$1"), "\u0001", 4))
    return [F.nullif(parts[3], F.lit("")).alias("chrom"), parts[0].try_cast("long").alias("start_1based"), parts[1].try_cast("long").alias("end_1based"), (parts[2] == "-").alias("is_reverse")]


def bound(*columns: Column) -> Column:
    """The columns as a generator of one row: filters on them stay above, so that each is computed once."""
    return F.inline(F.array(F.struct(*columns)))
