"""PAM-adjacent sites of a genome.

Contigs are cut into tiles with a halo, so that a chromosome in one row is spread over many tasks;
a tile owns the matches that start in it, which gives each site once. Positions are exploded and
tested on the tile's bytes in one pass inside the JVM; only sites leave it. Nothing is shuffled
but the tiles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guideloom.functions.sequences import dust_score, pam_regex, reverse_complement, reverse_complement_pam, site_name
from guideloom.params import SearchParams

TILE = 1 << 14
#: Bases in a task of sites_by_name().
TASK_BASES = 1 << 17

# Codes of several bases.
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
IUPAC_PAIRED = dict(zip("RYSWKMBDHV", "YRSWMKVHDB", strict=True))


def genome(df: DataFrame, ident: str = "chrom_idx", name: str = "chrom_name", sequence: str = "chrom_sequence") -> DataFrame:
    """(chrom_idx, chrom, seq, len): contigs with a sequence, in upper case. Null and empty sequences have no sites and give no row."""
    rows = df.select(F.col(ident).cast("long").alias("chrom_idx"), F.col(name).alias("chrom"), F.upper(sequence).alias("seq"))
    return rows.where("seq <> ''").withColumn("len", F.length("seq").cast("long"))


def tiles(contigs: DataFrame, halo: int, tile: int = TILE, spread: bool = True, tasks: int | None = None) -> DataFrame:
    """(chrom_idx, chrom, len, tile_no, origin, bytes): overlapping tiles; ``origin`` is the position of the first byte.

    With ``tasks``, tiles of one number of the contigs of one name follow each other in one of so many tasks.
    """
    count = F.ceil(F.col("len") / tile).cast("int")
    cut = contigs.select("chrom_idx", "chrom", "len", F.col("seq").cast("binary").alias("all"), F.explode(F.sequence(F.lit(0), count - 1)).alias("tile_no"))
    start = F.col("tile_no").cast("long") * tile
    origin = F.greatest(start - halo, F.lit(0))
    cut = cut.select(
        "chrom_idx", "chrom", "len", "tile_no", start.alias("start"), origin.alias("origin"),
        F.substring("all", (origin + 1).cast("int"), (start - origin + tile + halo).cast("int")).alias("bytes"),
    )
    if tasks:
        place = ["chrom", F.when(F.col("chrom").isNotNull(), F.col("tile_no"))]
        return cut.repartition(tasks, *place).sortWithinPartitions(*place)
    if not spread:
        return cut
    # Partitions are cut and joined by size, so their number grows with the genome.
    return cut.hint("rebalance", "chrom_idx", "tile_no")


def _pattern(pam: str, iupac: bool) -> str:
    if not iupac:
        return pam_regex(pam)
    return "".join(f"[{IUPAC[c]}]" if c in IUPAC else pam_regex(c) for c in pam.upper())


def _reverse_pattern(pam: str, iupac: bool) -> str:
    if not iupac:
        return pam_regex(reverse_complement_pam(pam))
    return "".join(f"[{IUPAC[IUPAC_PAIRED[c]]}]" if c in IUPAC else pam_regex(reverse_complement_pam(c)) for c in reversed(pam.upper()))


def _matches(slice_at: Callable[[Column, int], Column], pams: list[str], iupac: bool, reverse: bool) -> Column:
    """Whether one of the patterns, all of one length, stands at ``at``: literal bases are compared as bytes, codes of several bases by expression."""
    at, size = F.col("at"), len(pams[0])
    if iupac and any(c in IUPAC for pam in pams for c in pam.upper()):
        make = _reverse_pattern if reverse else _pattern
        return slice_at(at, size).cast("string").rlike("^(?:" + "|".join(make(p, iupac) for p in pams) + ")$")
    by_place: dict[tuple[tuple[int, int], ...], list[list[bytes]]] = {}
    for pam in pams:
        text = reverse_complement_pam(pam) if reverse else pam.upper()
        runs = [m.span() for m in re.finditer("[^N]+", text)]
        by_place.setdefault(tuple(runs), []).append([text[a:b].encode() for a, b in runs])
    hit = F.lit(False)
    for runs, texts in by_place.items():
        if len(runs) == 1:
            (a, b), = runs
            hit |= slice_at(at + a, b - a).isin(*(t[0] for t in texts))
        else:
            for text in texts:
                same = F.lit(True)
                for (a, b), part in zip(runs, text, strict=True):
                    same &= slice_at(at + a, b - a) == F.lit(part)
                hit |= same
    return hit


def _sites_of_length(tiled: DataFrame, pams: list[str], params: SearchParams, tile: int) -> DataFrame:
    """Sites of patterns of one length."""
    size, length = len(pams[0]), params.spacer_length
    # A last tile shorter than the pattern has no place of its own: a sequence would run backwards into the tile before.
    places = tiled.where(F.col("start") + size <= F.col("len")).select(
        "chrom_idx", "chrom", "len", "origin", "bytes", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + tile, F.col("len") - size + 1) - 1)).alias("at")
    )

    def slice_at(position: Column, n: int) -> Column:
        return F.substring("bytes", (position - F.col("origin") + 1).cast("int"), F.lit(n))

    plus, minus = (_matches(slice_at, pams, params.iupac, reverse) for reverse in (False, True))
    before, after = F.col("at") - length, F.col("at") + size
    left, right = (before, after) if params.upstream else (after, before)
    # Most places match on no strand and go no further.
    hits = places.withColumns({"plus": plus, "minus": minus}).where("plus or minus")
    sides = F.array(F.struct(F.lit(False).alias("is_reverse"), left.alias("start0"), F.col("plus").alias("hit")), F.struct(F.lit(True).alias("is_reverse"), right.alias("start0"), F.col("minus").alias("hit")))
    found = hits.select("chrom_idx", "chrom", "len", "origin", "bytes", F.inline(sides)).where(F.col("hit") & (F.col("start0") >= 0) & (F.col("start0") + length <= F.col("len")))
    # The generators bind each sequence once: filters on it can't move below them, where rows still hold their tile.
    bound = found.select("chrom_idx", "chrom", "start0", "is_reverse", F.inline(F.array(F.struct(slice_at(F.col("start0"), length).cast("string").alias("forward")))))
    oriented = F.when(F.col("is_reverse"), reverse_complement(F.col("forward"))).otherwise(F.col("forward"))
    return bound.select("chrom_idx", "chrom", "start0", F.lit(length).alias("length"), "is_reverse", F.inline(F.array(F.struct(oriented.alias("seq")))))


def extract_sites(contigs: DataFrame, params: SearchParams, both_pams: bool, dust: bool = True, tile: int = TILE, spread: bool = True, tasks: int | None = None) -> DataFrame:
    """(chrom_idx, chrom, start0, length, is_reverse, seq, name): sites beside the PAM and, with both_pams, beside the alternative.

    ``contigs`` is what genome() gives. Coordinates are forward ones, from 0; ``seq`` is oriented.
    A place that matches both patterns of one length is one site. N is allowed inside a site and
    matches only an N of the pattern. With ``dust``, sites over the threshold are left out.
    """
    pams = [params.pam] + ([params.alt_pam] if both_pams and params.alt_pam else [])
    halo = params.spacer_length + max(map(len, pams))
    tiled = tiles(contigs, halo, tile, spread, tasks)
    by_length: dict[int, list[str]] = {}
    for pam in pams:
        by_length.setdefault(len(pam), []).append(pam)
    groups = [_sites_of_length(tiled, group, params, tile) for group in by_length.values()]
    sites = groups[0] if len(groups) == 1 else groups[0].unionByName(groups[1])
    if dust:
        sites = sites.where(dust_score(F.col("seq")) <= params.dust_threshold)
    return sites.withColumn("name", site_name(F.col("chrom"), F.col("start0"), F.col("length"), F.col("is_reverse")))


def sites_by_name(contigs: DataFrame, params: SearchParams, both_pams: bool, tile: int = TILE, task_bases: int = TASK_BASES) -> DataFrame:
    """(name, seq, chrom_idx, part): the sites of extract_sites(), those of one name all in one task, where rows of one ``part`` follow each other.

    Contigs of one name have sites of one name in tiles of one number, so that only tiles need to meet. Patterns must be of one length.
    """
    pams = {params.pam, *([params.alt_pam] if both_pams and params.alt_pam else [])}
    if len({len(pam) for pam in pams}) > 1:
        raise ValueError("patterns must be of one length")
    bases = contigs.agg(F.sum("len").alias("n")).first()["n"] or 0
    sites = extract_sites(contigs, params, both_pams, tile=tile, tasks=1 + bases // task_bases)
    ahead = F.col("is_reverse") != F.lit(params.upstream)
    at = F.when(ahead, F.col("start0") + F.col("length")).otherwise(F.col("start0") - len(params.pam))
    part = F.when(F.col("chrom").isNotNull(), F.xxhash64("chrom", F.floor(at / tile)))
    return sites.select("name", "seq", "chrom_idx", F.coalesce(part, F.lit(0).cast("long")).alias("part"))


def slices(wanted: DataFrame, contigs: DataFrame, tile: int = TILE) -> DataFrame:
    """``wanted`` (item, chrom, lo, hi, need) -> (item, seq): forward bases lo..hi (from 0, end exclusive) of the contig named chrom.

    Rows meet tiles, not contigs: a contig that a third of all rows look at is spread over its
    tiles. A name held by several contigs means the one with the largest chrom_idx. A contig
    shorter than ``need``, and an unknown one, give no row; bases beyond its end are left out.
    Items must be unique.
    """
    last = contigs.groupBy(F.col("chrom").alias("l_chrom")).agg(F.max("chrom_idx").alias("look_idx"))  # names and numbers only
    parts = tiles(contigs, 0, tile, spread=False).select("chrom_idx", "tile_no", "origin", "bytes", "len")
    looks = wanted.where("0 <= lo and lo < hi").join(last, F.col("chrom") == F.col("l_chrom"))
    looks = looks.select("item", "look_idx", "lo", "hi", "need", F.explode(F.sequence(F.expr(f"int(lo div {tile})"), F.expr(f"int((hi - 1) div {tile})"))).alias("look"))
    met = looks.join(parts, (F.col("look_idx") == F.col("chrom_idx")) & (F.col("look") == F.col("tile_no"))).where("need <= len")
    first = F.greatest(F.col("lo") - F.col("origin"), F.lit(0))
    part = F.substring("bytes", (first + 1).cast("int"), (F.least(F.col("hi") - F.col("origin"), F.lit(tile)) - first).cast("int")).cast("string")
    # The generator binds the part, so that no row with its tile goes on to the aggregation.
    cut = met.select("item", "tile_no", F.inline(F.array(F.struct(part.alias("part")))))
    whole = cut.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("tile_no", "part"))).alias("parts"))
    return whole.select("item", F.array_join(F.col("parts.part"), "").alias("seq"))
