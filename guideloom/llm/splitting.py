"""Oversized sequences cut into overlapping pieces at natural boundaries (problem 2).

Method: dynamic programming over boundary positions. A state is the start of a piece; from it the
piece may end at any boundary inside the size window, or at the limit where the window holds none.
States are found from the left and solved from the right: the plan of a state is the least over
all ends of its first piece, joined with the plan of the state that follows, by the objective:
`leftmost` compares plans piece by piece (an unbroken cut first, then the longest piece, then the
plan of the rest); `total` adds up cut penalties and squared size imbalance over all pieces but the
last; `balanced` minimises this sum over all pieces, the last too, and over all places of cuts: cuts
between two boundaries are best in equal distances, so boundaries are still the only states.

Boundaries are found inside the JVM; only their distances travel to the tasks' Python, never the
sequences, so a very long sequence costs a short array.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "array<struct<piece_start:bigint,piece_end:bigint>>"


def best_pieces(length: int, cuts: list[int], max_size: int, min_size: int, overlap: int, objective: str) -> list[tuple[int, int]]:
    """Pieces (start, end) of a sequence with boundaries at the sorted positions ``cuts``."""
    target = (max_size + min_size) / 2
    ends: dict[int, list[tuple[int, int]]] = {}  # start -> (broken cut, end) of every first piece
    queue = [0]
    while queue:
        start = queue.pop()
        if start in ends:
            continue
        if length - start <= max_size:
            ends[start] = []  # the last piece
            continue
        inside = cuts[bisect_right(cuts, start + min_size) : bisect_right(cuts, start + max_size)]
        ends[start] = [(0, end) for end in inside] or [(1, start + max_size)]
        queue += [end - overlap for _, end in ends[start]]

    plan: dict[int, tuple] = {}  # start -> cost of its best plan (leftmost: of the first piece, and the next state), first end
    for start in sorted(ends, reverse=True):
        if not ends[start]:
            plan[start] = ((0, 0, 0) if objective == "leftmost" else 0.0, length)
        elif objective == "leftmost":
            # Different ends give first pieces of different length, so that no two plans are equal up to the rest.
            plan[start] = min(((broken, start - end, end - overlap), end) for broken, end in ends[start])
        else:
            plan[start] = min((broken + ((end - start - target) / target) ** 2 + plan[end - overlap][0], end) for broken, end in ends[start])
    pieces, start = [], 0
    while True:
        end = plan[start][1]
        pieces.append((start, end))
        if not ends[start]:
            return pieces
        start = end - overlap


def balanced_pieces(length: int, cuts: list[int], max_size: int, min_size: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) with the least sum of penalties (1 for a cut that is no boundary) and squared imbalance of all pieces.

    Takes time with the square of the number of boundaries, whatever the length.
    """
    if length <= max_size:
        return [(0, length)]
    target = (max_size + min_size) / 2
    most, least = max_size - overlap, min_size + 1 - overlap  # bases that a piece adds
    ends = np.array([c for c in cuts if c < length], dtype=np.int64)
    starts = np.concatenate([[0], ends - overlap])
    typical = math.hypot(target, target - overlap)

    def equal(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least cost, and number of pieces, where pieces as equal as can be add ``gain`` bases; the cost is convex in the number."""
        low, high = -(-gain // most), gain // least
        cost, number = np.full(len(gain), np.inf), np.zeros(len(gain), dtype=np.int64)
        for step in (-1, 0, 1, 2):
            k = np.maximum(np.clip((gain / typical).astype(np.int64) + step, low, np.maximum(low, high)), 1)
            size, longer = gain // k + overlap, gain % k
            now = (k - longer) * ((size - target) / target) ** 2 + longer * ((size + 1 - target) / target) ** 2 + k - 1
            better = (low <= high) & (now < cost)
            cost, number = np.where(better, now, cost), np.where(better, k, number)
        return cost, number

    best = np.full(len(starts), np.inf)
    best[0] = 0
    before, pieces_to = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    final: tuple[float, int, list[int]] = (math.inf, 0, [])
    for i, start in enumerate(starts.tolist()):
        if best[i] == math.inf:
            continue
        # To the end; there the last piece may be a short one.
        gain = length - start - overlap
        plans = [[gain]] if gain <= most else []
        (cost,), (k,) = equal(np.array([gain]))
        if cost < math.inf:
            plans.append(_shares(gain, int(k)))
        full = (gain - 1) // least
        if 0 < full and -(-gain // most) <= full + 1:
            plans.append([least] * full + [gain - full * least])
        for shares in plans:
            total = best[i] + len(shares) - 1 + sum(((x + overlap - target) / target) ** 2 for x in shares)
            if total < final[0]:
                final = (total, i, shares)
        # To every later boundary.
        first = int(np.searchsorted(ends, start + min_size, "right"))
        if first < len(ends):
            cost, k = equal(ends[first:] - start - overlap)
            better = best[i] + cost < best[first + 1 :]
            at = first + 1 + np.flatnonzero(better)
            best[at], before[at], pieces_to[at] = best[i] + cost[better], i, k[better]
    runs, i = [final[2]], final[1]
    while i:
        runs.append(_shares(int(ends[i - 1] - starts[before[i]] - overlap), int(pieces_to[i])))
        i = int(before[i])
    pieces, start = [], 0
    for share in (x for run in reversed(runs) for x in run):
        pieces.append((start, start + share + overlap))
        start += share
    return pieces


def _shares(gain: int, k: int) -> list[int]:
    """``gain`` in k whole numbers as equal as can be."""
    return [gain // k + 1] * (gain % k) + [gain // k] * (k - gain % k)


def boundary_distances(text: Column, gap_run: int) -> Column:
    """Lengths of the parts between ends of unbroken runs of at least ``gap_run`` N or n; their running sums are the boundaries."""
    return F.transform(F.split(text, f"(?<=[Nn]{{{gap_run}}})(?![Nn])", -1), lambda part: F.length(part))


def split_sequences(df: DataFrame, key: str, text: str, max_size: int = 6000, min_size: int = 3000, overlap: int = 50, gap_run: int = 10, objective: str = "leftmost", longer_than: int = 0, with_text: bool = False) -> DataFrame:
    """Columns key, piece_start, piece_end (exclusive) and, with_text, piece: pieces of every text longer than ``longer_than``.

    Every piece has at most ``max_size`` characters; each but the last is longer than ``min_size``;
    the next one starts ``overlap`` before the end of the one before. A text within the limit is
    one piece. Null and empty texts give no piece. Repeated rows are cut each. An empty table
    gives no rows. Other columns are not read.
    """
    if not 0 <= overlap < min_size < max_size:
        raise ValueError("0 <= overlap < min_size < max_size must hold")
    if objective not in ("leftmost", "total", "balanced"):
        raise ValueError(f"unknown objective {objective}")

    @F.pandas_udf(PIECES)
    def plan(lengths: pd.Series, distances: pd.Series) -> pd.Series:
        def one(length, parts):
            cuts = parts[:-1].cumsum().tolist()
            limits = int(length), cuts, max_size, min_size, overlap
            return [{"piece_start": a, "piece_end": b} for a, b in (balanced_pieces(*limits) if objective == "balanced" else best_pieces(*limits, objective))]

        return pd.Series([one(n, p) for n, p in zip(lengths, distances, strict=True)], dtype=object)

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("txt")).where(F.length("txt") > max(0, longer_than))
    planned = rows.withColumn("pieces", plan(F.length("txt"), boundary_distances(F.col("txt"), gap_run)))
    # Every text has a piece; the outer form spares a test for empty lists, which would run the plan twice.
    if not with_text:
        pieces = planned.select("key", F.inline_outer("pieces"))
    else:
        # Bytes are cut in constant time; texts with characters of several bytes are cut by character.
        plain = F.octet_length("txt") == F.length("txt")
        width = lambda p: p["piece_end"] - p["piece_start"]
        cut = F.transform(
            "pieces",
            lambda p: F.struct(
                p["piece_start"].alias("piece_start"),
                p["piece_end"].alias("piece_end"),
                F.when(plain, F.substring(F.col("txt").cast("binary"), (p["piece_start"] + 1).cast("int"), width(p).cast("int")).cast("string"))
                .otherwise(F.substring("txt", (p["piece_start"] + 1).cast("int"), width(p).cast("int")))
                .alias("piece"),
            ),
        )
        pieces = planned.select("key", F.inline_outer(cut))
    return pieces.withColumnRenamed("key", key)


def sites_in_pieces(sites: DataFrame, pieces: DataFrame, key: str, start: str, length: str, ident: str, bucket: int = 3000) -> DataFrame:
    """Columns ident, key, piece_start, piece_end: for each site the first piece that holds it whole.

    Sites meet pieces by key and position bucket, so a key with a third of all sites is spread over
    its length. Sites that no piece holds have null bounds; null keys or positions likewise.
    """
    covers = pieces.select(
        F.col(key).alias("p_key"), "piece_start", "piece_end", F.explode(F.sequence(F.expr(f"piece_start div {bucket}"), F.expr(f"(piece_end - 1) div {bucket}"))).alias("p_bucket")
    )
    at = sites.select(F.col(ident).alias("ident"), F.col(key).alias("key"), F.col(start).cast("long").alias("lo"), F.col(length).cast("long").alias("len"))
    at = at.withColumn("bucket", F.expr(f"lo div {bucket}"))
    held = (F.col("key") == F.col("p_key")) & (F.col("bucket") == F.col("p_bucket")) & (F.col("lo") >= F.col("piece_start")) & (F.col("lo") + F.col("len") <= F.col("piece_end"))
    joined = at.join(covers, held, "left")
    first = joined.groupBy("ident", "key").agg(F.min("piece_start").alias("piece_start"), F.min("piece_end").alias("piece_end"))
    return first.select(F.col("ident").alias(ident), F.col("key").alias(key), "piece_start", "piece_end")
