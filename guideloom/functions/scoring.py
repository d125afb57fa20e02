"""Best alignment of a query and a padded target, its score and details.

The ways to place up to ``max_indel`` indels along a query are the same for all queries of one
length. They are built once, and a whole Arrow batch of distinct pairs is then tested in numpy:
running counts of mismatches at each shift give the substitutions of every way from a few
look-ups, and only the ways within the edit budget are scored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

EVENTS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("q", T.StringType()), T.StructField("t", T.StringType())]))
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("details", EVENTS)])

# Fixed values of the score.
POSITION_WEIGHT = (0.0014, 0.0021, 0.3055)
INDEL_LOSS = (0.23, 0.01)
SUBSTITUTION_DIVISOR = {1: 1.0, 2: 1.8, 3: 1.8, 4: 4.0}
MANY_EVENTS = 1e-7
NEIGHBOUR_GAIN = 1.15
NO_POSITION = 99

OPS = ("del", "ins", "sub")  # in the order in which events are scored
DEL, INS, SUB = range(3)
CELLS = 4_000_000  # pairs times ways held at once
IMPOSSIBLE = 100  # mismatches that stand for a place beyond the target


def position_weight(place: int) -> float:
    a, b, c = POSITION_WEIGHT
    return a * place * place + b * place + c


def _after_event(z: float, before: int, op: int, place: int, n: int) -> float:
    """The product ``z`` after one more of n events."""
    if op != SUB:
        loss, slope = INDEL_LOSS
        z = z * (position_weight(place) - loss - place * slope) / n
    elif n > max(SUBSTITUTION_DIVISOR):
        z = MANY_EVENTS
    else:
        z = z * position_weight(place) / SUBSTITUTION_DIVISOR[n]
    return z * NEIGHBOUR_GAIN if abs(place - before) == 1 else z


class Ways(NamedTuple):
    """Ways to align a query of one length with indels, in the order that decides between equal scores."""

    indels: list[tuple[tuple[int, int], ...]]  # of each way (place from 1, op), in path order
    count: np.ndarray  # indels
    taken: np.ndarray  # target bases used
    shift: np.ndarray  # way x place: what is added to a query place for the target place
    deleted: np.ndarray  # way x place
    start: np.ndarray  # way x segment of one shift: bounds in the flat running counts
    stop: np.ndarray
    score: np.ndarray  # way x number of events: product over its indels
    last: np.ndarray  # place of the indel scored last


@lru_cache(maxsize=64)
def ways(length: int, max_indel: int, upstream: bool) -> Ways:
    """All ways for a query length; substitutions are not part of a way."""
    slots = [(place, op) for place in range(1, length + 1) for op in (INS, DEL)]  # insertions come before the base, at its position
    found = []
    for k in range(max_indel + 1):
        for way in combinations_with_replacement(slots, k):
            if all(a != b or a[1] == INS for a, b in zip(way, way[1:], strict=False)):
                moves = "".join("2" * way.count((p, INS)) + ("1" if (p, DEL) in way else "0") for p in range(1, length + 1))
                found.append((moves, way))
    found.sort()
    n, most = len(found), max(max_indel, 1)
    shift, deleted = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    start, stop = np.zeros((n, max_indel + 1), np.int64), np.zeros((n, max_indel + 1), np.int64)
    score, last = np.ones((n, most + 1)), np.full(n, NO_POSITION)
    for w, (_, way) in enumerate(found):
        for place, op in way:
            shift[w, place - (op == INS) :] += 1 if op == INS else -1
            if op == DEL:
                deleted[w, place - 1] = True
        bounds = [0, *(place - (op == INS) for place, op in way), length]
        for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            b = b - (s < len(way) and way[s][1] == DEL)  # the deleted base itself is compared with nothing
            if a < b:
                at = (int(shift[w, a]) + max_indel) * (length + 1)
                start[w, s], stop[w, s] = at + a, at + b
        for events in range(len(way), most + 1):
            z, before = 1.0, NO_POSITION
            for place, op in sorted(way, key=lambda e: (e[1], -e[0] if upstream else e[0])):
                z = _after_event(z, before, op, place, events)
                before = place
            score[w, events], last[w] = z, before
    indels = [way for _, way in found]
    count = np.array([len(x) for x in indels], dtype=np.int64)
    taken = np.array([length + sum(1 if op == INS else -1 for _, op in x) for x in indels], dtype=np.int64)
    return Ways(indels, count, taken, shift, deleted, start, stop, score, last)


def _characters(texts: list[str]) -> np.ndarray:
    """Row by row the characters as numbers, zeros after the end."""
    width = max(map(len, texts), default=0)
    return np.array(texts, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(texts), -1)


def _best_of_length(query: np.ndarray, target: np.ndarray, size: np.ndarray, max_indel: int, max_mismatch: int, upstream: bool) -> tuple[np.ndarray, ...]:
    """Of pairs with queries of one length, anchored at the start: the best score of each (nan: none), and the events as columns row, order, op, place, query and target base."""
    n, length = query.shape
    w = ways(length, max_indel, upstream)
    span = 2 * max_indel + 1
    wide = np.zeros((n, length + 2 * max_indel), np.uint32)
    wide[:, max_indel : max_indel + min(target.shape[1], length + max_indel)] = target[:, : length + max_indel]
    differs = np.empty((n, span, length), bool)
    counts = np.zeros((n, span, length + 1), np.int16)
    for s in range(span):
        at = np.arange(length) + s - max_indel
        out = (at < 0) | (at >= size[:, None])
        differs[:, s] = query != wide[:, s : s + length]
        np.cumsum(np.where(out, IMPOSSIBLE, differs[:, s]), axis=1, out=counts[:, s, 1:])
    flat = counts.reshape(n, -1)
    subs = np.zeros((n, len(w.count)), np.int16)
    for a, b in zip(w.start.T, w.stop.T, strict=True):
        subs += flat[:, b] - flat[:, a]
    allowed = np.where(w.count > 0, max_indel - w.count, max_mismatch)
    row, way = np.nonzero((subs <= allowed) & (w.taken <= size[:, None]))
    subs = subs[row, way].astype(np.int64)
    events = subs + w.count[way]
    score, before = w.score[way, np.where(w.count[way] > 0, events, 0)], w.last[way].copy()
    some = np.flatnonzero(subs > 0)
    z, last, total = score[some], before[some], events[some]
    divisor = np.array([1.0, *(SUBSTITUTION_DIVISOR.get(k, 1.0) for k in range(1, int(total.max(initial=1)) + 1))])[total]
    many = total > max(SUBSTITUTION_DIVISOR)
    for place in range(length, 0, -1) if upstream else range(1, length + 1):
        shift, gone = w.shift[way[some], place - 1], w.deleted[way[some], place - 1]
        here = np.flatnonzero(differs[row[some], shift + max_indel, place - 1] & ~gone)
        value = np.where(many[here], MANY_EVENTS, z[here] * position_weight(place) / divisor[here])
        z[here] = np.where(np.abs(place - last[here]) == 1, value * NEIGHBOUR_GAIN, value)
        last[here] = place
    score[some] = z

    # The first of the best, where the search ends at a score of exactly 1.
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(row))))
    ended = np.cumsum(score == 1.0) - (score == 1.0)
    in_reach = ended == ended[begins][group] if len(begins) else np.zeros(0, bool)
    ranked = np.where(in_reach, score, -np.inf)
    top = np.maximum.reduceat(ranked, begins)[group] if len(begins) else ranked
    at_top = np.flatnonzero(ranked == top)
    win = at_top[np.unique(group[at_top], return_index=True)[1]] if len(begins) else np.zeros(0, np.int64)
    best = np.full(n, np.nan)
    best[row[win]] = score[win]

    row, way = row[win], way[win]
    sub = differs[row[:, None], w.shift[way] + max_indel, np.arange(length)] & ~w.deleted[way]
    r, p = np.nonzero(sub)
    parts = [(row[r], 2 * p + 3, np.full(len(r), SUB), p + 1, query[row[r], p], wide[row[r], p + w.shift[way[r], p] + max_indel])]
    for k in range(max_indel):
        r = np.flatnonzero(w.count[way] > k)
        if not len(r):
            continue
        place, op = np.array([w.indels[x][k] for x in way[r]]).T
        inserted = np.array([sum(o == INS for _, o in w.indels[x][:k]) - sum(o == DEL for _, o in w.indels[x][:k]) for x in way[r]])
        is_ins = op == INS
        q = np.where(is_ins, ord("-"), query[row[r], place - 1])
        t = np.where(is_ins, wide[row[r], np.where(is_ins, place - 1 + inserted, 0) + max_indel], ord("-"))
        parts.append((row[r], 2 * place + ~is_ins, op, place, q, t))
    made = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts]), made[1], made[0]))  # insertions at one place in path order
    return best, *(x[order] for x in made)


def best_alignments(queries: list[str | None], targets: list[str | None], max_indel: int, max_mismatch: int, upstream: bool) -> pa.StructArray:
    """Score and events of the best alignment of each pair; null where there is none or a text is null.

    Alignments are anchored at the PAM's side; the rest of the target is free. Without indels up to
    ``max_mismatch`` substitutions are allowed; with indels, substitutions and indels together up
    to ``max_indel``. Of equal scores the first alignment counts, where a base is rather aligned
    than deleted, and rather deleted than put behind an insertion; after one of exactly 1 none does.
    ``upstream``: the anchored end is the right one, and positions are negative from it.
    """
    n = len(queries)
    score = np.full(n, np.nan)
    columns: list[list[np.ndarray]] = []
    lengths = np.array([-1 if q is None or t is None else len(q) for q, t in zip(queries, targets, strict=True)])
    for length in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == length)
        some = max(1, CELLS // len(ways(int(length), max_indel, upstream).count))
        for part in np.split(rows, range(some, len(rows), some)):
            turn = slice(None, None, -1) if upstream else slice(None)
            q = _characters([queries[i][turn] for i in part])[:, :length]
            t = [targets[i][turn] for i in part]
            best, row, _, *values = _best_of_length(q, _characters([x[: length + max_indel] for x in t]), np.array([len(x) for x in t]), max_indel, max_mismatch, upstream)
            score[part] = best
            columns.append([part[row], *values])
    row, op, place, q, t = (np.concatenate(x) for x in zip(*columns, strict=True)) if columns else [np.zeros(0, np.int64)] * 5
    order = np.argsort(row, kind="stable")
    if upstream and len(row):  # back into the order of the texts
        order = order[np.lexsort((-np.arange(len(order)), row[order]))]
    texts = lambda codes: pa.array(codes.astype(np.uint32).view("U1").tolist(), pa.string())
    event = pa.StructArray.from_arrays(
        [pa.array(OPS).take(pa.array(op[order])), pa.array((-place if upstream else place)[order], pa.int32()), texts(q[order]), texts(t[order])], names=["op", "pos", "q", "t"]
    )
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    missing = np.isnan(score)
    return pa.StructArray.from_arrays([pa.array(score, mask=missing), pa.ListArray.from_arrays(pa.array(offsets), event, mask=pa.array(missing))], names=["score", "details"])


def best_alignment_udf(max_indel: int, max_mismatch: int, upstream: bool):
    """An Arrow UDF (query, padded target) -> struct(score, details), of nulls where no alignment exists."""
    kind = to_arrow_type(RESULT)

    @F.arrow_udf(RESULT)
    def score(query: pa.Array, target: pa.Array) -> pa.Array:
        return best_alignments(query.to_pylist(), target.to_pylist(), max_indel, max_mismatch, upstream).cast(kind)

    return score


def score_text(value: float) -> str:
    """Twelve significant digits, with `.0` where neither point nor exponent shows."""
    text = f"{value:.12g}"
    return text if any(c in text for c in ".eE") or text in ("nan", "inf", "-inf") else text + ".0"


@F.pandas_udf(T.StringType())
def score_text_udf(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or pd.isna(v) else score_text(v) for v in values], dtype=object)


def details_json(details):
    """`[["sub",-20,"C","A"],...]` of an array of events, as a column."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    one = lambda e: F.concat(F.lit("["), F.concat_ws(",", quoted(e["op"]), e["pos"].cast("string"), quoted(e["q"]), quoted(e["t"])), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(details, one), ","), F.lit("]"))


def _event_distances(a: list[str], b: list[str], limit: int) -> np.ndarray:
    """Of pairs with at most ``limit`` plain edits: edits where an unbroken run of insertions and deletions counts once.

    One table for all pairs, as wide as ``limit`` places on both sides of the diagonal, and one walk back through it.
    """
    x, y = _characters(a), _characters(b)
    n, (size_a, size_b) = len(a), (np.array([len(t) for t in texts]) for texts in (a, b))
    rows = np.arange(n)
    high, width, far = int(size_a.max(initial=0)), 2 * limit + 1, 2 * limit + 2
    wide = np.zeros((n, max(high, y.shape[1]) + 2 * limit + 1), np.uint32)
    wide[:, limit : limit + y.shape[1]] = y
    cost = np.full((n, high + 1, width), far, np.int32)  # cost[:, i, k]: first i of a, first i + k - limit of b
    for i in range(high + 1):
        for k in range(width):
            j = i + k - limit
            if j < 0:
                continue
            best = np.full(n, 0 if i == j == 0 else far, np.int32)
            if i and j:
                best = np.minimum(best, cost[:, i - 1, k] + (x[:, i - 1] != wide[:, j - 1 + limit]))
            if i and k + 1 < width:
                best = np.minimum(best, cost[:, i - 1, k + 1] + 1)
            if k and j:
                best = np.minimum(best, cost[:, i, k - 1] + 1)
            cost[:, i, k] = best
    i, j, in_run, events = size_a.copy(), size_b.copy(), np.zeros(n, bool), np.zeros(n, np.int64)
    while (live := (i > 0) | (j > 0)).any():  # substitutions come before deletions, these before insertions
        k = np.clip(j - i + limit, 0, width - 1)
        here = cost[rows, i, k]
        differ = x[rows, np.maximum(i - 1, 0)] != wide[rows, np.maximum(j - 1, 0) + limit]
        diagonal = live & (i > 0) & (j > 0) & (here == cost[rows, np.maximum(i - 1, 0), k] + differ)
        gap = live & ~diagonal
        deletion = gap & (i > 0) & (k + 1 < width) & (here == cost[rows, np.maximum(i - 1, 0), np.minimum(k + 1, width - 1)] + 1)
        events += (diagonal & differ) | (gap & ~in_run)
        in_run = gap
        i, j = i - (diagonal | deletion), j - (diagonal | (gap & ~deletion))
    return events


def event_distance(a: Column, b: Column, limit: int) -> Column:
    """Edits where an unbroken run of insertions and deletions counts once; the plain edit distance if that is over ``limit``. Null for null."""
    plain = F.levenshtein(a, b)

    @F.arrow_udf(T.IntegerType())
    def events(a: pa.Array, b: pa.Array) -> pa.Array:
        known = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
        out = np.zeros(len(a), np.int32)
        texts = [x.take(pa.array(known)).to_pylist() for x in (a, b)]
        order = np.argsort([len(t) for t in texts[0]], kind="stable")
        begin = 0
        while begin < len(order):  # from short to long, as many at once as their table allows
            longest = len(texts[0][order[-1]])
            part = order[begin : begin + max(1, CELLS // ((longest + 1) * (2 * limit + 1)))]
            out[known[part]] = _event_distances(*([t[i] for i in part] for t in texts), limit)
            begin += len(part)
        return pa.array(out, mask=np.isin(np.arange(len(a)), known, invert=True))

    near = plain <= limit
    return F.when(near, events(F.when(near, a), F.when(near, b))).otherwise(plain)
