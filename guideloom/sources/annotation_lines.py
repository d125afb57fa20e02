"""Annotation lines (GFF3/GTF): valid records loaded, failing lines kept apart with the reason (problem 3).

Method: structural indexing. The lines of a batch are one byte buffer; numpy masks of tabs, quotes
and separators, prefix counts of unescaped quotes and their parity locate the fields, the
attributes and the record ends of all lines at once, without a loop over lines. Count and type
checks on these positions turn each line into a valid row or a reject row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guideloom.plans.ordering import batches

# Fixed values of the format.
COLUMNS = 9
LARGEST_COORDINATE = 4294967295
LONGEST_NUMBER = len(str(LARGEST_COORDINATE))
ID_FEATURES = ("gene", "mrna", "transcript")
REASONS = ("columns", "quoting", "coordinates", "phase", "id")

TAB, NEWLINE, RETURN, SPACE, QUOTE, HASH, DOT, SEMICOLON, EQUALS, BACKSLASH = (ord(c) for c in '\t\n\r "#.;=\\')
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[SPACE, TAB, NEWLINE, RETURN, 11, 12]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

RECORD = T.StructType(
    [T.StructField("line_no", T.LongType()), T.StructField("reason", T.StringType())]
    + [T.StructField(x, T.StringType()) for x in ("seqid", "source", "feature")]
    + [T.StructField(x, T.LongType()) for x in ("start_1based", "end_1based")]
    + [T.StructField("score", T.StringType()), T.StructField("strand", T.StringType()), T.StructField("phase", T.IntegerType())]
    + [T.StructField(x, T.StringType()) for x in ("attributes", "line", "file_name")]
)


class LineIndex:
    """Positions of the structure in a buffer of records, each given by its start and end byte."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data = np.append(data, np.uint8(NEWLINE))  # a byte that is always there to look at
        self.start = start
        self.end = end - ((end > start) & (self.data[np.maximum(end - 1, 0)] == RETURN))
        text = self.data
        n = len(text)
        self.nonblank = self.prefix(~BLANKS[text])
        quotes = np.flatnonzero(text == QUOTE)
        quotes = quotes[(quotes == 0) | (text[quotes - 1] != BACKSLASH)]
        mask = np.zeros(n, dtype=bool)
        mask[quotes] = True
        self.quotes = self.prefix(mask)
        self.tabs = np.flatnonzero(text == TAB)
        self.semicolons = np.flatnonzero(text == SEMICOLON)
        zero = text == 48
        self.zero_runs = np.flatnonzero(zero[:-1] & ~zero[1:])  # last places of runs of zeros

    @staticmethod
    def prefix(mask: np.ndarray) -> np.ndarray:
        """Count of set bytes before each position."""
        out = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    def records(self) -> np.ndarray:
        """Mask of lines that are neither blank nor start with `#`."""
        blank = self.nonblank[self.end] == self.nonblank[self.start]
        return ~blank & (self.data[self.start] != HASH)

    def fields(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines ``which``: the number of tabs, and for those with nine columns the fields' bounds."""
        first = np.searchsorted(self.tabs, self.start[which])
        count = np.searchsorted(self.tabs, self.end[which]) - first
        good = count == COLUMNS - 1
        at = self.tabs[first[good][:, None] + np.arange(COLUMNS - 1)] if good.any() else np.zeros((0, COLUMNS - 1), np.int64)
        lo = np.column_stack([self.start[which][good], at + 1])
        hi = np.column_stack([at, self.end[which][good]])
        return count, lo, hi

    def number(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Value of fields of digits only; -1 for any other, and for values over ten digits."""
        ends = self.zero_runs
        zeros = (hi > lo) & (self.data[np.minimum(lo, len(self.data) - 1)] == 48)
        first = np.where(zeros, np.minimum(ends[np.minimum(np.searchsorted(ends, lo), len(ends) - 1)] + 1, hi), lo) if len(ends) else lo  # behind leading zeros
        good = (hi > lo) & (hi - first <= LONGEST_NUMBER)
        value = np.zeros(len(lo), dtype=np.int64)
        for k in range(LONGEST_NUMBER):
            live = good & (first + k < hi)
            byte = self.data[np.where(live, first + k, 0)].astype(np.int64)
            good &= ((byte >= 48) & (byte <= 57)) | ~live
            value = np.where(live, value * 10 + (byte - 48), value)
        return np.where(good, value, -1)

    def equals(self, lo: np.ndarray, hi: np.ndarray, word: str) -> np.ndarray:
        """Mask of fields that are ``word`` in any case of letters."""
        same = hi - lo == len(word)
        for k, c in enumerate(word.encode()):
            same &= LOWER[self.data[np.minimum(lo + k, len(self.data) - 1)]] == c
        return same

    def has_id(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Mask of attribute fields whose first attribute named exactly ID has a value."""
        row_of = np.searchsorted(lo, self.semicolons, "right") - 1
        inside = (row_of >= 0) & (self.semicolons < hi[np.maximum(row_of, 0)])
        at, row = self.semicolons[inside], row_of[inside]
        free = (self.quotes[at] - self.quotes[lo[row]]) % 2 == 0
        at, row = at[free], row[free]
        begins = np.concatenate([lo, at + 1])
        rows = np.concatenate([np.arange(len(lo)), row])
        order = np.lexsort((begins, rows))
        begins, rows = begins[order], rows[order]
        ends = np.where(np.append(rows[1:] != rows[:-1], True), hi[rows], np.append(begins[1:] - 1, 0))
        # The name begins at the first byte that is not blank.
        nonblank_at = np.flatnonzero(~BLANKS[self.data])
        k = self.nonblank[begins]
        name = np.where(k < len(nonblank_at), nonblank_at[np.minimum(k, max(0, len(nonblank_at) - 1))] if len(nonblank_at) else 0, len(self.data) - 1)
        top = len(self.data) - 1
        after = self.data[np.minimum(name + 2, top)]
        named = (name + 2 <= ends) & (self.data[np.minimum(name, top)] == ord("I")) & (self.data[np.minimum(name + 1, top)] == ord("D"))
        named &= (name + 2 == ends) | (after == EQUALS) | BLANKS[after]
        value_from = np.minimum(name + 3, ends)
        solid = self.prefix(~BLANKS[self.data] & (self.data != QUOTE))
        filled = solid[np.maximum(ends, value_from)] > solid[value_from]
        found = np.flatnonzero(named)
        rows_found, first = np.unique(rows[found], return_index=True)
        result = np.zeros(len(lo), dtype=bool)
        result[rows_found] = filled[found[first]]
        return result

    def texts(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """The fields as strings."""
        width = hi - lo
        offsets = np.concatenate(([0], np.cumsum(width)))
        source = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], width)
        return pa.StringArray.from_buffers(len(lo), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[source]))


def _classify(index: LineIndex, strict: bool = True) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray]:
    """Of the buffer's records: their lines, reason numbers (-1: valid), field bounds of those with nine columns and their mask."""
    which = np.flatnonzero(index.records())
    count, lo, hi = index.fields(which)
    nine = count == COLUMNS - 1
    reason = np.full(len(which), 0, dtype=np.int64)
    if nine.any():
        odd = (index.quotes[hi[:, 8]] - index.quotes[lo[:, 8]]) % 2 == 1
        start, end = index.number(lo[:, 3], hi[:, 3]), index.number(lo[:, 4], hi[:, 4])
        place = (start < 1) | (end < 1) | (start > LARGEST_COORDINATE) | (end > LARGEST_COORDINATE) | (start > end)
        one = hi[:, 7] - lo[:, 7] == 1
        byte = index.data[lo[:, 7]]
        cds = index.equals(lo[:, 2], hi[:, 2], "cds")
        phase = ~(one & (((byte >= 48) & (byte <= 50)) | ((byte == DOT) & ~(cds & strict))))
        no_id = np.zeros(len(lo), dtype=bool)
        if strict:
            for word in ID_FEATURES:
                no_id |= index.equals(lo[:, 2], hi[:, 2], word)
            no_id &= ~index.has_id(lo[:, 8], hi[:, 8])
        reason[nine] = np.select([odd, place, phase, no_id], [1, 2, 3, 4], -1)
    return which, reason, (lo, hi), nine


def _parse(schema: pa.Schema, strict: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            line_no, line, file_name = batch.columns
            known = np.flatnonzero(~line.is_null().to_numpy(zero_copy_only=False))
            if not len(known):
                continue
            keep = pa.array(known)
            line_no, line, file_name = line_no.take(keep), line.take(keep).cast(pa.large_string()), file_name.take(keep)
            _, offsets, data = line.buffers()
            bounds = np.frombuffer(offsets, np.int64)[line.offset : line.offset + len(line) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            index = LineIndex(data[bounds[0] : bounds[-1]], bounds[:-1] - bounds[0], bounds[1:] - bounds[0])
            which, reason, (lo, hi), nine = _classify(index, strict)
            if not len(which):
                continue
            ok = reason == -1
            lo, hi = lo[ok[nine]], hi[ok[nine]]
            place = np.full(len(which), -1)
            place[ok] = np.arange(len(lo))
            spread = pa.array(place, mask=~ok)  # null where the record is rejected

            def column(k: int, index=index, lo=lo, hi=hi, spread=spread) -> pa.Array:
                return index.texts(lo[:, k], hi[:, k]).take(spread)

            numbers = [pa.array(index.number(lo[:, k], hi[:, k])).take(spread) for k in (3, 4)]
            byte = index.data[lo[:, 7]].astype(np.int64) - 48
            phase = pa.array(byte.astype(np.int32), mask=byte < 0).take(spread)
            said = pa.array(np.array([*REASONS, ""], dtype=object)[reason], pa.string(), mask=ok)
            lines = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [line_no.take(lines), said, column(0), column(1), column(2), *numbers, column(5), column(6), phase, column(8), line.take(lines).cast(pa.string()), file_name.take(lines)],
                schema=schema,
            )

    return run


def parse_annotation_lines(df: DataFrame, line_no: str = "line_no", line: str = "line", file_name: str = "file_name", strict: bool = True) -> DataFrame:
    """One row per record line: parsed columns where it is valid, else ``reason`` (the first that applies of REASONS).

    One return character at a line's end is dropped first. Null and blank lines and lines that
    start with `#` hold no record and give no row. Repeated lines are parsed each. Valid rows
    have a null ``reason``; reject rows have null parsed columns; ``line`` is as delivered.
    A `.` phase is null. Without ``strict`` genes and transcripts need no ID, and a CDS may have a
    `.` phase, as in GTF files. An empty table gives no rows. Other columns are not read.
    """
    rows = df.select(F.col(line_no).cast("long").alias("line_no"), F.col(line).cast("string").alias("line"), F.col(file_name).cast("string").alias("file_name"))
    return rows.mapInArrow(_parse(to_arrow_schema(RECORD), strict), RECORD)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("line_no", "reason", "line", "file_name")


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason", "line")
