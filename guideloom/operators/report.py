"""The HTML report as lines in order, and progress events.

The report is a DataFrame of lines under a global sort: summary first, then each query's rows. It
is written by all executors as text files whose concatenation is the page; nothing passes through
the driver, however many rows a query has.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guideloom.functions.scoring import score_text_udf
from guideloom.operators.hits import query_summary

SUMMARY_CELLS = ["query_name", "total", "exact", "mismatch", "indel", "uniq", "success_rate"]
DETAIL_CELLS = ["query_name", "query_seq", "target_name", "target_seq", "distance", "search_type", "genomic_frequency", "score", "details"]


def html_escaped(text: Column) -> Column:
    """Text for HTML; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):  # fixed values
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def anchor(name: Column) -> Column:
    """A short id for a query's section."""
    return F.concat(F.lit("q"), F.hex(F.xxhash64(name)))


def _row(cells: list[Column], tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells), F.lit("</tr>"))


def report_lines(scored: DataFrame, title: str = "Off-target report") -> DataFrame:
    """(part, uniq, query_name, rank, value), sorted: lines of the page. Rows without a query name are not in the report."""
    summary = query_summary(scored)
    key = ["part", "uniq", "query_name", "rank", "value"]

    def fixed(part: int, text: str) -> DataFrame:
        spark = scored.sparkSession
        return spark.range(1).select(F.lit(part).alias("part"), F.lit(None).cast("long").alias("uniq"), F.lit(None).cast("string").alias("query_name"), F.lit(0).alias("rank"), F.lit(text).alias("value"))

    linked = F.concat(F.lit('<a href="#'), anchor(F.col("query_name")), F.lit('">'), html_escaped(F.col("query_name")), F.lit("</a>"))
    cells = [linked, *(html_escaped(F.col(c)) for c in SUMMARY_CELLS[1:])]
    top = summary.select(F.lit(1).alias("part"), "uniq", "query_name", F.lit(0).alias("rank"), _row(cells).alias("value"))
    heads = summary.select(F.lit(3).alias("part"), "uniq", "query_name", F.lit(0).alias("rank"), F.concat(F.lit('<tr id="'), anchor(F.col("query_name")), F.lit('"><th colspan="9">'), html_escaped(F.col("query_name")), F.lit("</th></tr>")).alias("value"))
    uniq = summary.select(F.col("query_name").alias("s_name"), "uniq")
    body = scored.join(uniq, F.col("query_name") == F.col("s_name"))
    shown = [html_escaped(score_text_udf("score") if c == "score" else F.col(c)) for c in DETAIL_CELLS]
    rows = body.select(F.lit(3).alias("part"), "uniq", "query_name", F.lit(1).alias("rank"), _row(shown).alias("value"))
    head = "<!doctype html><meta charset=utf-8><title>" + title + "</title><h1>" + title + "</h1><table><tr>" + "".join(f"<th>{c}</th>" for c in SUMMARY_CELLS) + "</tr>"
    middle = "</table><table><tr>" + "".join(f"<th>{c}</th>" for c in DETAIL_CELLS) + "</tr>"
    lines = fixed(0, head).unionByName(top).unionByName(fixed(2, middle)).unionByName(heads).unionByName(rows).unionByName(fixed(4, "</table>"))
    return lines.orderBy(*key)


def write_report(scored: DataFrame, path: str, title: str = "Off-target report") -> None:
    """Text files in order in ``path``; concatenated they are the page."""
    report_lines(scored, title).select("value").write.mode("overwrite").text(path)


class Progress:
    """Progress events as text or JSON lines."""

    def __init__(self, write: Callable[[str], None] = print, as_json: bool = False):
        self.write, self.as_json = write, as_json
        self._began: dict[str, float] = {}

    def event(self, event: str, **values) -> None:
        stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        self.write(json.dumps({"event": event, **values, "ts": stamp}) if self.as_json else f"{stamp} {event} " + " ".join(f"{k}={v}" for k, v in values.items()))

    def step(self, ident: str, title: str):
        """Context manager: step_start and step_done, or error, around a step."""
        progress = self

        class Step:
            def __enter__(self):
                progress._began[ident] = time.monotonic()
                progress.event("step_start", id=ident, title=title)

            def __exit__(self, kind, error, _):
                if error is None:
                    progress.event("step_done", id=ident, seconds=round(time.monotonic() - progress._began[ident], 3))
                else:
                    progress.event("error", message=str(error)[:500])

        return Step()
