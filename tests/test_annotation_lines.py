import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from guideloom.sources.annotation_lines import REASONS, LineIndex, _classify, loaded, parse_annotation_lines, rejects
from tests.conftest import rows

GOOD = "c1\tsrc\tgene\t1\t20\t.\t+\t.\tID=g1;Note=x"


def reason_of(line):
    """The rules, one line at a time."""
    line = line[:-1] if line.endswith("\r") else line
    if not line.strip(" \t\r\n\v\f") or line.startswith("#"):
        return "none"
    f = line.split("\t")
    if len(f) != 9:
        return "columns"
    if len(re.findall(r'(?<!\\)"', f[8])) % 2:
        return "quoting"
    if not all(re.fullmatch("[0-9]+", x) and 1 <= int(x) <= 4294967295 for x in f[3:5]) or int(f[3]) > int(f[4]):
        return "coordinates"
    feature = f[2].lower()
    if f[7] not in ("0", "1", "2") and (f[7] != "." or feature == "cds"):
        return "phase"
    if feature in ("gene", "mrna", "transcript"):
        parts, inside = [""], False
        for i, c in enumerate(f[8]):
            inside ^= c == '"' and f[8][i - 1 : i] != "\\"
            if c == ";" and not inside:
                parts.append("")
            else:
                parts[-1] += c
        for p in parts:
            m = re.match(r"[ \r\n\v\f]*ID(?:[= \r\n\v\f](.*))?$", p, re.S)
            if m:
                return None if (m[1] or "").strip(' "\r\n\v\f') else "id"
        return "id"
    return None


LINES = [
    GOOD, GOOD + "\r", "", "   ", "\r", "#x", "# a\tb", " #x", "a\tb", GOOD + "\tten", 'c\ts\tgene\t1\t2\t.\t+\t.\tID="a', 'c\ts\texon\t1\t2\t.\t+\t.\tNote=\\"a',
    "c\ts\texon\t0\t2\t.\t+\t.\t", "c\ts\texon\t5\t2\t.\t+\t.\tx", "c\ts\texon\t0004\t4294967295\t.\t+\t1\tx", "c\ts\texon\t" + "0" * 4000 + "4\t" + "0" * 90 + "4294967295\t.\t+\t1\tx", "c\ts\texon\t000\t10\t.\t+\t1\tx", "c\ts\texon\t00x\t10\t.\t+\t1\tx", "c\ts\texon\t1\t" + "9" * 4000 + "\t.\t+\t1\tx", "c\ts\texon\t1\t4294967296\t.\t+\t1\tx", "c\ts\texon\t1\t99999999999999999999\t.\t+\t1\tx",
    "c\ts\texon\t\t4\t.\t+\t1\tx", "c\ts\texon\t1e3\t4\t.\t+\t1\tx", "c\ts\tCDS\t1\t4\t.\t+\t.\tx", "c\ts\texon\t1\t4\t.\t+\t3\tx", "c\ts\texon\t1\t4\t.\t+\t\tx", "c\ts\tmRNA\t1\t4\t.\t+\t0\tParent=a;ID=",
    'c\ts\tmRNA\t1\t4\t.\t+\t0\tNote="a;ID=b"', 'c\ts\tmRNA\t1\t4\t.\t+\t0\tNote="a;b"; ID "b"', "c\ts\tmRNA\t1\t4\t.\t+\t0\tID=;ID=b", "c\ts\tTranscript\t1\t4\t.\t+\t0\tprotein_ID=b", "c\ts\tgene\t1\t4\t.\t+\t0\tID",
    "c\ts\tgene\t1\t4\t.\t+\t0\tIDx=4", 'c\ts\tgene\t1\t4\t.\t+\t0\tID=" "', "é\tß\tgene\t1\t4\t.\t+\t0\tID=ü", "c\ts\tgene\t1\t4\t.\t+\t0\t", "c\ts\tgene\t1\t4\t.\t+\t0\tID=" + "x" * 100_000,
]


def test_reasons_and_records(spark):
    data = [(n, line, "f") for n, line in enumerate(LINES)] + [(900, None, "f"), (901, GOOD, None), (902, GOOD, None)]
    parsed = parse_annotation_lines(spark.createDataFrame(data, "line_no long, line string, file_name string").selectExpr("*", "1 as reason", "2 as phase"))
    want = {n: reason_of(x) for n, x, _ in data if x is not None}
    assert dict(rows(rejects(parsed).select("line_no", "reason"))) == {n: r for n, r in want.items() if r in REASONS}
    got = {r.line_no: r for r in loaded(parsed).collect()}
    assert set(got) == {n for n, r in want.items() if r is None}
    assert tuple(got[0])[1:] == ("c1", "src", "gene", 1, 20, ".", "+", None, "ID=g1;Note=x", "f")
    assert got[1].attributes == "ID=g1;Note=x" and got[LINES.index(LINES[14])].start_1based == 4


def test_empty(spark):
    assert rows(parse_annotation_lines(spark.createDataFrame([], "line_no long, line string, file_name string"))) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text('\t";\\= ID#a.1\r', max_size=30), st.builds(lambda a, f, p: f"c\ts\t{f}\t1\t2\t.\t+\t{p}\t{a}", st.text('";\\= IDa', max_size=16), st.sampled_from(["gene", "CDS", "exon"]), st.sampled_from(".0123"))), min_size=1, max_size=8))
def test_structural_index_equals_the_rules(lines):
    data = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in data])
    which, reason, _, _ = _classify(LineIndex(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends))
    got = ["none"] * len(lines)
    for w, r in zip(which, reason):
        got[w] = REASONS[r] if r >= 0 else None
    assert got == [reason_of(x) for x in lines]
