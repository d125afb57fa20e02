import itertools
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guideloom.llm.lookalikes import cluster_form, compiled_mapping, consistent_texts, look_alike_classes, look_alike_letters, look_alike_pairs, met_rows, transducer
from tests.conftest import rows

FORM = transducer(compiled_mapping())

SAME = [
    ("Café", "Cafe\u0301"), ("Café", "Ｃａｆé"), ("a b", "a\u00a0b"), ("a b", "a\u3000b"), ("a b", "a\u202fb"), ("ab", "a\u200bb"), ("ab", "\ufeffa\u2060b\u00ad"), ("copy", "сору"), ("AXE", "ΑΧΕ"),
    ("é", "e\u200d\u0301"), ("ё", "ë"), ("ộ", "o\u0302\u0323"), ("バ", "ﾊﾞ"), ("が", "か\u3099"), ("１2", "12"), ("각", "\u1100\u1161\u11a8"), ("ÉX", "Ε\u0301Х"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("a b", "a  b"), ("a b", "a\nb"), ("a", "a."), ("\r\n", "\n"), ("й", "и"), ("l", "1"), ("O", "0"), ("–", "-"), ("a\tb", "a b")]


def test_known_pairs():
    assert all(FORM(a) == FORM(b) for a, b in SAME)
    assert all(FORM(a) != FORM(b) for a, b in DIFFERENT)


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ae\u0301\u0323\u200b\u3000ａＥсΑがﾊﾞ゙ᄀ각\u00ad")), max_size=30))
def test_one_pass_is_final_and_ignores_composition(text):
    form = FORM(text)
    assert FORM(form) == form
    assert FORM(unicodedata.normalize("NFD", text)) == FORM(unicodedata.normalize("NFC", text))
    assert FORM(text + "\u200b") == form or text == ""


def test_mapping_has_no_ascii_and_letters_look_latin():
    table = compiled_mapping()
    assert all(len(c) <= 6 and not c.isascii() for c in table) and all(FORM(c) == form for c, form in table.items())
    assert table["\u0435\u0301"] == "é" and table["ﾊﾞ"] == "バ" and table["ê\u0301"] == table["e\u0302\u0301"] == "ế"
    assert all(v.isascii() and v.isalpha() and cluster_form(k, look_alike_letters()) == v for k, v in look_alike_letters().items())


def test_texts(spark):
    df = spark.createDataFrame([(1, "Ｃａｆe\u0301"), (2, None), (3, ""), (4, "\u200b"), (5, "ａ" * 30_000)], "id long, text string").withColumn("form", F.lit("clash")).withColumn("value", F.lit(1))
    assert rows(consistent_texts(df, "id", "text")) == [(1, "Café"), (2, None), (3, ""), (4, ""), (5, "a" * 30_000)]


def test_pairs_equal_brute_force_with_a_hot_group(spark):
    data = [(i, "same text") for i in range(0, 400, 2)] + [(i, "same\u00a0text") for i in range(1, 8, 2)] + [(1001, "sаme text"), (1002, None), (1003, ""), (1004, "alone"), (1005, "\u200b"), (1006, "\u200c"), (1007, "alone")]
    df = spark.createDataFrame(data, "id long, text string").withColumn("salt", F.lit("clash"))
    want = [(a, b) for a, x in data for b, y in data if a < b and x and y and x != y and FORM(x) == FORM(y)]
    assert rows(look_alike_pairs(df, "id", "text", per_task=50)) == sorted(want, key=str)
    assert rows(look_alike_pairs(df.where("false"), "id", "text")) == []
    known = [(i, x, FORM(x)) for i, x in data if x]
    classes = [(i, min(j for j, _, g in known if g == f), sum(g == f and x != y for _, y, g in known)) for i, x, f in known]
    assert rows(look_alike_classes(df, "id", "text")) == sorted(classes, key=str)
    assert rows(look_alike_classes(df.where("false"), "id", "text")) == []


def test_rows_of_one_text_do_not_meet(spark):
    data = [(i, b"f", b"hot") for i in range(900)] + [(1000, b"f", b"a"), (1001, b"f", b"z"), (1002, b"g", b"alone"), (1003, b"g", b"alone")]
    data += [(2000 + i, b"h", str(i).encode()) for i in range(60)]
    got = rows(met_rows(spark.createDataFrame(data, "key long, form binary, as_is binary"), per_task=50))
    want = [(a, b) for a, f, x in data for b, g, y in data if a < b and f == g and x != y]
    assert len(got) == len(want) and {(min(p), max(p)) for p in got} == set(want)


def test_equal_and_missing_keys_make_no_pair(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "a　b")], "id long, text string")
    assert rows(look_alike_pairs(df, "id", "text")) == [(1, 2), (1, 2)]


def test_partly_decomposed_hangul():
    assert FORM("각") == FORM("각") == FORM("각") == "각"
    assert FORM("가​ᆨ") == FORM("ᄀ​ᅡᆨ") == FORM("ﾡￂᆨ") == "각"
    assert FORM("각ᆨ") == "각ᆨ" and FORM("가각") == "가각"
    for parts in itertools.product("가각각ﾡￂ​́a", repeat=4):
        text = "".join(parts)
        assert FORM(FORM(text)) == FORM(text) == FORM(unicodedata.normalize("NFD", text)) == FORM(unicodedata.normalize("NFC", text))
