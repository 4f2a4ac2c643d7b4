"""Converters, spans, notes and text functions on hand-made rows; expected values follow from the rules in the docstrings."""

import pytest
from pyspark.sql import functions as F

from gridscore.functions import textnorm as X
from gridscore.operators.convert import convert_responses
from gridscore.operators.shred import shred_tables

FENCE = "`" * 3
CASES = [
    ("", None, "empty_output"),
    ("no table at all", None, "no_table_html"),
    ("<table><tr><th>a</th></tr><tr><td>1</td></tr></table>", [["a"], ["1"]], None),
    (f"x {FENCE}html\n<table><tr><td>q</td></tr></table>\n{FENCE} y <table><tr><td>no</td></tr></table>", [["q"]], None),
    (f"{FENCE}html\n<table><tr><td>open</td></tr></table>", [["open"]], None),
    ("|a|b|\n|---|---|\n|1|2|", [["a", "b"], ["1", "2"]], "markdown_table_no_merge"),
    ("|a|b|\n|---|---|\n|1|2|3|\n||x|", [["a", "b"], ["1", "2", "3"], ["x"]], "markdown_table_no_merge"),
    ("|a|b|\n|1|2|3|", [["a", "b", ""], ["1", "2", "3"]], "loose_markdown_table_no_merge"),
    ("|a|b|", [["a", "b"]], "loose_markdown_table_no_merge"),
    ("<fcel>a<ecel><nl><ecel><ecel><nl><fcel>1<fcel>2 \\(\\pm\\) 3<nl><fcel>t", [["a", ""], ["1", "2 ± 3"], ["t", ""]], "paddle_token_table_no_merge"),
    ("<fcel>a<nl>", None, "no_table_html"),
    ("A [[0,0,20,20]]\nB [[200,0,220,20]]\nC [[0,40,20,60]]\nD [[200,40,220,60]]\nE [[205,42,225,62]]", [["A", "B"], ["C", "D E"]], "coordinate_ocr_no_merge"),
    ("A [[0,0,20,20]]\nB [[200,0,220,20]]\nC [[0,40,20,60]]", None, "no_table_html"),
    ("Table 1. x [[0,-90,20,-70]]\nA [[-20,0,0,20]]\nB [[200,0,220,20]]\nC [[-20,40,0,60]]\nD [[200,40,220,60]]", [["A", "B"], ["C", "D"]], "coordinate_ocr_no_merge"),
]


def test_converters(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, text string")
    out = {r.i: r for r in shred_tables(convert_responses(df, "text"), "html", "g").collect()}
    for i, (text, grid, tag) in enumerate(CASES):
        assert (out[i].conversion_ok, out[i].conversion_tag) == (grid is not None, tag), text
        assert out[i].g.grid == (grid or []), text


def test_null_response_is_empty(spark):
    r = convert_responses(spark.createDataFrame([(None,)], "text string"), "text").first()
    assert (r.html, r.conversion_ok, r.conversion_tag) == ("", False, "empty_output")


NOTES = [
    ("<table><caption>c</caption><tr><td colspan=2>Table 1. Title</td></tr><tr><td>a</td><td>b</td></tr><tr><td colspan=2>Source: x</td></tr></table>", [["a", "b"]], 3),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td colspan=2>Note: middle</td></tr><tr><td>c</td><td>d</td></tr></table>", [["a", "b"], ["Note: middle", "Note: middle"], ["c", "d"]], 0),
    ("<table><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>Source: narrow</td></tr></table>", [["a", "b", "c"], ["Source: narrow"]], 0),
]


def test_notes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NOTES)], "i int, text string")
    out = {r.i: r for r in shred_tables(convert_responses(df, "text"), "html", "g").collect()}
    assert [(out[i].g.grid, out[i].removed_rows) for i in range(len(NOTES))] == [(g, n) for _, g, n in NOTES]


def test_own_note_pattern(spark):
    texts = ["<table><tr><td colspan=2>Legend A</td></tr><tr><td>a</td><td>b</td></tr></table>", "<table><tr><td>Legend B</td></tr><tr><td>a</td></tr><tr><td>Source: x</td></tr></table>", "|Legend|x|\n|---|---|\n|Legend q||"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = {r.i: r for r in shred_tables(convert_responses(df, "text", notes="^Legend"), "html", "g").collect()}
    assert [(out[i].g.grid, out[i].removed_rows) for i in range(3)] == [([["a", "b"]], 1), ([["a"], ["Source: x"]], 1), ([["Legend", "x"]], 1)]


SPANS = [
    ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>", [["a", "b"], ["a", "c"]]),
    ("<table><tr><td colspan=2>a</td></tr><tr><td>b</td><td>c</td></tr></table>", [["a", "a"], ["b", "c"]]),
    ("<table><tr><td rowspan=3>a</td></tr></table>", [["a"]]),
    ("<table><tr><td>x</td><td rowspan=2>a</td></tr><tr><td>y</td></tr></table>", [["x", "a"], ["y", "a"]]),
    ("<table><tr><td colspan=0>gone</td><td>b</td></tr></table>", [["b"]]),
    ("<table><tr><td>a<br>b</td><td><b>x</b> &amp; y</td><!-- c --></tr></table>", [["ab", "x & y"]]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", [["a", "b"], ["c"]]),
    ("<table><tr><td colspan=z>a</td></tr></table>", [["a"]]),
    ("<table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>", [["in"], ["in"]]),
]


def test_spans(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPANS)], "i int, html string")
    out = {r.i: r.g for r in shred_tables(df, "html", "g").collect()}
    for i, (text, grid) in enumerate(SPANS):
        assert out[i].grid == grid, text
    assert out[7].bad_spans == 1


NUMBERS = {"1,234.50": "1234.5", "100": "1E+2", "100.0": "1E+2", "-0": "-0", "0": "0", "+5": "5", ".5": "0.5", "1.": "1", "−3": "-3", "–3": "-3", "12%": "12", "5 mg": "5", "5 μm": "5", "5 µm": "5µm", "12 (3)": "12(3)", "$4": "$4", "٣": "3", "abc": None, "5E2": "5E2", "12345678901234567890123456789012": "1.234567890123456789012345679E+31", "0.0000012": "0.0000012", "0.00000012": "1.2E-7", "1230": "1.23E+3"}


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "t string")
    assert {r.t: r.n for r in df.select("t", X.normalize_number(F.col("t")).alias("n")).collect()} == NUMBERS


def test_decimal_texts(spark):
    """As the decimal library writes normalised numbers."""
    import random
    from decimal import Decimal

    rng = random.Random(3)
    texts = {rng.choice(["", "-", "+"]) + "".join(rng.choices("0123456789", [5, *[1] * 9], k=rng.randint(1, 34))) + rng.choice(["", "."]) for _ in range(300)}
    texts |= {t.rstrip(".") + "." + "".join(rng.choices("0123456789", [6, *[1] * 9], k=rng.randint(1, 30))) for t in list(texts)[:200]}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", X.normalize_number(F.col("t")).alias("n")).collect()} == {t: str(Decimal(t).normalize()) for t in texts}


@pytest.mark.parametrize("text, want", [("a\t\xa0b  c\x1c\n", "a b c"), (None, ""), ("  ", "")])
def test_normalize_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.normalize_text(F.col("t")).alias("n")).first().n == want


def test_cell_text(spark):
    rows = [("x</", "x"), ("x<", "x"), ("x</td", "x"), ("Straße", "Straße"), ("a < b", "a < b")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r.n for r in df.select(X.clean_cell_text(F.col("t")).alias("n")).collect()] == [b for _, b in rows]
    folds = ["Straße", "STRASSE", "İ", "ΣΑΣ", "ﬁn", "ı", "ẞ", "abC"]
    out = spark.createDataFrame([(a,) for a in folds], "t string").select(X.casefold(F.col("t")).alias("n")).collect()
    assert [r.n for r in out] == [a.casefold() for a in folds]


def test_names(spark):
    rows = [("a/b.c.png", "b.c", ".png"), (".hidden", ".hidden", ""), ("x", "x", ""), ("d/X.JPG", "X", ".jpg")]
    df = spark.createDataFrame([(a,) for a, _, _ in rows], "t string")
    out = df.select(X.file_stem(F.col("t")).alias("a"), X.file_suffix(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in out] == [(b, c) for _, b, c in rows]
