"""Pages without an end of head, with slashed or unended foreign elements, and with formulas."""

import pytest

from gridscore.llm.html_extract import Parser

BODY = "<article><h1>A title</h1><p>First text.</p>{}<p>Last text.</p></article>"


@pytest.mark.parametrize("start", ["<html><head><title>x</title><body>", "<html><head><meta charset=utf-8><title>x</title>", "<head><title>x</title></head><body>", ""])
@pytest.mark.parametrize("middle", ["", "<svg viewBox='0 0 1 1' />", "<svg width=1>", "<svg><text>no</text></svg>", "<script>no</script>"])
def test_blocks_outside_of_head(start, middle):
    out = [t for t, above, _ in Parser().blocks(start + BODY.format(middle)) if "in:head" not in above]
    assert out == ["A title", "First text.", "Last text."]


def test_formulas_stay_in_their_text():
    page = "<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>k</mi></msup></mrow><annotation>x=2^k</annotation></semantics></math> be so.</p><p>Then <math/> on.</p>"
    assert [t for t, _, _ in Parser().blocks(page)] == ["Let x=2k be so.", "Then on."]


def test_text_alone_ends_head():
    assert [("in:head" in above, t) for t, above, _ in Parser().blocks("<head><title>x</title>Plain text")] == [(True, "x"), (False, "Plain text")]


def test_fallback_texts_are_left_to_the_field(spark):
    from gridscore.llm.html_extract import extract_text, fit

    page = BODY.format("<noscript><p>A paragraph in noscript, which stays.</p></noscript><object data=a.swf><p>Another one, in an object.</p></object>")
    df = spark.createDataFrame([(1, f"<html><head><noscript><link href=x></noscript></head><body>{page}</body>", "own")], "page_id int, html string, text string")
    assert extract_text(df, fit()).first().text == "A title\n\nFirst text.\n\nA paragraph in noscript, which stays.\n\nAnother one, in an object.\n\nLast text."
