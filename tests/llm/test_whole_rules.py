"""Frequent lines leave the text; repeated rows are one document."""

from gridscore.llm import quality_rules


def test_frequent_lines_are_removed_and_rows_repeated(spark):
    body = lambda k: "\n".join(f"line {j} of text {k} is here" for j in range(9))
    menu = "Home about us and the contact"
    rows = [(k, "h", f"{menu}\n{body(k)}\n\n {menu.upper()} ", "x") for k in range(6)]
    many = (100, "h", "only one document says this line\n" + body(100), "x")
    twice = (50, "h", "\n".join([menu] * 4) + "\n" + "\n".join(body(50).split("\n")[:6]), "x")  # 24 of 66 words
    rows += [many] * 8 + [twice] * 2 + [(50, "h", "another text of fifty", "x"), (None, "h", menu, "x"), (7, "other", menu, "x"), (8, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, more string")
    out = quality_rules.apply_rules(df, min_words=1, max_docs=4).select("doc_id", "rules.*").collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.text for r in out if r.doc_id is not None and r.doc_id < 6} == {k: f"{body(k)}\n" for k in range(6)}
    assert all((r.text, r.removed_lines, r.depleted) == (many[2], 0, False) for r in out if r.doc_id == 100)
    got = sorted((r.removed_lines, r.removed_words, r.depleted, r.text) for r in out if r.doc_id == 50)
    assert got == [(0, 0, False, "another text of fifty")] + [(4, 24, False, "\n".join(body(50).split("\n")[:6]))] * 2
    assert [(r.text, r.removed_lines) for r in out if r.doc_id is None or r.doc_id == 7] == [(menu, 0)] * 2
    assert [r.text for r in out if r.doc_id == 8] == [None]
