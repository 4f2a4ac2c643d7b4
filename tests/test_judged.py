"""What the Arrow functions decide by themselves is what the rules say."""

import random
import re

from gridscore.operators import compared, printable


def _table(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_cells_that_differ_by_commas_case_or_digits_do_not_go_back():
    truth, told = [["1234.50", "Ab", "17", "x"], ["12", "7 a", "1", "é"]], [["1,234.50", "aB", "XXX", "5"], ["12", "7 A", "01", "e"]]
    _, _, _, _, correct, _, _, hits, numbers, _, rest = compared.compare(_table(told), _table(truth))
    assert (correct, hits, numbers) == (2, 2, 3)  # "Ab" and "12"; 1234.50 and 12; these and 17
    assert rest == [{"t": "7 a", "p": "7 A"}, {"t": "1", "p": "01"}, {"t": "é", "p": "e"}]


def test_edits_are_those_of_the_whole_program():
    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab,1") for _ in range(rng.randrange(9))) for _ in "ab")
        assert compared._edits(a, b) == whole(a, b)


def test_fences_and_printable_texts_are_those_of_the_patterns():
    fence, own = re.compile(r"```(?:html)?\s*(.*?)```", re.I | re.S), re.compile(r"[ -~\n]*+")
    rng = random.Random(4)
    for _ in range(5000):
        t = "".join(rng.choice(("`", "```", "html", "HTML", " ", "\n", "x", "<")) for _ in range(rng.randrange(9)))
        m = fence.search(t)
        assert printable._fenced(t).strip(" \n") == (m[1] if m else t).strip(" \n")
        t += rng.choice(("", "\t", "\x7f", "é", "~", "\r"))
        assert printable._printable(t) == bool(own.fullmatch(t))


def test_a_layout_that_repeats_is_read_once():
    page = lambda words: [f"{w} [[{100 * (i % 3)},{40 * (i // 3)},{100 * (i % 3) + 40},{40 * (i // 3) + 20}]]" for i, w in enumerate(words)]
    notes = re.compile("(?i)^source:")
    printable._layout.cache_clear()
    assert printable._placed(page("abcdef"), notes) == [["a", "b", "c"], ["d", "e", "f"]]
    assert printable._placed(page("uvwxyz"), notes) == [["u", "v", "w"], ["x", "y", "z"]]
    assert printable._layout.cache_info().hits == 1
    assert printable._placed(page(["a", "b", "c", "d", "e", "Source: x"]), notes) == [["a", "b", "c"], ["d", "e", ""]]


def test_converters_whose_marks_are_absent_are_not_tried(monkeypatch):
    from gridscore.operators import printable

    rule = re.compile("^(?:source|note)")
    placed = "\n".join(f"{r}{c} [[{100 * c},{40 * r},{100 * c + 40},{40 * r + 20}]]" for r in range(3) for c in range(3))
    tokens = "\n".join("<fcel>a b<fcel>1 <nl>" for _ in range(2))
    want = [printable.converted(t, rule, None) for t in (placed, tokens, "no table")]
    assert [w[1] for w in want] == ["coordinate_ocr_no_merge", "paddle_token_table_no_merge", "no_table_html"] and "<td>a b</td><td>1</td>" in want[1][0]
    for name in ("_markdown", "_loose"):
        monkeypatch.setattr(printable, name, lambda *_: 1 / 0)
    assert [printable.converted(t, rule, None) for t in (placed, tokens, "no table")] == want


def test_notes_of_a_row_are_read_once():
    from gridscore.operators import printable

    row = "<td>Source: ledger of this test</td><td></td>"
    before = printable._only_text.cache_info().hits
    assert [printable._only_text(row) for _ in range(3)] == ["Source: ledger of this test"] * 3
    assert printable._only_text.cache_info().hits == before + 2
