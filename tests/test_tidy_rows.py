"""Tables with row groups, spans and inline tags that need no repair are cut by patterns, with what the parser gives."""

import random
import time

from gridscore.operators import shred
from gridscore.operators.shred import GROUPS, grid_of, parse, table_in_front, tidy_elements, tidy_grid, tidy_rows


def _text(rng):
    return rng.choice(["", "a", " x  y ", "1,200", "&lt;b&gt;", "é", "&amp;lt;", "a&#x27;b", "\n"])


def _cell(rng):
    spans = rng.choice(["", "", "", ' colspan="2"', ' rowspan="2"', ' colspan="2" rowspan="3"', ' colspan="x"', ' rowspan="0"', ' colspan="-1"', ' colspan=""', ' rowspan="2" colspan="2"', ' class="x"'])
    inside = _text(rng) + rng.choice(["", "", "<b>q</b>", "<br>", "<br/>z", "<i>1</i><sup>2</sup>", "<i>", "</b>", "<b><i>x</i></b>", "<table></table>", "<!--c-->", "&nbsp;"])
    tag = rng.choice(("td", "th"))
    return f"<{tag}{spans}>{inside}</{rng.choice((tag, tag, tag, tag, tag, 'tr'))}>"


def _table(rng, cell):
    rows = lambda: "".join("<tr>" + "".join(cell(rng) for _ in range(rng.randint(0, 4))) + "</tr>" for _ in range(rng.randint(0, 3)))
    parts = [rows() if rng.random() < 0.4 else f"<{g}>{rows()}</{rng.choice((g, g, g, g, 'tbody'))}>" for g in rng.choices(GROUPS, k=rng.randint(0, 3))]
    return rng.choice(("", "<html><body>", "text ")) + "<table>" + "".join(parts) + rng.choice(("</table>", "</table>", "</table></body>", ""))


def test_rows_are_those_of_the_parser():
    rng, taken = random.Random(3), 0
    for k in range(6000):
        text = _table(rng, _cell if k % 3 else lambda r: f'<td{r.choice(["", " colspan=" + chr(34) + "2" + chr(34), " rowspan=" + chr(34) + "2" + chr(34)])}>{_text(r)}</td>')
        rows, table = tidy_rows(table_in_front(text)), parse(text)
        if rows is None:
            continue
        taken += 1
        grid, bad = grid_of(table)
        assert (list(map(list, tidy_grid(rows))), tidy_elements(rows)) == (grid, sum(1 for _ in table.all())), text
        assert sum(shred._tidy_row(r).bad for _, own in rows for r in own) == bad, text
        nodes = [(n["tag"], n["colspan"], n["rowspan"], n["content"]) for n in shred.nodes_of(table) if n["tag"] == "td"]
        assert [n for _, own in rows for r in own for n in shred.tidy_nodes(r)] == nodes, text
    assert taken > 2000


def test_grids_of_tidy_tables_take_little_time(monkeypatch):
    monkeypatch.setattr(shred, "parse", lambda text: 1 / 0)
    row = lambda k: f'<tr><td>{k}</td><td><i>{k}.5</i></td><td rowspan="1">x</td></tr>'
    texts = [f'<table><thead><tr><th colspan="3">Head</th></tr></thead><tbody>{"".join(row(10 * t + k) for k in range(4))}</tbody></table>' for t in range(2000)]
    out, began = shred.Grids(True), time.perf_counter()
    for t in texts:
        out.add(t)
    assert len(out.row_ends) == 2000 * 5 + 1 and time.perf_counter() - began < 1
