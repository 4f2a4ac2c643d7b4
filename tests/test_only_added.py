"""Trees that differ by nodes of kinds that one of them lacks need no program; the distance is the same."""

import random
import time

from gridscore.operators import shred, treedist


def _nodes(html):
    return shred.nodes_of(shred.parse(html))


def _program(monkeypatch, a, b, bare):
    with monkeypatch.context() as m:
        m.setattr(treedist, "_only_added", lambda *_: False)
        return treedist.tree_distance(a, b, bare)


def test_distances_are_those_of_the_program(monkeypatch):
    rng, taken = random.Random(4), 0
    cell = lambda: f"<td{rng.choice(['', '', ' colspan=2'])}>{rng.choice(['a', 'b', '', 'long text'])}</td>"
    row = lambda: "<tr>" + "".join(cell() for _ in range(rng.randint(0, 3))) + "</tr>"
    for _ in range(400):
        rows = [row() for _ in range(rng.randint(0, 4))]
        k = rng.randint(0, len(rows))
        full = "<table><thead>" + "".join(rows[:k]) + "</thead><tbody>" + "".join(rows[k:]) + "</tbody>" + rng.choice(("", "<tfoot></tfoot>")) + "</table>"
        other = "<table>" + "".join(r for r in rows if rng.random() < 0.8) + "</table>"
        if rng.random() < 0.3:
            other = other.replace("<td>a</td>", "", 1)
        for x, y in ((full, other), (other, full)):
            a, b = _nodes(x), _nodes(y)
            taken += len(a) != len(b) and treedist._only_added(a, b)
            for bare in (False, True):
                assert treedist.tree_distance(a, b, bare) == _program(monkeypatch, a, b, bare), (x, y)
    assert taken > 200


def test_row_groups_cost_their_number_at_once():
    rows = "".join(f"<tr><td>{r}</td><td>x{r}</td><td>{r % 7}</td></tr>" for r in range(2000))
    a, b = _nodes(f"<table><tbody>{rows}</tbody></table>"), _nodes(f"<table>{rows}</table>")
    began = time.perf_counter()
    assert treedist.tree_distance(a, b) == 1.0
    assert time.perf_counter() - began < 1  # 8,002 by 8,001 nodes
