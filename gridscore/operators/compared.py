"""A prediction's text against its truth's, by the batch in an Arrow function: what cell, number and tree scores are made of.

Grids and trees stay inside the function. Cells that are equal are counted there; those that the JVM's text and number rules have to
judge come back as pairs. Distances of plain tables that are rows added or left out, or cells renamed at a cost of two at most, come back too
(see treedist for why these are exact); other pairs are hard, and go on to the tree distance as texts.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.operators.shred import _PLAIN_CELL, GROUPS, TAG_OPEN, _cell_text, grid_of, nodes_of, parse, plain_rows, table_in_front, tidy_elements, tidy_nodes, tidy_rows, unwrap
from gridscore.operators.treedist import only_added

_COUNTS = ("correct", "pred_total", "gt_total", "hits", "numbers", "n")
COMPARED = T.StructType([
    T.StructField("there", T.BooleanType()), T.StructField("hard", T.BooleanType()), T.StructField("d_text", T.DoubleType()), T.StructField("d_bare", T.DoubleType()), *[T.StructField(c, T.IntegerType()) for c in _COUNTS],
    T.StructField("rest", T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("p", T.StringType())]))),
])
_ARROW = pa.struct([("there", pa.bool_()), ("hard", pa.bool_()), ("d_text", pa.float64()), ("d_bare", pa.float64()), *[(c, pa.int32()) for c in _COUNTS], ("rest", pa.list_(pa.struct([("t", pa.string()), ("p", pa.string())])))])
_DIGIT = re.compile("[0-9]")


class Side(NamedTuple):
    """A table: its grid, the ASCII digits' count by row (null where a text is not ASCII), the cells as they stand by row where it is plain, its elements."""

    grid: list
    digits: list
    rows: list | None
    elements: int
    there: bool


@lru_cache(4096)
def _row(row: str) -> tuple:
    cells = tuple(_PLAIN_CELL.findall(row))
    if "&" in row:
        cells = tuple(map(_cell_text, cells))
    grid = cells if len(row.split()) < 2 else tuple(" ".join(c.split()) for c in cells)
    return cells, grid, _digits(grid)


def _digits(row) -> int | None:
    return sum(map(bool, map(_DIGIT.search, row))) if "".join(row).isascii() else None


@lru_cache(64)
def _side(text: str) -> Side:
    front = table_in_front(text)
    plain = None if front is None else plain_rows(front)
    if plain is not None:
        rows = list(map(_row, plain))
        return Side([r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows], sum(len(r[0]) + 1 for r in rows), True)
    table = parse(text)
    if table is None:
        return Side([], [], None, 0, False)
    grid = [tuple(r) for r in grid_of(table)[0]]
    return Side(grid, list(map(_digits, grid)), None, sum(1 for _ in table.all()), True)


def _edits(a: str, b: str) -> int:
    least, lo, hi = min(len(a), len(b)), 0, 0  # equal ends cost nothing
    while lo < least and a[lo] == b[lo]:
        lo += 1
    while hi < least - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _renames(x: list, y: list) -> float | None:
    """The distance of trees of one shape, cell by cell; null where it is over two, since another mapping may be better."""
    total = 0.0
    for r, s in zip(x, y):
        if r != s:
            for a, b in zip(r, s):
                if a != b:
                    total += _edits(a, b) / max(len(a), len(b), 1)
    return total if total <= 2.0 else None


def _added(x: list, y: list) -> list | None:
    """What is left of the longer list where the other is that list without one run of it; null where it is not."""
    least = min(len(x), len(y))
    lo = next((i for i in range(least) if x[i] != y[i]), least)
    hi = next((i for i in range(least - lo) if x[-1 - i] != y[-1 - i]), least - lo)
    return (x if len(x) > len(y) else y)[lo : max(len(x), len(y)) - hi] if lo + hi == least else None


def _distances(p: Side, g: Side) -> tuple[float | None, float | None]:
    """With and without text, where they are plain to see."""
    if p.rows is None or g.rows is None:
        return None, None
    a, b = list(map(len, p.rows)), list(map(len, g.rows))
    if a == b:
        return _renames(p.rows, g.rows), 0.0
    text, bare = _added(p.rows, g.rows), _added(a, b)
    return (None, None) if text is None or bare is None else (float(sum(len(r) + 1 for r in text)), float(sum(k + 1 for k in bare)))


def _judged(t: str, x: str) -> bool:
    """Whether plain rules tell what the JVM's would say of two ASCII cells: texts are equal but for case; numbers, which lose their commas first, are equal without them or one has no digit."""
    return x.isascii() and (x.replace(",", "") == t.replace(",", "") or _DIGIT.search(x) is None or _DIGIT.search(t) is None)


def compare(a: str, b: str) -> tuple:
    """COMPARED of a prediction's text and its truth's."""
    p, g = _side(a), _side(b)
    correct = hits = numbers = 0
    rest = []
    for r, row in enumerate(g.grid):
        other = p.grid[r] if r < len(p.grid) else ()
        digits = g.digits[r]
        if digits is not None and other == row:
            correct, hits, numbers = correct + len(row), hits + digits, numbers + digits
            continue
        for c, t in enumerate(row):
            x = other[c] if c < len(other) else None
            if not t.isascii() or x is not None and x != t and not _judged(t, x):
                rest.append({"t": t, "p": x})
                continue
            number = _DIGIT.search(t) is not None
            numbers += number
            if x is not None:
                correct += x == t or x.lower() == t.lower()
                hits += number and (x == t or x.replace(",", "") == t.replace(",", ""))
    there = p.there and g.there
    text, bare = (0.0, 0.0) if a == b else _distances(p, g)
    return there, there and (text is None or bare is None), text, bare, correct, sum(map(len, p.grid)), sum(map(len, g.grid)), hits, numbers, max(p.elements, g.elements, 1), rest


@lru_cache(64)
def _repeated(text: str) -> tuple:
    return compare(text, text)


def compare_texts(html: Column, gt_html: Column) -> Column:
    """COMPARED of two columns of texts without nulls; null where html is null. A null truth stands for one with the same text."""
    @F.arrow_udf(COMPARED)
    def run(texts: pa.Array, truths: pa.Array) -> pa.Array:
        out = [None if x is None else _repeated(x) if y is None else compare(x, y) for x, y in zip(texts.to_pylist(), truths.to_pylist())]
        none = (None,) * len(_ARROW)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*[x or none for x in out]) if out else [[]] * len(_ARROW), _ARROW)]
        return pa.StructArray.from_arrays(columns, fields=list(_ARROW), mask=pa.array([x is None for x in out], pa.bool_()))

    return run.asNondeterministic()(html, gt_html)


class Tree(NamedTuple):
    """A table's tree: its nodes' (tag, colspan, rowspan, content) in post-order, where their subtrees begin, its elements."""

    kinds: list
    first: list
    elements: int


@lru_cache(64)
def _tree(text: str, ignore: tuple[str, ...]) -> Tree | None:
    groups = tidy_rows(table_in_front(text)) if set(ignore) <= set(GROUPS) else None
    if groups is None:
        table = parse(text)
        if table is None:
            return None
        unwrap(table, ignore)
        nodes = nodes_of(table)
        return Tree([(n["tag"], n["colspan"], n["rowspan"], n["content"]) for n in nodes], [n["leftmost"] for n in nodes], sum(1 for _ in table.all()))
    kinds, first = [], []
    for group, rows in groups:
        start = len(kinds)
        for row in rows:
            cells, at = tidy_nodes(row), len(kinds)
            kinds += cells
            kinds.append(("tr", None, None, None))
            first += range(at, at + len(cells))
            first.append(at)
        if group and group not in ignore:
            kinds.append((group, None, None, None))
            first.append(start)
    kinds.append(("table", None, None, None))
    first.append(0)
    return Tree(kinds, first, tidy_elements(groups) - sum(group in ignore for group, _ in groups if group))


def _bare(kinds: list) -> list:
    return [k[:3] for k in kinds]


def _tree_distances(p: Tree, g: Tree) -> tuple[float | None, float | None]:
    """With and without text, where they are plain to see: trees that are equal, that differ by texts at a cost of two at most, or by nodes of kinds that one of them lacks."""
    x, y = _bare(p.kinds), _bare(g.kinds)
    if p.first == g.first and x == y:
        texts = [(a[3], b[3]) for a, b in zip(p.kinds, g.kinds) if a[3] != b[3]]
        if any(TAG_OPEN in a or TAG_OPEN in b for a, b in texts):
            return None, 0.0
        return _renames([[a for a, _ in texts]], [[b for _, b in texts]]), 0.0
    if len(x) == len(y):
        return None, None
    added = float(abs(len(x) - len(y)))
    return added if only_added((p.kinds, p.first), (g.kinds, g.first)) else None, added if only_added((x, p.first), (y, g.first)) else None


def compare_tree_texts(a: str, b: str, ignore: tuple[str, ...] = ()) -> tuple:
    """(there, hard, d_text, d_bare, n) of a prediction's text and its truth's."""
    p, g = _tree(a, ignore), _tree(b, ignore)
    if p is None or g is None:
        return False, False, None, None, 1
    text, bare = _tree_distances(p, g)
    return True, text is None or bare is None, text, bare, max(p.elements, g.elements, 1)


_TREES = ("there", "hard", "d_text", "d_bare", "n")


def compare_trees(html: Column, gt_html: Column, ignore_nodes: tuple[str, ...] = ()) -> Column:
    """What text_scores reads of COMPARED, for tables of any kind, of two columns of texts; nulls are empty. ignore_nodes: as in shred_tables."""
    @F.arrow_udf(T.StructType([COMPARED[c] for c in _TREES]))
    def run(texts: pa.Array, truths: pa.Array) -> pa.Array:
        out = [compare_tree_texts(x or "", y or "", ignore_nodes) for x, y in zip(texts.to_pylist(), truths.to_pylist())]
        fields = [_ARROW.field(c) for c in _TREES]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(fields), fields)], fields=fields)

    return run.asNondeterministic()(html, gt_html)
