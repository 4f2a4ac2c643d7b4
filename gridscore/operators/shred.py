"""HTML tables to rows and trees.

Plain tables, rows of cells without attributes or inner tags, are cut by patterns inside the JVM: grid, tree and note rows are column
expressions over them. Tidy tables, with attributes, row groups, spans and inline tags but nothing to repair, are shredded there too (see tidy). Only
the others go through an Arrow function, with a lenient parser: cells, rows and row groups
close by implication, comments are dropped, references are decoded, spans are expanded.
A shredded table is the grid after span expansion and the tree in post-order for tree distance.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.functions.textnorm import NOTE_ROW, let, normalize_text
from gridscore.operators.notes import body_range
from gridscore.operators.tidy import TAG_CLOSE, TAG_OPEN

FIRST_TABLE = T.StructType([T.StructField("html", T.StringType()), T.StructField("removed", T.IntegerType())])
NODE = T.StructType([T.StructField("tag", T.StringType()), T.StructField("colspan", T.IntegerType()), T.StructField("rowspan", T.IntegerType()), T.StructField("leftmost", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("size", T.IntegerType())])
SHREDDED = T.StructType([T.StructField("grid", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("n_elements", T.IntegerType()), T.StructField("bad_spans", T.IntegerType())])

#: A table that patterns can cut: no attributes, no tags inside cells, only the five references that escaping makes.
PLAIN_TABLE = r"^<table>(?:<tr>(?:<(td|th)>[^<>&]*+(?:&(?:amp|lt|gt|quot|#x27);[^<>&]*+)*+</\1>)*+</tr>)*+</table>$"
#: Tags that may stand in front of it.
BEFORE_TABLE = r"(?i)</?(?:html|body|div|p|br)>"

_PLAIN_CELLS = re.compile(r"(?:<(td|th)>[^<>&]*+(?:&(?:amp|lt|gt|quot|#x27);[^<>&]*+)*+</\1>)*+")
_BEFORE = re.compile(BEFORE_TABLE)
_PLAIN_ROW = re.compile("<tr>(.*?)</tr>", re.S)
#: Row groups, and cells with spans and inline tags, where every element is closed in its place.
_GROUP = re.compile("<(/?)(thead|tbody|tfoot)>")
GROUPS = ("thead", "tbody", "tfoot")
_TEXT = "[^<>&]*+(?:&(?:amp|lt|gt|quot|#x27);[^<>&]*+)*+"
_TIDY_CELL = re.compile(rf"""(<(t[dh])(?: colspan="([^"<>&]++)")?+(?: rowspan="([^"<>&]++)")?+>({_TEXT}(?:(?:<br/?>|<(b|i|u|em|strong|sub|sup)>{_TEXT}</\6>){_TEXT})*+)</\2>)""")
_INLINE = re.compile("<(/?)([a-z]+)/?>")
_PLAIN_CELL = re.compile("<t[dh]>([^<]*)</t[dh]>")
_ARROW_NODE = pa.struct([("tag", pa.string()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("leftmost", pa.int32()), ("content", pa.string()), ("size", pa.int32())])
_ARROW_SHREDDED = pa.struct([("grid", pa.list_(pa.list_(pa.string()))), ("nodes", pa.list_(_ARROW_NODE)), ("n_elements", pa.int32()), ("bad_spans", pa.int32())])

VOID = {"br", "img", "hr", "input", "wbr", "col", "meta", "link"}
#: A start tag ends these open elements, up to the nearest table.
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, **{g: {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"} for g in ("thead", "tbody", "tfoot")}}
_SPACE = re.compile(r"\s+")
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
_ATTRIBUTE = re.compile(r'([A-Za-z-]+)="([^"<>&]*)"')
_PLAIN = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+{_ATTRIBUTE.pattern.replace('(', '(?:')})*)[ \t\n\r\f]*(/?)>|([^<]+)")


class Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def children(self):
        return [x for x in self.parts if isinstance(x, Node)]

    def all(self, *tags: str):
        for x in self.children():
            if not tags or x.tag in tags:
                yield x
            yield from x.all(*tags)

    def strings(self):
        for x in self.parts:
            if isinstance(x, Node):
                yield from x.strings()
            else:
                yield x

    def html(self) -> str:
        attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}/>"
        return f"<{self.tag}{attrs}>" + "".join(x.html() if isinstance(x, Node) else escape(x, quote=False) for x in self.parts) + f"</{self.tag}>"


class FirstTable(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Node] = []
        self.table: Node | None = None
        self.done = False

    def handle_starttag(self, tag, attrs):
        if self.done or not self.open and tag != "table":
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == "table" or tag not in ENDS:
                break
            if self.open[k].tag in ENDS[tag] and not (self.open[k].tag in ("thead", "tbody", "tfoot") and tag == "tr"):
                del self.open[k:]
        node = Node(tag, dict(attrs))
        if self.open:
            self.open[-1].parts.append(node)
        else:
            self.table = node
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                self.done = self.done or not self.open
                return
            if self.open[k].tag == "table":
                return

    def handle_data(self, data):
        if self.open and not self.done:
            self.open[-1].parts.append(data)


def _plainly(html: str) -> FirstTable | None:
    """The parser after markup that is only plain tags and text; null where anything else comes before the table's end."""
    p, at = FirstTable(), 0
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        end, tag, attrs, closed, text = m.groups()
        if text is not None:
            p.handle_data(unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if tag in RAW or end and (attrs or closed):
            return None
        if end:
            p.handle_endtag(tag)
            if p.done:
                return p
        else:
            (p.handle_startendtag if closed else p.handle_starttag)(tag, [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else ())
    return p if at == len(html) else None


def parse(html: str | None) -> Node | None:
    if not html:
        return None
    p = _plainly(html)
    if p is not None:
        return p.table
    p = FirstTable()
    p.feed(html)
    p.close()
    return p.table


def squeeze(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


def span(cell: Node, name: str) -> tuple[int, bool]:
    """Value and whether it is bad; a bad span counts 1."""
    try:
        return int(cell.attrs.get(name) or 1 if name not in cell.attrs else cell.attrs[name]), False
    except (TypeError, ValueError):
        return 1, True


def cells(tr: Node) -> list[Node]:
    return [x for x in tr.children() if x.tag in ("td", "th")]


def is_note(tr: Node, width: int, rule: re.Pattern) -> bool:
    own = cells(tr)
    filled = [c for c in own if squeeze("".join(c.strings()))]
    text = squeeze(" ".join(s.strip() for s in tr.strings() if s.strip()))
    return len(filled) == 1 and bool(text) and sum(max(1, span(c, "colspan")[0]) for c in own) >= max(1, width - 1) and bool(rule.match(text))


def without_notes(table: Node, pattern: str = NOTE_ROW) -> int:
    """Removes captions, then note rows from the top and the bottom; the width is that of the whole table."""
    rule = re.compile(pattern.replace("(?iU)", "(?i)"))
    gone: set[int] = {id(x) for x in table.all("caption")}
    removed = len(gone)
    rows = list(table.all("tr"))
    width = max((sum(max(1, span(c, "colspan")[0]) for c in cells(r)) for r in rows), default=1)
    lo, hi = 0, len(rows)
    while lo < hi and is_note(rows[lo], width, rule):
        lo += 1
    while hi > lo and is_note(rows[hi - 1], width, rule):
        hi -= 1
    gone |= {id(r) for r in rows[:lo] + rows[hi:]}
    removed += lo + len(rows) - hi
    if removed:
        for x in [table, *table.all()]:
            x.parts = [p for p in x.parts if id(p) not in gone]
    return removed


def grid_of(table: Node) -> tuple[list[list[str]], int]:
    """Rows after span expansion, and bad spans."""
    out, bad = [], 0
    taken: dict[int, dict[int, str]] = {}
    for r, tr in enumerate(table.all("tr")):
        row = []
        for cell in cells(tr):
            (wide, b1), (tall, b2) = span(cell, "colspan"), span(cell, "rowspan")
            bad += b1 + b2
            row.append((squeeze("".join(cell.strings())), wide, tall))
        out.append(spread(row, r, taken))
    return out, bad


def spread(cells: list[tuple], r: int, taken: dict[int, dict]) -> list:
    """Row r after span expansion, from (text, colspan, rowspan) of its cells; taken: by row, the slots that rows above have taken. Only a cell's first slot steps over those."""
    row: list = []
    own = taken.pop(r, {})
    shift = 0
    for text, wide, tall in cells:
        while own and len(row) + shift in own:
            row.append(own[len(row) + shift])
        c = len(row) + shift
        row.extend([text] * wide)
        shift += min(0, wide)
        if tall > 1:
            for dr in range(1, tall):
                taken.setdefault(r + dr, {}).update((c + dc, text) for dc in range(wide))
    while own and len(row) + shift in own:
        row.append(own[len(row) + shift])
    return row


def unwrap(table: Node, tags: tuple[str, ...]) -> None:
    """Takes elements of these tags out from under a table; their content stays where they were."""
    parts = []
    for p in table.parts:
        if isinstance(p, Node):
            unwrap(p, tags)
            parts.extend(p.parts if p.tag in tags else [p])
        else:
            parts.append(p)
    table.parts = parts


def _tokens(node: Node, out: list[str]) -> None:
    """Characters, and a token for each inline tag; what follows an inner cell in its parent is no token."""
    after_cell = False
    for p in node.parts:
        if isinstance(p, Node):
            out.append(f"<{p.tag}>")
            _tokens(p, out)
            out.append(f"</{p.tag}>")
            after_cell = p.tag in ("td", "th")
        elif not after_cell:
            out.extend(p)


def nodes_of(table: Node) -> list[dict]:
    out: list[dict] = []

    def walk(node: Node) -> int:
        first = -1
        cell = node.tag in ("td", "th")
        for child in () if cell else node.children():
            k = walk(child)
            first = k if first < 0 else first
        tokens: list[str] = []
        if cell:
            _tokens(node, tokens)
        leftmost = len(out) if first < 0 else first
        out.append({"tag": "td" if cell else node.tag, "colspan": span(node, "colspan")[0] if cell else None, "rowspan": span(node, "rowspan")[0] if cell else None, "leftmost": leftmost, "content": "".join(t if len(t) == 1 else TAG_OPEN + t[1:-1] + TAG_CLOSE for t in tokens) if cell else None, "size": len(tokens)})
        return leftmost

    walk(table)
    return out


def first_table(text: str, notes: str | None = NOTE_ROW) -> tuple[str, None, int] | None:
    """(html, no tag, removed rows) of the first table of a text as the parser reads it; null without one."""
    table = parse(text)
    if table is None:
        return None
    removed = without_notes(table, notes) if notes else 0
    return f"<html><body>{table.html()}</body></html>", None, removed


def plain_table(text: Column) -> Column:
    """The first table of a text, where it is plain; else null."""
    def of(t):
        at = F.locate("<table>", t)
        table = F.concat(F.substring_index(F.substring(t, at, F.length(t)), "</table>", 1), F.lit("</table>"))
        front = F.regexp_replace(F.left(t, at - 1), BEFORE_TABLE, "")
        return F.when((at > 0) & ~F.contains(front, F.lit("<")), let(table, lambda x: F.when(x.rlike(PLAIN_TABLE), x)))

    return let(text, of)


def plain_cells(table: Column) -> Column:
    """The cells' texts of a plain table, row by row, references decoded."""
    def text(c):
        for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(mark), F.lit(char))
        return c

    cells = lambda row: F.regexp_extract_all(row, F.lit("<t[dh]>([^<]*)</t[dh]>"), 1)
    decoded = lambda row: F.transform(cells(row), lambda c: F.when(F.contains(c, F.lit("&")), text(c)).otherwise(c))
    return F.transform(F.regexp_extract_all(table, F.lit("(?s)<tr>(.*?)</tr>"), 1), decoded)


def _hash128(*columns: Column) -> Column:
    """32 hex digits of columns."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *columns)), 16, "0") for k in (0, 1)])


def _plain_first(table: Column, texts: Column, notes: str | None) -> Column:
    """FIRST_TABLE of a plain table: as the parser writes it, where quotes in texts are not escaped."""
    rows = F.regexp_extract_all(table, F.lit("(?s)<tr>.*?</tr>"), 0)
    cut = lambda b: F.when(b["n"] == F.size(texts), F.struct(table.alias("t"), F.lit(0).alias("r"))).otherwise(F.struct(F.concat(F.lit("<table>"), F.array_join(F.slice(rows, b["lo"] + 1, b["n"]), ""), F.lit("</table>")).alias("t"), (F.size(texts) - b["n"]).alias("r")))
    grid = F.transform(texts, lambda r: F.transform(r, normalize_text))
    left = let(body_range(grid, notes), cut) if notes else F.struct(table.alias("t"), F.lit(0).alias("r"))
    text = lambda t: F.replace(F.replace(t, F.lit("&quot;"), F.lit('"')), F.lit("&#x27;"), F.lit("'"))
    return let(left, lambda x: F.struct(F.concat(F.lit("<html><body>"), text(x["t"]), F.lit("</body></html>")).alias("html"), x["r"].cast("int").alias("removed")))


def _arrow(kind: T.StructType, arrow: pa.DataType, of):
    """An Arrow function of one text column; nulls pass. Marked as not deterministic, so that filters above neither repeat nor inline it."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else of(x) for x in texts.to_pylist()], arrow)

    return run.asNondeterministic()


def with_first_table(df: DataFrame, column: str, out: str, notes: str | None = NOTE_ROW) -> DataFrame:
    """df with struct<html, removed>: the first table of a text, serialised again; null without one. notes: the pattern of note rows to remove, with captions; null keeps all."""

    def of(text):
        found = first_table(text, notes)
        return found and {"html": found[0], "removed": found[2]}

    parsed = _arrow(FIRST_TABLE, pa.struct([("html", pa.string()), ("removed", pa.int32())]), of)
    rows = df.withColumn("__plain", plain_table(F.col(column)))
    native = F.when(F.col("__plain").isNotNull(), let(plain_cells(F.col("__plain")), lambda texts: _plain_first(F.col("__plain"), texts, notes)))
    rows = rows.withColumn("__native", native).withColumn("__parsed", parsed(F.when(F.col("__plain").isNull(), F.col(column))))
    return rows.withColumn(out, F.coalesce("__native", "__parsed")).drop("__plain", "__native", "__parsed")


def _first_plain(text: str) -> str | None:
    """plain_table of a text."""
    table = table_in_front(text)
    return None if table is None or plain_rows(table) is None else table


def table_in_front(text: str) -> str | None:
    """A text from its first bare table tag to the end of that table, where only tags that mean nothing stand before it."""
    at = text.find("<table>")
    if at < 0 or "<" in (front := text[:at]) and front != "<html><body>" and "<" in _BEFORE.sub("", front):
        return None
    end = text.find("</table>", at)
    return (text[at:] if end < 0 else text[at:end]) + "</table>"


@lru_cache(4096)
def _plain_cells(row: str) -> bool:
    return _PLAIN_CELLS.fullmatch(row) is not None


def plain_rows(table: str) -> list[str] | None:
    """The rows of a table that PLAIN_TABLE matches, without their tags; else null. Versions of a table follow each other and share rows, which are looked at once."""
    return cut_rows(table[7:-8], _plain_cells) if table.startswith("<table>") and table.endswith("</table>") else None


def cut_rows(inner: str, well: Callable[[str], bool]) -> list[str] | None:
    """What stands in a table as rows without their tags; null where it isn't rows only, or one of them isn't well."""
    if not inner:
        return []
    if not inner.startswith("<tr>") or not inner.endswith("</tr>"):
        return None
    rows = inner[4:-5].split("</tr><tr>")
    return rows if all(map(well, rows)) else None


class Row(NamedTuple):
    """A row of a tidy table: its cells' texts, (colspan, rowspan) and what stands in them, bad spans, inline elements."""

    texts: list
    spans: tuple
    insides: list
    bad: int
    inline: int


@lru_cache(4096)
def _tidy_row(row: str) -> Row | None:
    """null where a row isn't cells only, with nothing but spans, texts and inline tags."""
    found = _TIDY_CELL.findall(row)
    if sum([len(x[0]) for x in found]) != len(row):
        return None
    spans, bad = ((1, 1),) * len(found), 0
    if "span=" in row:
        read = [(_span_of(x[2]), _span_of(x[3])) for x in found]
        spans, bad = tuple([(w[0], t[0]) for w, t in read]), sum(w[1] + t[1] for w, t in read)
    insides = [x[4] for x in found]
    inline = row.count("<") - row.count("</") - len(found)
    texts = [_INLINE.sub("", x) if "<" in x else x for x in insides] if inline else insides
    if "&" in row:
        texts = list(map(_cell_text, texts))
    return Row([" ".join(x.split()) for x in texts], spans, insides, bad, inline)


@lru_cache(4096)
def tidy_nodes(row: str) -> tuple:
    """(tag, colspan, rowspan, content) of the cells of a row that is tidy."""
    own = _tidy_row(row)
    return tuple([("td", *spans, _cell_text(_INLINE.sub(_marks, x))) for x, spans in zip(own.insides, own.spans)])


def _marks(tag: re.Match) -> str:
    own = f"{TAG_OPEN}{tag[1]}{tag[2]}{TAG_CLOSE}"
    return own + f"{TAG_OPEN}/br{TAG_CLOSE}" if tag[2] == "br" else own


def _span_of(value: str) -> tuple[int, int]:
    """A span and whether it is bad; none is 1."""
    try:
        return int(value or 1), 0
    except ValueError:
        return 1, 1


def tidy_rows(table: str | None) -> list[tuple[str, list[str]]] | None:
    """The rows, without their tags, of a table_in_front by row group, those outside under an empty name; null where anything would have to be repaired or is no row."""
    if table is None or TAG_OPEN in table or TAG_CLOSE in table:
        return None
    parts = _GROUP.split(table[7:-8])
    out, group = [], ""
    for k in range(0, len(parts), 3):
        if k:
            closing, name = parts[k - 2], parts[k - 1]
            if group != (name if closing else ""):
                return None
            group = "" if closing else name
        if parts[k] or group:  # a group may be empty
            rows = cut_rows(parts[k], _tidy_row)
            if rows is None:
                return None
            out.append((group, rows))
    return None if group else out


def tidy_grid(groups: list[tuple[str, list[str]]]) -> list:
    """grid_of tidy rows."""
    rows = [_tidy_row(row) for _, own in groups for row in own]
    if all([row.spans == ((1, 1),) * len(row.spans) for row in rows]):
        return [row.texts for row in rows]
    texts = [t for row in rows for t in row.texts]
    slots = _slots if len(texts) <= 1000 else _slots.__wrapped__  # large tables aren't held
    return [[texts[i] for i in own] for own in slots(tuple([row.spans for row in rows]))]


@lru_cache(512)
def _slots(spans: tuple) -> list[list[int]]:
    """The grid of cells with these spans, by their numbers. Tables of one layout follow each other."""
    taken: dict[int, dict[int, int]] = {}
    out, n = [], 0
    for r, row in enumerate(spans):
        out.append(spread([(n + i, *s) for i, s in enumerate(row)], r, taken))
        n += len(row)
    return out


def tidy_elements(groups: list[tuple[str, list[Row]]]) -> int:
    """How many elements lie under the table."""
    return sum((group != "") + sum(1 + len(row.spans) + row.inline for row in map(_tidy_row, rows)) for group, rows in groups)


def _cell_text(c: str) -> str:
    if "&" not in c:
        return c
    return c.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#x27;", "'").replace("&amp;", "&")


class Shreds:
    """Shredded tables as the columns of SHREDDED. Plain tables are cut by patterns, others parsed."""

    def __init__(self, ignore_nodes: tuple[str, ...]):
        self.ignored = ignore_nodes
        self.texts, self.row_ends, self.grid_ends = [], [0], [0]  # the grids
        self.nodes, self.node_ends, self.there = {f.name: [] for f in NODE.fields}, [0], []
        self.elements, self.bad = [], []

    def add(self, text: str) -> None:
        table = None if self.ignored else _first_plain(text)
        if table is not None:
            self._plain(table)
        else:
            self._parsed(parse(text))
        self.grid_ends.append(len(self.row_ends) - 1)
        self.node_ends.append(len(self.nodes["tag"]))

    def _plain(self, table: str) -> None:
        tag, wide, tall, first, content, size = self.nodes.values()
        at = 0
        for row in _PLAIN_ROW.findall(table):
            cells = [_cell_text(c) for c in _PLAIN_CELL.findall(row)]
            n = len(cells)
            self.texts += [" ".join(c.split()) for c in cells]
            self.row_ends.append(len(self.texts))
            tag += ["td"] * n
            tag.append("tr")
            spans = [1] * n + [None]
            wide += spans
            tall += spans
            first += range(at, at + n)
            first.append(at)
            content += cells
            content.append(None)
            size += map(len, cells)
            size.append(0)
            at += n + 1
        for column, value in zip(self.nodes.values(), ("table", None, None, 0, None, 0)):
            column.append(value)
        self._close(True, at, 0)

    def _parsed(self, table: Node | None) -> None:
        if table is None:
            self._close(False, 0, 0)
            return
        grid, bad = grid_of(table)
        if self.ignored:
            unwrap(table, self.ignored)
        for row in grid:
            self.texts += row
            self.row_ends.append(len(self.texts))
        for node in nodes_of(table):
            for name, column in self.nodes.items():
                column.append(node[name])
        self._close(True, sum(1 for _ in table.all()), bad)

    def _close(self, there: bool, elements: int, bad: int) -> None:
        self.there.append(there)
        self.elements.append(elements)
        self.bad.append(bad)

    def array(self) -> pa.StructArray:
        ends = lambda x: pa.array(x, pa.int32())
        grid = pa.ListArray.from_arrays(ends(self.grid_ends), pa.ListArray.from_arrays(ends(self.row_ends), pa.array(self.texts, pa.string())))
        own = pa.StructArray.from_arrays([pa.array(self.nodes[f.name], f.type) for f in _ARROW_NODE], fields=list(_ARROW_NODE))
        nodes = pa.ListArray.from_arrays(ends(self.node_ends), own, mask=pa.array([not x for x in self.there], pa.bool_()))
        return pa.StructArray.from_arrays([grid, nodes, pa.array(self.elements, pa.int32()), pa.array(self.bad, pa.int32())], fields=list(_ARROW_SHREDDED))


def _shredder(ignore_nodes: tuple[str, ...]):
    @F.arrow_udf(SHREDDED)
    def run(texts: pa.Array) -> pa.Array:
        out = Shreds(ignore_nodes)
        for text in texts.to_pylist():
            out.add(text or "")
        return out.array()

    return run.asNondeterministic()


def shred_tables(df: DataFrame, column: str, out: str, ignore_nodes: tuple[str, ...] = ()) -> DataFrame:
    """df with struct<grid, nodes, n_elements, bad_spans, shape, digest> of the first table; without one: empty grid, null nodes.

    Equal shapes are trees that differ in cell contents only; equal digests are equal trees. Both are 128-bit hashes.
    ignore_nodes: tags that are taken out of the tree, their content staying in place.
    """
    # named twice, so that the text is a column of its own: Spark does not extract a function whose argument has lambdas
    text = F.col("__text")
    rows = df.withColumn("__text", F.coalesce(F.col(column), F.lit(""))).withColumn("__table", _shredder(ignore_nodes)(F.when(text != "", text)))
    nodes = F.col("__table.nodes")
    shape = F.when(nodes.isNotNull(), _hash128(*[nodes[c] for c in ("tag", "colspan", "rowspan", "leftmost")]))
    return rows.withColumn(out, F.struct("__table.*", shape.alias("shape"), F.when(nodes.isNotNull(), _hash128(nodes)).alias("digest"))).drop("__table", "__text")


class Grids:
    """What Shreds has but trees: grids, or only how many elements there are."""

    def __init__(self, cells: bool):
        self.cells, self.texts, self.row_ends, self.grid_ends, self.elements = cells, [], [0], [0], []

    def add(self, text: str) -> None:
        front = table_in_front(text)
        if front is not None and plain_rows(front) is not None:
            if self.cells:
                for row in _PLAIN_ROW.findall(front):
                    self._row([" ".join(_cell_text(c).split()) for c in _PLAIN_CELL.findall(row)])
            self.elements.append(front.count("</td>") + front.count("</th>") + front.count("</tr>"))
        elif (groups := tidy_rows(front)) is not None:
            if self.cells:
                for row in tidy_grid(groups):
                    self._row(row)
            self.elements.append(tidy_elements(groups))
        else:
            table = parse(text)
            if table is not None and self.cells:
                for row in grid_of(table)[0]:
                    self._row(row)
            self.elements.append(0 if table is None else sum(1 for _ in table.all()))
        self.grid_ends.append(len(self.row_ends) - 1)

    def _row(self, texts) -> None:
        self.texts += texts
        self.row_ends.append(len(self.texts))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _grids(texts: pa.Array) -> pa.Array:
    out, ends = Grids(True), lambda x: pa.array(x, pa.int32())
    for text in texts.to_pylist():
        out.add(text or "")
    return pa.ListArray.from_arrays(ends(out.grid_ends), pa.ListArray.from_arrays(ends(out.row_ends), pa.array(out.texts, pa.string())))


@F.arrow_udf(T.IntegerType())
def _elements(texts: pa.Array) -> pa.Array:
    out = Grids(False)
    for text in texts.to_pylist():
        out.add(text or "")
    return pa.array(out.elements, pa.int32())


def _made(df: DataFrame, column: str, out: str, make) -> DataFrame:
    text = F.col("__text")  # named twice, as in shred_tables
    rows = df.withColumn("__text", F.coalesce(F.col(column), F.lit("")))
    return rows.withColumn(out, make.asNondeterministic()(F.when(text != "", text))).drop("__text")


def shred_grids(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the grid that shred_tables gives; trees are not made."""
    return _made(df, column, out, _grids)


def count_elements(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the n_elements that shred_tables gives; neither grids nor trees are made."""
    return _made(df, column, out, _elements)


def grid_cells(df: DataFrame, grid_col: str, *keys: str) -> DataFrame:
    """The long form: keys, r, c, text; a ragged row has fewer cells."""
    rows = df.select(*keys, F.posexplode(grid_col).alias("r", "__row"))
    return rows.select(*keys, "r", F.posexplode("__row").alias("c", "text"))
