"""Tidy tables inside the JVM: attributes, row groups, spans and inline tags, where every element is closed and nothing is left to repair.

A pattern decides whether a table is tidy: lower-case tags, rows in the table or in row groups, cells in rows, inline elements in cells up to two
deep, attributes with quotes, the references that escaping makes. Such a table is cut by patterns, its rows are folded over a list of
slots taken from above, and its tree is written in post-order. Tables that are not tidy, or whose spans are no plain counts, are null here and go to
the lenient parser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore.functions.textnorm import let, normalize_text

INLINE = "b|i|u|em|strong|sub|sup|span|small|font|code|s|a|p|div"
VOID = "br|img|hr|wbr"
_WS = r"[ \t\n\r]*+"
_ATTRS = r'(?:[ \t\n\r]++[a-z-]++="[^"<>&]*+")*+[ \t\n\r]*+'
_TEXT = r"[^<>&]*+(?:&(?:amp|lt|gt|quot|#x27|nbsp);[^<>&]*+)*+"


def _content(elements: str) -> str:
    return rf"{_TEXT}(?:(?:{elements}){_TEXT})*+"


_EMPTY = rf"<(?:{VOID}){_ATTRS}/?>"
_INNER = rf"<(?<n>{INLINE}){_ATTRS}>{_content(_EMPTY)}</\k<n>>"
_OUTER = rf"<(?<m>{INLINE}){_ATTRS}>{_content(f'{_EMPTY}|{_INNER}')}</\k<m>>"
_CELL = rf"<(?<c>td|th){_ATTRS}>{_content(f'{_EMPTY}|{_OUTER}')}</\k<c>>"
_ROW = rf"<tr{_ATTRS}>{_WS}(?:{_CELL}{_WS})*+</tr>"
_GROUP = rf"</?(?:thead|tbody|tfoot){_ATTRS}>"
#: Rows, and tags of row groups anywhere among them; whether these pair up is seen once the rows are taken out.
TIDY_TABLE = rf"^<table{_ATTRS}>{_WS}(?:(?:{_ROW}|{_GROUP}){_WS})*+</table>$"
_GROUPS = rf"^<table{_ATTRS}>{_WS}(?:<(?<g>thead|tbody|tfoot){_ATTRS}>{_WS}</\k<g>>{_WS})*+</table>$"
_ANY_ROW = r"(?s)<tr(?:[ \t\n\r][^>]*)?>.*?</tr>"
_SECTION = rf"(?s)<(thead|tbody|tfoot)(?:[ \t\n\r][^>]*)?>.*?</\1>|{_ANY_ROW.removeprefix('(?s)')}"
#: A span that counts, and one that is no number and counts 1. A table with any other is not tidy.
_COUNT, _NO_NUMBER = r"^[ \t\n\r]*\+?0*[1-9][0-9]{0,3}[ \t\n\r]*$", r"^[ \t\n\r]*$|[A-Za-z.%]"

TAG_OPEN, TAG_CLOSE = "", ""
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def tidy_table(text: Column, before: str) -> Column:
    """The first table of a text, where it is tidy and only tags that match `before` stand in front; else null."""
    def of(t):
        at = F.regexp_instr(t, F.lit(r"<table[ \t\n\r>]"))
        table = F.concat(F.substring_index(F.substring(t, at, F.length(t)), "</table>", 1), F.lit("</table>"))
        front = F.regexp_replace(F.left(t, at - 1), before, "")
        paired = lambda x: F.regexp_replace(x, _ANY_ROW, "").rlike(_GROUPS)
        return F.when((at > 0) & ~F.contains(front, F.lit("<")), let(table, lambda x: F.when(x.rlike(TIDY_TABLE) & paired(x), x)))

    return let(text, of)


def decoded(c: Column) -> Column:
    def all_of(t):
        for mark, char in _REFERENCES:
            t = F.replace(t, F.lit(mark), F.lit(char))
        return t

    return F.when(F.contains(c, F.lit("&")), all_of(c)).otherwise(c)


def _span(tag: Column, name: str) -> Column:
    """struct<n, bad>: the last attribute of that name; n is null where the table can't be taken here."""
    value = F.regexp_extract(tag, rf'(?s)^.*[ \t\n\r]{name}="([^"]*)"', 1)
    there = F.contains(tag, F.lit(f'{name}="')) & tag.rlike(rf'[ \t\n\r]{name}="')
    count = F.btrim(value, F.lit(" \t\n\r+")).cast("int")
    return F.when(~there, F.struct(F.lit(1).alias("n"), F.lit(0).alias("bad"))).otherwise(
        let(F.struct(value.alias("v")), lambda x: F.when(x["v"].rlike(_COUNT), F.struct(count.alias("n"), F.lit(0).alias("bad"))).when(x["v"].rlike(_NO_NUMBER), F.struct(F.lit(1).alias("n"), F.lit(1).alias("bad"))).otherwise(F.struct(F.lit(None).cast("int").alias("n"), F.lit(0).alias("bad"))))
    )


def _cell(c: Column) -> Column:
    """struct<wide, tall, bad, content, tags, text> of a cell's markup."""
    tag, inner = F.regexp_extract(c, "^<t[dh]([^>]*)>", 1), F.regexp_extract(c, "(?s)^<t[dh][^>]*>(.*)</t[dh]>$", 1)

    def of(x):
        marked = F.regexp_replace(F.regexp_replace(x["inner"], rf"<({VOID})[^>]*>", f"{TAG_OPEN}$1{TAG_CLOSE}{TAG_OPEN}/$1{TAG_CLOSE}"), "<(/?[a-z]+)[^>]*>", f"{TAG_OPEN}$1{TAG_CLOSE}")
        plain = ~F.contains(x["inner"], F.lit("<"))
        content = decoded(F.when(plain, x["inner"]).otherwise(marked))
        bare = lambda t: F.when(plain, t).otherwise(F.regexp_replace(t, f"{TAG_OPEN}[^{TAG_CLOSE}]*{TAG_CLOSE}", ""))
        wide, tall = _span(x["tag"], "colspan"), _span(x["tag"], "rowspan")
        return let(
            F.struct(content.alias("c"), wide.alias("w"), tall.alias("t")),
            lambda y: let(bare(y["c"]), lambda text: F.struct(
                y["w"]["n"].alias("wide"), y["t"]["n"].alias("tall"), (y["w"]["bad"] + y["t"]["bad"]).alias("bad"), y["c"].alias("content"),
                F.when(plain, F.lit(0)).otherwise(F.char_length(y["c"]) - F.char_length(F.replace(y["c"], F.lit(TAG_OPEN), F.lit("")))).alias("tags"),
                F.char_length(text).alias("chars"), normalize_text(text).alias("text"),
            )),
        )

    return let(F.struct(tag.alias("tag"), inner.alias("inner")), of)


def sections(table: Column) -> Column:
    """array<struct<tag, rows>> of a tidy table: row groups, and rows outside of any as groups without a name; rows are arrays of cells (see _cell)."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit("(?s)<t[dh](?:[ \t\n\r][^>]*)?>.*?</t[dh]>"), 0), _cell)
    rows = lambda s: F.transform(F.regexp_extract_all(s, F.lit(_ANY_ROW), 0), cells)
    return F.transform(F.regexp_extract_all(table, F.lit(_SECTION), 0), lambda s: F.struct(F.regexp_extract(s, "^<(thead|tbody|tfoot)", 1).alias("tag"), rows(s).alias("rows")))


_TAKEN = "array<struct<c:int,left:int,text:string>>"


def _spanned_grid(rows: Column) -> Column:
    """Rows after span expansion. A cell's first slot steps over slots taken from above; where it covers further ones, the later cell has them."""
    def carried(row, taken):
        here = lambda c: F.exists(taken, lambda t: t["c"] == c)
        free = lambda n: F.filter(F.sequence(n, n + F.size(taken)), lambda c: ~here(c))[0]
        text = lambda c: F.element_at(F.filter(taken, lambda t: t["c"] == c), -1)["text"]
        return let(F.size(row), lambda n: let(free(n), lambda to: F.when(to > n, F.concat(row, F.transform(F.sequence(n, to - 1), text))).otherwise(row)))

    def place(acc, cell, taken):
        start = F.when(F.size(taken) == 0, acc["row"]).otherwise(carried(acc["row"], taken))

        def put(row):
            at = F.size(row)
            below = F.when(cell["tall"] > 1, F.transform(F.sequence(at, at + cell["wide"] - 1), lambda c: F.struct(c.alias("c"), (cell["tall"] - 1).alias("left"), cell["text"].alias("text"))))
            return F.struct(F.concat(row, F.array_repeat(cell["text"], cell["wide"])).alias("row"), F.when(below.isNotNull(), F.concat(acc["adds"], below)).otherwise(acc["adds"]).alias("adds"))

        return let(start, put)

    def step(acc, row):
        start = F.struct(F.array().cast("array<string>").alias("row"), F.array().cast(_TAKEN).alias("adds"))
        done = F.aggregate(row, start, lambda a, c: place(a, c, acc["taken"]))

        def close(d):
            whole = F.when(F.size(acc["taken"]) == 0, d["row"]).otherwise(carried(d["row"], acc["taken"]))
            older = F.filter(F.transform(acc["taken"], lambda t: F.struct(t["c"].alias("c"), (t["left"] - 1).alias("left"), t["text"].alias("text"))), lambda t: t["left"] > 0)
            return F.struct(F.concat(acc["grid"], F.array(whole)).alias("grid"), F.concat(older, d["adds"]).alias("taken"))

        return let(done, close)

    start = F.struct(F.array().cast("array<array<string>>").alias("grid"), F.array().cast(_TAKEN).alias("taken"))
    return F.aggregate(rows, start, step, lambda a: a["grid"])


def shredded(table: Column) -> Column:
    """struct<grid, nodes, n_elements, bad_spans> of a tidy table; null where a span is neither a count nor no number at all."""
    null = F.lit(None)

    def node(tag, content, back, wide=null, tall=null, size=F.lit(0)):
        return F.struct(tag.alias("tag"), wide.cast("int").alias("colspan"), tall.cast("int").alias("rowspan"), back.cast("int").alias("back"), content.cast("string").alias("content"), size.cast("int").alias("size"))

    def row_nodes(r):
        return F.concat(F.transform(r, lambda c: node(F.lit("td"), c["content"], F.lit(0), c["wide"], c["tall"], c["chars"] + c["tags"])), F.array(node(F.lit("tr"), null, F.size(r))))

    def section_nodes(s):
        return let(F.flatten(F.transform(s["rows"], row_nodes)), lambda u: F.when(s["tag"] == "", u).otherwise(F.concat(u, F.array(node(s["tag"], null, F.size(u))))))

    def of(parts):
        def whole(rows):
            cells = F.flatten(rows)
            simple = F.transform(rows, lambda r: F.flatten(F.transform(r, lambda c: F.array_repeat(c["text"], c["wide"]))))
            grid = F.when(F.exists(cells, lambda c: c["tall"] > 1), _spanned_grid(rows)).otherwise(simple)
            nodes = let(F.flatten(F.transform(parts, section_nodes)), lambda u: F.concat(u, F.array(node(F.lit("table"), null, F.size(u)))))
            placed = F.transform(nodes, lambda x, i: F.struct(x["tag"].alias("tag"), x["colspan"].alias("colspan"), x["rowspan"].alias("rowspan"), (i - x["back"]).alias("leftmost"), x["content"].alias("content"), x["size"].alias("size")))
            inner = F.aggregate(cells, F.lit(0), lambda n, c: n + (c["tags"] / 2).cast("int"))
            bad = F.aggregate(cells, F.lit(0), lambda n, c: n + c["bad"])
            fit = F.forall(cells, lambda c: c["wide"].isNotNull() & c["tall"].isNotNull())
            return F.when(fit, F.struct(grid.alias("grid"), placed.alias("nodes"), (F.size(placed) - 1 + inner).alias("n_elements"), bad.alias("bad_spans")))

        return let(F.flatten(F.transform(parts, lambda s: s["rows"])), whole)

    return let(sections(table), of)
