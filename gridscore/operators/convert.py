"""Response text to tables: printable texts with one Arrow function (see printable), others with higher-order functions and the parser.

Each native converter returns a grid (array of rows, each an array of cell texts) or null; the first that applies wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.functions.textnorm import NOTE_ROW, clean_cell_text, clean_latex_text, escape_html, let, lines, strip
from gridscore.operators.notes import without_notes
from gridscore.operators.printable import convert_printable
from gridscore.operators.shred import with_first_table

GRID = "array<array<string>>"
# The formats' own marks.
FENCE = r"(?is)```(?:html)?\s*(.*?)```"
_SEPARATOR = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"
_TOKEN = "<(fcel|ecel|lcel|ucel)>"
_PLACED = r"(?U)^(.*?)\s*\[\[\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\]\]\s*$"


def strip_fence(text: Column) -> Column:
    """The body of the first code fence, else the text, without white space at the ends."""
    return let(strip(text), lambda t: F.when(t.rlike(FENCE), strip(F.regexp_extract(t, FENCE, 1))).otherwise(t))


def _pipe_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), clean_cell_text)


def _padded(rows: Column) -> Column:
    return let(F.array_max(F.transform(rows, F.size)), lambda width: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))


def markdown_grid(text: Column) -> Column:
    """Lines that begin and end with a pipe, a dash line second; rows may differ in width."""
    def of(rows):
        body = F.concat(F.slice(rows, 1, 1), F.slice(rows, 3, F.greatest(F.size(rows), F.lit(1))))
        return F.when((F.size(rows) >= 2) & F.get(rows, F.lit(1)).rlike(_SEPARATOR), F.transform(body, _pipe_cells))

    return let(F.filter(F.transform(lines(text), strip), lambda x: x.startswith("|") & x.endswith("|")), of)


def loose_markdown_grid(text: Column) -> Column:
    """Lines with two pipes or more, without dash lines and one-cell rows, padded."""
    rows = F.transform(F.filter(F.transform(lines(text), strip), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2), _pipe_cells)
    dashes = lambda r: F.forall(r, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$"))
    return let(F.filter(rows, lambda r: ~dashes(r) & (F.size(r) >= 2)), lambda kept: F.when(F.size(kept) > 0, _padded(kept)))


def token_grid(text: Column) -> Column:
    """Rows end at <nl>; only <fcel> cells keep their text; blank rows go; two rows or more, padded."""
    def row(segment):
        bodies, kinds = F.split(segment, _TOKEN, -1), F.regexp_extract_all(segment, F.lit(_TOKEN), 1)
        return F.zip_with(kinds, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda k, b: F.when(k == "fcel", clean_latex_text(b)).otherwise(""))

    rows = F.filter(F.transform(F.split(text, "<nl>", -1), row), lambda r: F.exists(r, lambda c: c != ""))
    return F.when(F.contains(text, F.lit("<fcel>")) & F.contains(text, F.lit("<nl>")), let(rows, lambda r: F.when(F.size(r) >= 2, _padded(r))))


def coordinate_grid(text: Column, notes: str = NOTE_ROW) -> Column:
    """A grid from lines `label [[x1,y1,x2,y2]]`, else null.

    Labels are folded into rows against each row's first item, column centres are folded over sorted x, and each label
    goes to the nearest centre. Each step is bound once, so that no fold is written out twice.
    """
    def item(line, i):
        n = lambda k: F.regexp_extract(line, _PLACED, k).cast("double")
        return F.when(line.rlike(_PLACED), F.struct(((n(3) + n(5)) / 2).alias("y"), ((n(2) + n(4)) / 2).alias("x"), i.alias("i"), F.greatest(F.lit(1.0), n(5) - n(3)).alias("h"), clean_cell_text(F.regexp_extract(line, _PLACED, 1)).alias("t")))

    def into_rows(items):
        """Arrays of (x, order, text), a row each: one fold over the sorted labels finds where rows start, and rows are slices."""
        tol = F.greatest(F.lit(8.0), 0.75 * F.get(F.array_sort(F.transform(items, lambda s: s["h"])), F.floor(F.size(items) / 2).cast("int")))

        def starts(tol):
            def step(a, s):
                new = (a["k"] == 0) | (F.abs(a["y"] - s["y"]) > tol)
                return F.struct(F.when(new, s["y"]).otherwise(a["y"]).alias("y"), (a["k"] + 1).alias("k"), F.when(new, F.concat(a["at"], F.array(a["k"]))).otherwise(a["at"]).alias("at"))

            start = F.struct(F.lit(0.0).alias("y"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("at"))
            return F.aggregate(items, start, step, lambda a: F.concat(a["at"], F.array(a["k"])))

        def cut(at):
            def row(i):
                first = F.get(at, i)
                own = F.slice(items, first + 1, F.get(at, i + 1) - first)
                return F.array_sort(F.transform(own, lambda s, j: F.struct(s["x"].alias("x"), j.alias("i"), s["t"].alias("t"))))

            return F.transform(F.sequence(F.lit(0), F.size(at) - 2), row)

        return let(let(tol, starts), cut)

    def centres(xs):
        """Sorted x folded into column centres; only the last centre moves."""
        def fold(tol):
            def step(a, x):
                far = F.abs(a["last"] - x) > tol
                return F.when(a["last"].isNull(), F.struct(a["done"].alias("done"), x.alias("last"))).otherwise(
                    F.struct(F.when(far, F.concat(a["done"], F.array(a["last"]))).otherwise(a["done"]).alias("done"), F.when(far, x).otherwise((a["last"] + x) / 2).alias("last"))
                )

            start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(None).cast("double").alias("last"))
            return F.aggregate(xs, start, step, lambda a: F.concat(a["done"], F.filter(F.array(a["last"]), lambda x: x.isNotNull())))

        return let(F.greatest(F.lit(24.0), (F.array_max(xs) - F.array_min(xs)) / 24), fold)

    def grid(rows):
        wide = lambda n: F.flatten(F.transform(F.filter(rows, lambda r: F.size(r) >= n), lambda r: F.transform(r, lambda s: s["x"])))
        xs = let(wide(3), lambda w: F.when(F.size(w) >= 2, w).otherwise(wide(2)))

        def fill(cols):
            nearest = lambda x: F.array_min(F.transform(cols, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i"))))["i"]
            at = F.transform(rows, lambda r: F.transform(r, lambda s: F.struct(nearest(s["x"]).alias("c"), s["t"].alias("t"))))
            cells = F.transform(at, lambda r: F.transform(cols, lambda _, j: F.array_join(F.transform(F.filter(r, lambda s: s["c"] == j), lambda s: s["t"]), " ")))
            kept = F.filter(cells, lambda r, i: (F.size(F.filter(r, lambda c: c != "")) >= 2) | (i < 2))
            return F.when(F.size(cols) >= 2, let(kept, lambda k: F.when(F.size(k) >= 2, k)))

        enough = F.size(F.filter(rows, lambda r: F.size(r) >= 2)) >= 2
        return F.when(enough, let(let(F.array_sort(xs), centres), fill))

    found = F.filter(F.transform(F.transform(lines(text), strip), item), lambda s: s.isNotNull() & (s["t"] != "") & ~s["t"].rlike(notes))
    return F.when(F.contains(text, F.lit("[[")), let(F.array_sort(found), lambda items: F.when(F.size(items) >= 4, let(into_rows(items), grid))))


def cells_to_html(grid: Column) -> Column:
    """A table whose first row has header cells, texts escaped."""
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<html><body><table>"), F.array_join(F.transform(grid, lambda r, i: F.when(i == 0, row(r, "th")).otherwise(row(r, "td"))), ""), F.lit("</table></body></html>"))


def _or_else(name: str, rest: Column):
    return lambda g: F.when(g.isNotNull(), F.struct(F.lit(name).alias("tag"), g.alias("grid"))).otherwise(rest)


def convert_responses(df: DataFrame, text_col: str, strip_notes: bool = True, notes: str = NOTE_ROW) -> DataFrame:
    """df with html, conversion_ok, conversion_tag and removed_rows (captions and rows that match `notes`, where strip_notes).

    Tags: empty_output, no_table_html, a converter's name, null for HTML. Null text is empty.
    """
    given = F.col("__given")  # named more than once, so that it is a column of its own: Spark does not extract a function whose argument has lambdas
    df = df.withColumn("__given", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__printable", convert_printable(F.when(given != "", given), strip_notes, notes))
    done = F.col("__printable.removed").isNotNull()
    df = df.withColumn("__body", F.when(done, "").otherwise(let(given, strip_fence)))  # the expressions read what is left
    df = with_first_table(df.withColumn("__html", F.when(F.col("__body").rlike(r"(?i)<table[\s>/]"), F.col("__body"))), "__html", "__table", notes if strip_notes else None)
    made = F.lit(None).cast(f"struct<tag:string,grid:{GRID}>")
    for name, make in (("coordinate_ocr_no_merge", lambda t: coordinate_grid(t, notes)), ("paddle_token_table_no_merge", token_grid), ("loose_markdown_table_no_merge", loose_markdown_grid), ("markdown_table_no_merge", markdown_grid)):
        # from the last choice to the first: a grid, else what comes after
        made = let(make(F.col("__body")), _or_else(name, made))
    cut = (lambda g: without_notes(g, notes)) if strip_notes else (lambda g: g)
    native = let(made, lambda m: F.when(m.isNotNull(), let(cut(m["grid"]), lambda g: F.struct(m["tag"].alias("tag"), cells_to_html(g).alias("html"), (F.size(m["grid"]) - F.size(g)).alias("removed")))))
    df = df.withColumn("__made", F.when(F.col("__table.html").isNull() & (F.col("__body") != ""), native))
    ok = F.col("__table.html").isNotNull() | F.col("__made").isNotNull()
    tag = F.when(given == "", "empty_output").when(F.col("__table.html").isNotNull(), F.lit(None)).otherwise(F.coalesce("__made.tag", F.lit("no_table_html")))
    return (
        df.withColumn("conversion_tag", F.when(done, F.col("__printable.tag")).otherwise(tag))
        .withColumn("html", F.coalesce("__printable.html", "__table.html", "__made.html", F.lit("")))
        .withColumn("conversion_ok", F.when(done, F.col("__printable.html") != "").otherwise(ok))
        .withColumn("removed_rows", F.coalesce("__printable.removed", "__table.removed", "__made.removed", F.lit(0)))
        .drop("__given", "__printable", "__body", "__html", "__table", "__made")
    )
