"""Queries over tables with row groups, inline tags, spans that overlap and spans that are no numbers; the SQL computes what must come out of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscore.operators.compared import compare_trees
from gridscore.operators.shred import TAG_OPEN, grid_cells, shred_grids, shred_tables
from gridscore.operators.treedist import text_scores
from gridscore.plans.derive import samples

_HEAD = '<thead><tr><th rowspan="2">Order</th><th colspan="2">Amounts</th><th colspan="x">Flag</th></tr><tr><th>Qty</th><th><b>Price</b></th><th>F</th></tr></thead>'
_FOOT = '<tfoot><tr><td rowspan="2">a</td><td>b</td><td rowspan="2">c<br></td></tr><tr><td colspan="2">wide</td></tr></tfoot>'


def _ungrouped(html):
    return F.regexp_replace(html, "</?t(?:head|body|foot)>", "")


def _tables(spark, d):
    """(k, html): one table for each order; its key spans all lines, and on every third order one row more, so that the foot's cells move and meet."""
    own = samples(spark, d).select(F.col("o_orderkey").alias("k"), F.slice("grid", 2, F.size("grid")).alias("lines"))
    key = F.col("k").cast("string")
    tall = (F.size("lines") + F.when(F.col("k") % 3 == 0, 1).otherwise(0)).cast("string")

    def row(x, i):
        first = F.concat(F.lit('<tr><td rowspan="'), tall, F.lit('">'), key, F.lit("</td><td>"), x[1], F.lit("</td><td>"), x[2])
        later = F.concat(F.lit("<tr><td>"), x[1], F.lit("</td><td><i>"), x[2], F.lit("</i>"))
        return F.concat(F.when(i == 0, first).otherwise(later), F.lit("</td><td>"), x[3], F.lit("</td></tr>"))

    body = F.concat(F.lit("<tbody>"), F.array_join(F.transform("lines", row), ""), F.lit("</tbody>"))
    html = F.concat(F.lit("<table>" + _HEAD), body, F.lit(_FOOT + "</table>"))
    return own.select("k", html.alias("html"))  # samples are placed already


def q_span_cells(spark, d):
    return grid_cells(shred_grids(_tables(spark, d).select("k", "html"), "html", "grid"), "grid", "k")


_LINES = """l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n,
  CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) AS qty, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS price, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
o AS (SELECT k, max(n) AS n, k % 3 = 0 AS more FROM l GROUP BY k)"""
_CELLS_SQL = f"""WITH {_LINES},
cell AS (SELECT k, v.r, v.c, v.t FROM o, (VALUES (0, 0, 'Order'), (0, 1, 'Amounts'), (0, 2, 'Amounts'), (0, 3, 'Flag'), (1, 0, 'Order'), (1, 1, 'Qty'), (1, 2, 'Price'), (1, 3, 'F')) v(r, c, t)
  UNION ALL SELECT k, r + 1, 0, CAST(k AS VARCHAR) FROM l UNION ALL SELECT k, r + 1, 1, qty FROM l UNION ALL SELECT k, r + 1, 2, price FROM l UNION ALL SELECT k, r + 1, 3, flag FROM l
  UNION ALL SELECT k, n + 2, 0, CAST(k AS VARCHAR) FROM o WHERE more UNION ALL SELECT k, n + 2, v.c + CAST(more AS INTEGER), v.t FROM o, (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(c, t)
  UNION ALL SELECT k, n + 3, v.c, 'wide' FROM o, (VALUES (0), (1)) v(c) WHERE more UNION ALL SELECT k, n + 3, v.c, v.t FROM o, (VALUES (0, 'a'), (1, 'wide'), (2, 'wide')) v(c, t) WHERE NOT more)
SELECT k, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, t AS text FROM cell"""


def q_span_trees(spark, d):
    """What the trees are made of: elements, nodes, spans, token counts, row groups, and cells whose content has tags."""
    t = shred_tables(_tables(spark, d), "html", "t").select("k", "t.*")
    total = lambda of: F.aggregate("nodes", F.lit(0), lambda a, x: a + F.coalesce(of(x), F.lit(0)))
    marked = lambda x: F.when(F.contains(x["content"], F.lit(TAG_OPEN)), 1)
    group = F.array_join(F.transform(F.filter("nodes", lambda x: x["tag"].isin("thead", "tbody", "tfoot")), lambda x: F.concat(x["tag"], F.lit(" "), x["leftmost"].cast("string"))), ", ")
    return t.select(
        "k", "n_elements", "bad_spans", F.size("nodes").alias("n_nodes"), total(lambda x: x["colspan"]).alias("colspans"), total(lambda x: x["rowspan"]).alias("rowspans"),
        total(lambda x: x["size"]).alias("tokens"), total(marked).alias("marked"), group.alias("groups"),
    )


# 3 + 3 header cells in 2 rows, 3n + 1 body cells in n rows, 3 + 1 footer cells in 2 rows, 3 groups; b, an i a later line, br.
_TREES_SQL = f"""WITH {_LINES}, s AS (SELECT k, sum(length(qty) + length(price) + length(flag)) AS chars FROM l GROUP BY k)
SELECT o.k, CAST(4 * n + 18 + 1 + (n - 1) + 1 AS INTEGER) AS n_elements, 1 AS bad_spans, CAST(4 * n + 19 AS INTEGER) AS n_nodes, CAST(3 * n + 11 + 2 AS INTEGER) AS colspans, CAST(3 * n + 11 + 1 + (n + CAST(more AS INTEGER) - 1) + 2 AS INTEGER) AS rowspans,
 CAST(chars + length(CAST(o.k AS VARCHAR)) + 2 * (n - 1) + length('OrderAmountsFlagQtyPriceFabcwide') + 4 AS INTEGER) AS tokens, CAST(n - 1 + 2 AS INTEGER) AS marked,
 'thead 0, tbody 9, tfoot ' || (9 + 4 * n + 2) AS groups FROM o JOIN s ON o.k = s.k"""


def q_ignored_tags(spark, d):
    """Tables with row groups against the same without: three deletions, none where the groups are ignored. Each is rendered once, and read in one pass for both."""
    tags = ("thead", "tbody", "tfoot")
    both = _tables(spark, d).select("k", _ungrouped(F.col("html")).alias("html"), F.col("html").alias("gt_html"))
    both = both.withColumn("__c", compare_trees(F.col("html"), F.col("gt_html"))).withColumn("__i", compare_trees(F.col("html"), F.col("gt_html"), tags))
    hard = lambda c: F.when(F.col("__i.hard"), F.col(c))
    plain = text_scores(both.withColumns({"__a": hard("html"), "__b": hard("gt_html")}), "__c").select("k", F.round("teds", 9).alias("plain"), "__i", F.col("__a").alias("html"), F.col("__b").alias("gt_html"))
    return text_scores(plain, "__i", ignore_nodes=tags).select("k", F.col("plain").alias("teds"), F.col("teds").alias("teds_ignoring"), F.col("teds_s").alias("teds_s_ignoring"))


_IGNORED_SQL = f"WITH {_LINES} SELECT k, round(1 - 3.0::DOUBLE / (5 * n + 19), 9) AS teds, 1.0::DOUBLE AS teds_ignoring, 1.0::DOUBLE AS teds_s_ignoring FROM o"

ENTRIES = {"span_cells": (q_span_cells, _CELLS_SQL), "span_trees": (q_span_trees, _TREES_SQL), "ignored_tags": (q_ignored_tags, _IGNORED_SQL)}
