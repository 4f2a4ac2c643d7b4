"""Cell and number scores of a pair of grids. Both grids of a pair are in one row, so cells meet by position without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore.functions.textnorm import let, normalize_cell_text, normalize_number


def _total(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(0), lambda a, r: a + F.size(r))


def cell_f1(pred: Column, truth: Column) -> Column:
    """struct of precision, recall, f1, correct, pred_total, gt_total; cells that only one side has count in its total; 0 where nothing is to divide by."""
    same = F.zip_with(pred, truth, lambda p, t: F.coalesce(F.size(F.filter(F.zip_with(p, t, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a == b) | (normalize_cell_text(a) == normalize_cell_text(b)))), lambda x: x)), F.lit(0)))
    correct = F.aggregate(F.transform(same, lambda n: F.greatest(n, F.lit(0))), F.lit(0), lambda a, n: a + n)
    return cell_scores(correct, _total(pred), _total(truth))


def equal_cell_f1(grid: Column) -> Column:
    """cell_f1 of a grid and itself."""
    return let(_total(grid), lambda n: cell_scores(n, n, n))


def equal_numeric_accuracy(grid: Column) -> Column:
    """numeric_accuracy of a grid and itself."""
    numbers = lambda r: F.size(F.filter(r, lambda c: c.rlike(r"(?U)\d")))
    return let(F.aggregate(grid, F.lit(0), lambda a, r: a + numbers(r)), lambda n: F.struct((n / F.nullif(n, F.lit(0))).alias("accuracy"), n.alias("correct"), n.alias("total")))


def cell_scores(correct: Column, pred_total: Column, gt_total: Column) -> Column:
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    counts = F.struct(correct.alias("c"), pred_total.alias("p"), gt_total.alias("g"))
    rates = let(counts, lambda n: F.struct(ratio(n["c"], n["p"]).alias("p"), ratio(n["c"], n["g"]).alias("r"), n.alias("n")))
    f1 = lambda x: F.when(x["p"] + x["r"] > 0, 2 * x["p"] * x["r"] / (x["p"] + x["r"])).otherwise(0.0)
    return let(rates, lambda x: F.struct(x["p"].alias("precision"), x["r"].alias("recall"), f1(x).alias("f1"), x["n"]["c"].alias("correct"), x["n"]["p"].alias("pred_total"), x["n"]["g"].alias("gt_total")))


def numeric_accuracy(pred: Column, truth: Column) -> Column:
    """struct of accuracy (null without numeric truth cells), correct, total; only truth cells with a digit count."""
    def hit(t, p):
        same = (p == t) | (normalize_number(p) == normalize_number(t))
        return F.when(t.rlike(r"(?U)\d"), F.coalesce(same, F.lit(False)).cast("int"))

    hits = F.transform(truth, lambda row, r: let(F.get(pred, r), lambda other: F.transform(row, lambda t, c: hit(t, F.get(other, c)))))
    counted = F.filter(F.flatten(hits), lambda x: x.isNotNull())
    return let(counted, lambda h: let(F.aggregate(h, F.lit(0), lambda a, x: a + x), lambda n: F.struct((n / F.nullif(F.size(h), F.lit(0))).alias("accuracy"), n.alias("correct"), F.size(h).alias("total"))))
