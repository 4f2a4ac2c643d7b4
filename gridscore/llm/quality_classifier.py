"""Quality classifier: a sparse ensemble of rules.

Small boosted trees are grown on text statistics of labelled rows; every path from a root becomes a
conjunctive rule; a lasso logistic regression over the rules keeps few of them; and what is kept is compiled into one Spark
column expression over the statistics. Fitting takes a bounded sample (`max_rows` labelled rows in hash order); scoring
takes every whole text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.common import held_out

STATISTICS = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "bangs", "bars", "distinct_words", "repeated_triples", "repeated_lines", "line_words", "non_ascii", "spaces")
STATS = T.StructType([T.StructField(n, T.DoubleType()) for n in STATISTICS])

_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?()[]{}\"'_=+/\\@^~`-"
_HIGH, _SPACE = bytes(range(128, 256)), b" \t\n\x0b\x0c\r"


def statistics_of(t: bytes) -> tuple[float, ...]:
    """Shares are of the bytes unless the name says otherwise; an empty text has zeros."""
    n = max(1, len(t))
    share = lambda drop: (len(t) - len(t.translate(None, drop))) / n
    w = t.split()
    k = max(1, len(w))
    lines = [x for x in t.split(b"\n") if x.strip()]
    triples = max(0, len(w) - 2)
    return (
        float(np.log1p(len(w))), sum(map(len, w)) / k, share(_SYMBOLS), share(_UPPER), share(_DIGITS), share(_MARKS), t.count(b"!") / n, t.count(b"|") / n,
        len(set(w)) / k, 1 - len(set(zip(w, w[1:], w[2:]))) / triples if triples else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, len(w) / max(1, len(lines)), share(_HIGH), share(_SPACE),
    )


@F.arrow_udf(STATS)
def statistics(texts: pa.Array) -> pa.Array:
    rows = np.array([statistics_of(t.as_py() or b"") for t in texts], np.float64).reshape(-1, len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATISTICS))], list(STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater, threshold)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > t) if up else (x[:, f] <= t) for f, up, t in rule], np.ones(len(x), bool))


def grow(x: np.ndarray, residual: np.ndarray, features: np.ndarray, depth: int, least: int, path: Rule = ()) -> tuple[list[Rule], np.ndarray]:
    """The rules of a regression tree's nodes below the root, and its prediction for each row."""
    mean = residual.mean() if len(residual) else 0.0
    flat = np.full(len(x), mean)
    if not depth or len(x) < 2 * least:
        return [], flat
    best = (1e-9, -1, 0.0)
    for f in features:
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))):
            low = x[:, f] <= t
            n = int(low.sum())
            if least <= n <= len(x) - least:
                a = residual[low].sum()
                b = residual.sum() - a
                gain = a * a / n + b * b / (len(x) - n) - residual.sum() ** 2 / len(x)
                if gain > best[0]:
                    best = (gain, int(f), float(t))
    if best[1] < 0:
        return [], flat
    _, f, t = best
    low = x[:, f] <= t
    rules, out = [], flat
    for side, up in ((low, False), (~low, True)):
        rule = (*path, (f, up, t))
        more, out[side] = grow(x[side], residual[side], features, depth - 1, least, rule)
        rules += [rule, *more]
    return rules, out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights, by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, k = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    step = 4.0 / max(1e-9, np.linalg.norm(a.T @ a / n, 2))
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / n
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - step * penalty)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


class RuleEnsemble:
    """intercept + sum of weights of the rules that hold, through the logistic function."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 1e-3, seed: int = 7):
        self.rules: list[Rule] = []
        self.weights = np.zeros(0)
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.intercept = float(np.log(p / (1 - p)))
        if len(y) < 20 or y.min() == y.max():
            return
        rng = np.random.default_rng(seed)
        margin, found = np.full(len(y), self.intercept), {}
        for _ in range(trees):
            rows = rng.random(len(y)) < 0.5
            residual = y - 1 / (1 + np.exp(-margin))
            features = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
            rules, _ = grow(x[rows], residual[rows], features, depth, max(5, len(y) // 200))
            for r in rules:
                found.setdefault(r, None)
            if rules:
                leaf = np.column_stack([holds(x, r) for r in rules]).astype(float)
                fitted, *_ = np.linalg.lstsq(np.hstack([np.ones((len(y), 1)), leaf]), residual, rcond=None)
                margin = margin + 2.0 * (np.hstack([np.ones((len(y), 1)), leaf]) @ fitted)
        rules = list(found)
        z = np.column_stack([holds(x, r) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
        self.intercept, w = lasso_logistic(z, y, penalty)
        self.rules = [r for r, v in zip(rules, w) if v]
        self.weights = w[w != 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((v * holds(x, r) for v, r in zip(self.weights, self.rules)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """The ensemble as a column expression over the struct of statistics."""
        total = F.lit(self.intercept)
        for v, rule in zip(self.weights.tolist(), self.rules):
            one = lambda f, up, t: stats[STATISTICS[f]] > t if up else stats[STATISTICS[f]] <= t
            total = total + F.when(reduce(lambda a, b: a & b, [one(*c) for c in rule]), F.lit(v)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **options) -> RuleEnsemble:
    """From labelled rows that aren't held out: at most max_rows ids, in hash order, which are broadcast, and at most max_rows
    rows of statistics, which come to the driver.

    Null ids and labels are left out. Repeated labels of an id count once, and differing ones once each; repeated documents count once each, up to
    the limit. With fewer than 20 rows or one class, the score is the share of label 1 (0.5 for no rows).
    """
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    picked = picked.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"), F.xxhash64(F.col(id_col).cast("string")).alias("__h")).distinct().orderBy("__h", "__id", "__y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")
    rows = rows.select("__h", "__y", statistics(F.col("__text").cast("binary")).alias("s")).select("__h", "__y", "s.*").orderBy("__h", "__y", *STATISTICS).limit(max_rows).toPandas()
    return RuleEnsemble(rows[list(STATISTICS)].to_numpy(np.float64), rows["__y"].to_numpy(np.float64), **options)


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, from 0 to 1; null and empty texts have the statistics of an empty text. Every row and column stays, but for one that is named as `out`.

    Texts of any length are read whole; equal texts get equal scores; an empty table gives an empty table.
    """
    return docs.drop(out).withColumn("__stats", statistics(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).withColumn(out, model.column(F.col("__stats"))).drop("__stats")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.7 or more), a row per row of docs; rows as in score."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
