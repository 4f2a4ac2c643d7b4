"""Scores of predictions, run summaries, comparisons, rankings and what they conclude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.functions.runs import short_run_label
from gridscore.functions.textnorm import normalize_cell_text, normalize_number, parse_flag
from gridscore.operators.compared import compare_texts
from gridscore.operators.metrics import cell_f1, cell_scores, equal_cell_f1, equal_numeric_accuracy, numeric_accuracy
from gridscore.operators.once import RULES, shredded_tables, text_digest
from gridscore.operators.ordinal import amount_before
from gridscore.operators.shred import shred_tables
from gridscore.operators.treedist import text_scores, tree_scores
from gridscore.operators.upsert import latest_here
from gridscore.sources.shared import new_path, or_empty, store
from gridscore.sources.sizes import few

SCORE_COLUMNS = (
    "dataset", "run_id", "sample_id", "image", "teds", "teds_s", "numeric_cell_accuracy", "numeric_cells_correct", "numeric_cells_total", "cell_precision", "cell_recall", "cell_f1",
    "cell_text_correct", "pred_cells_total", "gt_cells_total", "run_ok", "conversion_ok", "run_failure", "conversion_failure", "seconds", "error",
)


#: Scores of a pair of texts where both run and conversion succeeded, as they are kept.
_COUNTED = ("numeric_cells_correct", "numeric_cells_total", "cell_text_correct", "pred_cells_total", "gt_cells_total")
_SHARES = ("numeric_cell_accuracy", "cell_precision", "cell_recall", "cell_f1", "teds", "teds_s")
_PAIR_SCORES = ", ".join(["p_text binary", "g_text binary", *[f"{c} int" for c in _COUNTED], *[f"{c} double" for c in _SHARES]])


def score_runs(samples: DataFrame, predictions: DataFrame, runs: DataFrame | None = None, order_col: str = "seq", mode: str = "chars", shredded: str | None = None, placed: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One score row for each sample of a dataset and run of it; a missing prediction is a failed run.

    samples: dataset, sample_id, image, gt_html. predictions: dataset, run_id, sample_id, order_col, html, run_ok, conversion_ok, seconds,
    error; the last by order_col counts. runs: dataset, run_id; those of the predictions unless given. Tables
    are shuffled once, as texts and by sample, and read in one pass over the pairs; runs meet samples as ids only, to find what is missing. Tree and cell
    scores need a run and a conversion that succeeded; the number score needs the conversion only. Predictions without a sample are ignored.
    shredded: a folder where shredded tables and the scores of their pairs are kept, by text and version of the rules (see once); what lies there is neither shredded nor scored again.
    placed: samples are partitioned by dataset and sample_id, into spark.sql.shuffle.partitions parts, and stay where they are; predictions go to them.
    carry: further columns of predictions that their score rows keep; null where there is none.
    """
    by, keys = ["dataset", "sample_id"], ["dataset", "run_id", "sample_id"]
    # a pair is few bytes and much work, so the number of partitions is set and not left to coalescing by size
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = predictions.select(*keys, order_col, "html", "run_ok", "conversion_ok", "seconds", "error", *carry).repartition(n, *by)
    last = latest_here(told, ["sample_id", "dataset", "run_id"], order_col).drop(order_col)  # sorted by what tells most first
    last = last.withColumn("html", F.when(F.coalesce("conversion_ok", F.lit(False)), F.col("html")))
    if runs is not None:
        last = last.join(few(runs.select("dataset", "run_id").distinct()), ["dataset", "run_id"], "left_semi")
    truth = samples.select("dataset", "sample_id", "image", "gt_html")
    if shredded:
        scored = kept_scores(last, truth, shredded, mode, carry)
    else:
        scored = score_texts(text_pairs(last, truth, placed), mode, carry)
    missing = _missing(samples, predictions, runs).withColumns({c: F.lit(None).cast(predictions.schema[c].dataType) for c in carry})
    return scored.unionByName(missing)


def kept_scores(predictions: DataFrame, samples: DataFrame, path: str, mode: str = "chars", carry: tuple[str, ...] = ()) -> DataFrame:
    """Score rows of predictions beside their samples, by way of tables at path: shredded texts, and scores of pairs of texts.

    Both sides are stored once with their texts' digests. Rows, pairs and kept scores meet by digests; only the texts of pairs that were
    never scored move, and are shredded where they meet: a text is a small part of its tree. A text that repeats its truth's brings no second tree.
    """
    spark = predictions.sparkSession
    ok = F.coalesce("conversion_ok", F.lit(False))
    told = store(predictions.withColumn("p_text", F.when(ok, text_digest(F.col("html")))), new_path(spark, "told"))
    truth = store(samples.withColumn("g_text", text_digest(F.col("gt_html"))), new_path(spark, "truth"))
    shredded_tables(told.where(ok), "html", path)
    shredded_tables(truth, "gt_html", path)
    pairs = told.drop("html").join(truth.drop("gt_html").hint("merge"), ["dataset", "sample_id"])
    at = f"{path}/scores-{mode}/version={RULES}"
    known = lambda: or_empty(lambda: spark.read.schema(_PAIR_SCORES).parquet(at), spark, _PAIR_SCORES)
    wanted = pairs.where("p_text IS NOT NULL").select("p_text", "g_text").distinct()
    lacking = store(wanted.join(known().select("p_text", "g_text").hint("merge"), ["p_text", "g_text"], "left_anti"), new_path(spark, "lacking"))
    if not lacking.isEmpty():
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work in each row: not left to coalescing
        text = lambda df, key, column: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.first(column).alias(column))
        met = lacking.join(text(truth, "g_text", "gt_html").hint("merge"), "g_text")
        met = met.where("p_text <> g_text").join(text(told, "p_text", "html").hint("merge"), "p_text").unionByName(met.where("p_text = g_text").withColumn("html", F.lit(None).cast("string")))
        trees = shred_tables(shred_tables(met.repartition(n, "p_text", "g_text"), "html", "p"), "gt_html", "g").drop("html", "gt_html")
        trees = trees.withColumn("p", F.when(F.col("p_text") == F.col("g_text"), F.col("g")).otherwise(F.col("p")))
        sure = trees.withColumn("run_ok", F.lit(True)).withColumn("conversion_ok", F.lit(True))
        _scored_pairs(sure, mode).select("p_text", "g_text", *_COUNTED, *_SHARES).write.mode("append").parquet(at)
    met = pairs.join(known().hint("merge"), ["p_text", "g_text"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("run_ok", "conversion_ok")})
    both = F.col("run_ok") & F.col("conversion_ok")
    counts = lambda c: F.col("conversion_ok") if c.startswith("numeric") else both
    return met.withColumns({
        **{c: F.when(counts(c), F.col(c)).otherwise(0) for c in _COUNTED}, **{c: F.when(counts(c), F.col(c)).otherwise(0.0) for c in _SHARES},
        "run_failure": ~F.col("run_ok"), "conversion_failure": F.col("run_ok") & ~F.col("conversion_ok"),
    }).select(*SCORE_COLUMNS, *carry)


def text_pairs(predictions: DataFrame, samples: DataFrame, placed: bool = False) -> DataFrame:
    """predictions beside their samples, as texts, by dataset and sample, by which predictions are partitioned, and samples where they are placed."""
    by = ["dataset", "sample_id"]
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return predictions.join((samples if placed else samples.repartition(n, *by)).hint("merge"), ["sample_id", "dataset"])


def compared_pairs(pairs: DataFrame, where: Column | None = None) -> DataFrame:
    """pairs with html and gt_html, nulls as empty, and __c: what compare_texts gives, where the condition holds."""
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("html", "gt_html")})
    html = F.col("html") if where is None else F.when(where, F.col("html"))
    return pairs.withColumn("__c", compare_texts(html, F.when(F.col("html") != F.col("gt_html"), F.col("gt_html"))))


def shredded_pairs(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """predictions (with html) beside their samples (with gt_html) by dataset and sample, both texts replaced by shredded tables p and g.

    Texts are shuffled, never trees. A prediction that repeats the truth's text has its shredded table, and is not shredded again.
    """
    by = ["dataset", "sample_id"]
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    truth = shred_tables(samples.repartition(n, *by), "gt_html", "g")
    met = predictions.repartition(n, *by).join(truth.hint("merge"), by)
    same = F.coalesce(F.col("html") == F.col("gt_html"), F.lit(False))
    met = shred_tables(met.withColumn("__same", same).withColumn("__html", F.when(~same, F.col("html"))), "__html", "p")
    return met.withColumn("p", F.when(F.col("__same"), F.col("g")).otherwise(F.col("p"))).drop("html", "gt_html", "__same", "__html")


def _missing(samples: DataFrame, predictions: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Score rows of samples that a run has no prediction for."""
    by = ["dataset", "sample_id"]
    # a sample's runs meet it as one row, so that samples and predictions that are placed stay where they are
    found = predictions.groupBy(*by).agg(F.collect_set("run_id").alias("__found"))
    wanted = samples.select(*by, "image").join(found.hint("merge"), by, "left").join(few((predictions if runs is None else runs).select("dataset", "run_id").distinct()), "dataset")
    rows = wanted.where(~F.coalesce(F.array_contains("__found", F.col("run_id")), F.lit(False))).drop("__found")
    no, zero, none = F.lit(False), F.lit(0.0), F.lit(0)
    values = {c: zero for c in ("teds", "teds_s", "numeric_cell_accuracy", "cell_precision", "cell_recall", "cell_f1")}
    values |= {c: none for c in ("numeric_cells_correct", "numeric_cells_total", "cell_text_correct", "pred_cells_total", "gt_cells_total")}
    values |= {"run_ok": no, "conversion_ok": no, "run_failure": F.lit(True), "conversion_failure": no, "seconds": F.lit(None).cast("double"), "error": F.lit(None).cast("string")}
    return rows.withColumns(values).select(*SCORE_COLUMNS)


def score_pairs(pairs: DataFrame, mode: str = "chars") -> DataFrame:
    """Score rows of pairs: ids, image, g and p (shredded tables), run_ok, conversion_ok, seconds, error."""
    return _scored_pairs(pairs, mode).select(*SCORE_COLUMNS)


def _scored_pairs(pairs: DataFrame, mode: str) -> DataFrame:
    """pairs with g, p, run_ok and conversion_ok: the scores beside the other columns."""
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("run_ok", "conversion_ok")})
    both = F.col("run_ok") & F.col("conversion_ok")
    empty = F.array().cast("array<array<string>>")
    p, g = F.coalesce("p.grid", empty), F.col("g.grid")
    same = F.coalesce(F.col("p.digest") == F.col("g.digest"), F.lit(False))  # equal trees have equal grids
    cells = F.when(both & same, equal_cell_f1(g)).when(both, cell_f1(p, g))
    numbers = F.when(F.col("conversion_ok") & same, equal_numeric_accuracy(g)).when(F.col("conversion_ok"), numeric_accuracy(p, g))
    pairs = pairs.withColumn("__cells", cells).withColumn("__numbers", numbers)
    pairs = tree_scores(pairs, "p", "g", both, mode)
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return pairs.withColumns({
        "numeric_cell_accuracy": F.when(F.col("conversion_ok"), F.col("__numbers.accuracy")).otherwise(0.0),
        "numeric_cells_correct": zero("__numbers.correct", 0), "numeric_cells_total": zero("__numbers.total", 0),
        "cell_precision": zero("__cells.precision", 0.0), "cell_recall": zero("__cells.recall", 0.0), "cell_f1": zero("__cells.f1", 0.0),
        "cell_text_correct": zero("__cells.correct", 0), "pred_cells_total": zero("__cells.pred_total", 0), "gt_cells_total": zero("__cells.gt_total", 0),
        "run_failure": ~F.col("run_ok"), "conversion_failure": F.col("run_ok") & ~F.col("conversion_ok"),
    })


def score_texts(pairs: DataFrame, mode: str = "chars", carry: tuple[str, ...] = ()) -> DataFrame:
    """score_pairs of texts, with the columns to carry: html and gt_html in place of p and g. They must be partitioned already; equal texts are compared once where they follow each other."""
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("run_ok", "conversion_ok")})
    pairs = compared_pairs(pairs, F.col("conversion_ok"))
    c, both = F.col("__c"), F.col("run_ok") & F.col("conversion_ok")
    correct, hits, numbers = judged(c)
    pairs = pairs.withColumn("__cells", F.when(both, cell_scores(correct, c["pred_total"], c["gt_total"])))
    pairs = pairs.withColumn("__numbers", F.when(F.col("conversion_ok"), F.struct(hits.alias("correct"), numbers.alias("total"))))
    pairs = pairs.withColumn("__c", F.when(both, c))
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    hits, numbers = F.col("__numbers.correct"), F.col("__numbers.total")
    scored = pairs.withColumns({
        "numeric_cell_accuracy": F.when(F.col("conversion_ok"), hits / F.nullif(numbers, F.lit(0))).otherwise(0.0), "numeric_cells_correct": zero(hits, 0), "numeric_cells_total": zero(numbers, 0),
        "cell_precision": zero("__cells.precision", 0.0), "cell_recall": zero("__cells.recall", 0.0), "cell_f1": zero("__cells.f1", 0.0),
        "cell_text_correct": zero("__cells.correct", 0), "pred_cells_total": zero("__cells.pred_total", 0), "gt_cells_total": zero("__cells.gt_total", 0),
        "run_failure": ~F.col("run_ok"), "conversion_failure": F.col("run_ok") & ~F.col("conversion_ok"),
    })
    return text_scores(scored.drop("__cells", "__numbers"), "__c", mode).select(*SCORE_COLUMNS, *carry)


def judged(c: Column) -> tuple[Column, Column, Column]:
    """Of what compare_texts gives: equal cells, equal numbers and numbers of the truth, with the cells that it left to the text and number rules."""
    alike = lambda x: F.coalesce((x["t"] == x["p"]) | (normalize_cell_text(x["t"]) == normalize_cell_text(x["p"])), F.lit(False))
    number = lambda x: x["t"].rlike(r"(?U)\d")
    hit = lambda x: number(x) & F.coalesce((x["t"] == x["p"]) | (normalize_number(x["t"]) == normalize_number(x["p"])), F.lit(False))
    more = lambda rule: F.when(F.size(c["rest"]) > 0, F.size(F.filter(c["rest"], rule))).otherwise(0)
    return c["correct"] + more(lambda x: x["p"].isNotNull() & alike(x)), c["hits"] + more(hit), c["numbers"] + more(number)


def cell_pairs(pairs: DataFrame) -> DataFrame:
    """text_pairs without their texts, with `cells` and `numbers`: what cell_f1 and numeric_accuracy give of their grids. No table leaves the function that reads it."""
    pairs = compared_pairs(pairs)
    correct, hits, numbers = judged(F.col("__c"))
    pairs = pairs.withColumn("cells", cell_scores(correct, F.col("__c.pred_total"), F.col("__c.gt_total"))).withColumn("__n", F.struct(hits.alias("h"), numbers.alias("n")))
    share = F.struct((F.col("__n.h") / F.nullif("__n.n", F.lit(0))).alias("accuracy"), F.col("__n.h").alias("correct"), F.col("__n.n").alias("total"))
    return pairs.withColumn("numbers", share).drop("html", "gt_html", "__c", "__n")


def partial_sums(scores: DataFrame, *by: str) -> DataFrame:
    """What a summary is made of, by groups that may be finer than a run: counts and sums that can be added up."""
    total = lambda c, kind="double": F.sum(F.col(c).cast(kind)).alias(c)
    return scores.groupBy(*by).agg(
        F.count("*").alias("tables"), *[x for c in ("teds", "teds_s", "cell_f1", "seconds") for x in (total(c), F.count(c).alias(f"{c}_n"))],
        *[total(c, "long") for c in ("numeric_cells_correct", "numeric_cells_total")], *[F.sum(F.col(c).cast("long")).alias(c) for c in ("run_failure", "conversion_failure")],
    )


def summed(sums: DataFrame) -> DataFrame:
    """Per dataset and run: means (0 without values), pooled number score (null without numbers), failure rates, mean seconds (null without any)."""
    mean = lambda c: F.sum(c) / F.nullif(F.sum(f"{c}_n"), F.lit(0))
    rate = lambda c: F.sum(c) / F.sum("tables")
    return sums.groupBy("dataset", "run_id").agg(
        F.sum("tables").alias("tables"), *[F.coalesce(mean(c), F.lit(0.0)).alias(c) for c in ("teds", "teds_s", "cell_f1")],
        (F.sum("numeric_cells_correct") / F.nullif(F.sum("numeric_cells_total"), F.lit(0))).alias("numeric_cell_accuracy"),
        rate("run_failure").alias("run_failure_rate"), rate("conversion_failure").alias("conversion_failure_rate"), mean("seconds").alias("seconds_per_table"),
    )


def run_summary(scores: DataFrame) -> DataFrame:
    """Per dataset and run: means (0 without values), pooled number score (null without numbers), failure rates, mean seconds (null without any)."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scores.groupBy("dataset", "run_id").agg(
        F.count("*").alias("tables"), mean("teds").alias("teds"), mean("teds_s").alias("teds_s"), mean("cell_f1").alias("cell_f1"),
        (F.sum("numeric_cells_correct") / F.nullif(F.sum("numeric_cells_total"), F.lit(0))).alias("numeric_cell_accuracy"),
        F.avg(F.col("run_failure").cast("int")).alias("run_failure_rate"), F.avg(F.col("conversion_failure").cast("int")).alias("conversion_failure_rate"), F.avg("seconds").alias("seconds_per_table"),
    )


def compare_runs(summaries: DataFrame, configured: list[str] | None = None) -> DataFrame:
    """Summaries of the configured and the found datasets in dataset order; configured datasets without a summary have no row."""
    found = summaries.select("dataset").distinct()
    if configured:
        found = found.union(summaries.sparkSession.createDataFrame([(d,) for d in configured], "dataset string")).distinct()
    return summaries.join(found, "dataset", "left_semi").orderBy("dataset", "run_id")


SUMMARY_NAMES = {"run_id": "model/parser", "tables": "table count", "teds": "TEDS ↑", "teds_s": "TEDS-S ↑", "cell_f1": "cell_f1 ↑", "numeric_cell_accuracy": "numeric_cell_accuracy ↑", "run_failure_rate": "run_failure_rate ↓", "conversion_failure_rate": "conversion_failure_rate ↓", "seconds_per_table": "seconds_per_table ↓"}


def normalize_summary(df: DataFrame) -> DataFrame:
    """A summary read from a file, under the internal names: old headers fill in for new ones, known columns first."""
    old = {"run_id": ["model/parser", "model_parser"], "tables": ["table count", "tables"]}
    wanted = ["dataset", "run_id", "backend_tag", *list(SUMMARY_NAMES)[1:]]
    used, cols = set(), []
    for name in wanted:
        found = [c for c in (name, *old.get(name, []), SUMMARY_NAMES.get(name, name)) if c in df.columns]
        used.update(found)
        if found:
            cols.append(F.coalesce(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in dict.fromkeys(found)]).alias(name))
    return df.select(*cols, *[F.col(f"`{c}`") for c in df.columns if c not in used])


def run_attributes(predictions: DataFrame, position: str = "sample_id") -> DataFrame:
    """Per run: the first value that isn't blank, in sample order, of each attribute, and a display name."""
    names = ("preprocess_profile", "backend_tag", "prompt_id", "long_image_side")
    first = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(position)))
    kept = lambda c: F.when(F.count(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1)) > 0, first(c))
    out = predictions.groupBy("run_id").agg(*[kept(c).alias(c) for c in names])
    return out.withColumn("display_name", short_run_label(F.col("run_id"), F.col("backend_tag"), F.col("preprocess_profile"), F.col("prompt_id")))


def leaderboard(scores: DataFrame, attributes: DataFrame, blank_as_zero: bool = True, self_check: str = "gt_self") -> DataFrame:
    """Runs ranked by mean TEDS among those without and among those with preprocessing; the self check has no rank.

    Means are of the tables; blanks count 0 unless blank_as_zero is false. Ties: run id.
    """
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)) if blank_as_zero else F.col(c))
    rows = scores.where(F.col("run_id") != self_check).groupBy("run_id").agg(
        F.count("*").alias("tables"), mean("teds").alias("teds"), mean("teds_s").alias("teds_s"), mean("cell_f1").alias("cell_f1"), mean("numeric_cell_accuracy").alias("numeric"),
        F.avg((~parse_flag(F.col("run_ok"))).cast("int")).alias("run_fail"), F.avg((parse_flag(F.col("run_ok")) & ~parse_flag(F.col("conversion_ok"))).cast("int")).alias("conv_fail"), mean("seconds").alias("seconds"),
    )
    rows = rows.join(attributes.select("run_id", "display_name", F.nullif("preprocess_profile", F.lit("")).alias("profile")), "run_id", "left")
    order = Window.partitionBy(F.col("profile").isNotNull()).orderBy(F.coalesce("teds", F.lit(-1.0)).desc(), "run_id")
    return rows.withColumn("rank", F.row_number().over(order))


def conclusions(board: DataFrame, good: float = 0.80) -> DataFrame:
    """The best run overall, without and with preprocessing, by numbers, and the fastest of the good ones, in one aggregate."""
    def pick(name: str, key: Column, where: Column):
        return F.min_by("run_id", F.when(where, F.struct(key.alias("k"), F.col("run_id").alias("r")))).alias(name)

    always, teds = F.lit(True), -F.coalesce("teds", F.lit(-1.0))
    return board.agg(
        pick("best_overall", teds, always), pick("best_base", teds, F.col("profile").isNull()), pick("best_preprocessed", teds, F.col("profile").isNotNull()),
        pick("best_numeric", -F.coalesce("numeric", F.lit(-1.0)), always), pick("fastest_good", F.coalesce("seconds", F.lit(999999.0)), F.col("teds") >= good),
    )


def self_check(samples: DataFrame, run_id: str = "gt_self") -> DataFrame:
    """Predictions that repeat the truth; every score of them must be 1."""
    return samples.select("dataset", F.lit(run_id).alias("run_id"), "sample_id", F.lit(0).cast("long").alias("seq"), F.col("gt_html").alias("html"), F.lit(True).alias("run_ok"), F.lit(True).alias("conversion_ok"), F.lit(0.0).alias("seconds"), F.lit(None).cast("string").alias("error"))


def corrupt(samples: DataFrame, run_id: str = "eval_sanity_corrupt") -> DataFrame:
    """Predictions with, by turns in sample order within a dataset, a wrong cell, a lost span, and no output. (dataset, sample_id) is unique."""
    placed = amount_before(samples.select("dataset", "sample_id"), ["sample_id"], F.lit(1), "__i", within=["dataset"])
    placed = placed.select(F.col("dataset").alias("__d"), F.col("sample_id").alias("__s"), (F.col("__i") % 3).alias("__i"))
    rows = samples.join(placed.hint("merge"), samples["dataset"].eqNullSafe(F.col("__d")) & (samples["sample_id"] == F.col("__s")))
    html = F.col("gt_html")
    wrong = F.regexp_replace(html, r"(?s)^(.*?)<td([^>]*)>.*?</td>", "$1<td$2>XXX</td>")
    unspanned = F.regexp_replace(html, r'(?s)^(.*?)\s(?:rowspan|colspan)="[^"]+"', "$1")
    rows = rows.withColumn("html", F.when(F.col("__i") == 0, wrong).when(F.col("__i") == 1, unspanned).otherwise(""))
    ok = F.col("html") != ""
    return rows.select("dataset", F.lit(run_id).alias("run_id"), "sample_id", F.lit(0).cast("long").alias("seq"), "html", F.lit(True).alias("run_ok"), ok.alias("conversion_ok"), F.lit(0.0).alias("seconds"), F.when(~ok, "synthetic_empty_output").alias("error"))
