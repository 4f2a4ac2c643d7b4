"""Ground truth, responses and predictions derived from the relational tables: an order is a table, a region is a run.

Tables are really rendered to text and converted back; the SQL beside the queries never parses, it computes what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.operators.convert import cells_to_html, convert_responses

HEADER = ("Line", "Qty", "Price", "Flag", "Ship")
MODES = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample for each order with lines; dataset by order priority; `grid` keeps the cells. Samples are placed by dataset and sample_id (see score_runs)."""
    # lines are gathered and placed as they are and written out as texts afterwards, so that texts aren't shuffled; truth and predictions
    # made of the same samples read the same columns of one exchange, which Spark reuses
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work in each row: not left to coalescing
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(place)).alias("l"))
    money = lambda c: c.cast("decimal(12,2)").cast("string")
    cells = lambda x: F.array(x["l_linenumber"].cast("string"), money(x["l_quantity"]), money(x["l_extendedprice"]), x["l_returnflag"], F.date_format(x["l_shipdate"], "yyyy-MM-dd"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("orders_"), F.left("o_orderpriority", F.lit(1))).alias("dataset"))
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    placed = rows.select("dataset", F.col("o_orderkey").cast("string").alias("sample_id"), "l").repartition(n, "dataset", "sample_id")
    key = F.col("sample_id")
    placed = placed.withColumn("grid", F.concat(F.array(F.array(*[F.lit(h) for h in HEADER])), F.transform("l", cells)))
    return placed.select(
        "dataset", key, F.concat(F.lit("tables/"), key, F.lit(".png")).alias("image"), cells_to_html(F.col("grid")).alias("gt_html"), F.create_map(F.lit("o_orderkey"), key).alias("meta"),
        key.cast(orders.schema["o_orderkey"].dataType).alias("o_orderkey"), "grid",
    )


def keyed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples that have both keys, as scoring asks for; so predictions made of them read what their truth reads, and no second exchange is made."""
    return samples(spark, sf_dir).where("dataset IS NOT NULL AND sample_id IS NOT NULL")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        k.alias("k"), F.lower(F.regexp_replace("r_name", "[^A-Za-z]+", "_")).alias("run_id"), F.when(k % 2 == 0, F.concat(F.lit("model:"), F.lower("r_name"))).otherwise("").alias("backend_tag"),
        F.when(k >= 3, "doc").alias("preprocess_profile"), F.lit("html_table_v1").alias("prompt_id"), F.when(k == 1, 1536).alias("long_image_side"),
    )


def dataset_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, run_id): every region's run of every dataset."""
    datasets = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders_"), F.left("o_orderpriority", F.lit(1))).alias("dataset")).distinct()
    return datasets.select("dataset", F.explode(F.array(*[F.lit(r.run_id) for r in runs(spark, sf_dir).select("run_id").collect()])).alias("run_id"))


def _render(mode: Column, grid: Column, html: Column) -> Column:
    pipes = lambda rows: F.array_join(F.transform(rows, lambda r: F.concat(F.lit("|"), F.array_join(r, "|"), F.lit("|"))), "\n")
    head, rest, n = F.slice(grid, 1, 1), F.slice(grid, 2, F.size(grid)), F.size(grid)
    tokens = F.array_join(F.transform(grid, lambda r: F.concat(F.array_join(F.transform(r, lambda c: F.concat(F.lit("<fcel>"), c)), ""), F.lit("<nl>"))), "\n")
    at = lambda r, c, t: F.concat(F.coalesce(t, F.lit("null")), F.lit(" [["), F.concat_ws(",", 100 * c - 20 + 100, 40 * r, 100 * c + 20 + 100, 40 * r + 20), F.lit("]]"))
    places = F.array_join(F.flatten(F.transform(grid, lambda row, r: F.transform(row, lambda t, c: at(r, c, t)))), "\n")
    inner = F.regexp_extract(html, "(?s)<table>(.*)</table>", 1)
    noted = F.concat(F.lit("<table><caption>Orders</caption><tr><td colspan=\"5\">Table 1. Lines of an order</td></tr>"), inner, F.lit("<tr><td colspan=\"5\">Source: ledger</td></tr></table>"))
    wrong = F.concat(head, F.transform(rest, lambda row, r: F.when(r == 0, F.transform(row, lambda t, c: F.when(c == 1, "XXX").otherwise(t))).otherwise(row)))
    comma = F.concat(head, F.transform(rest, lambda row: F.transform(row, lambda t, c: F.when(c == 2, F.format_number(t.cast("decimal(12,2)"), 2)).otherwise(t))))
    return (
        F.when(mode == 0, F.lit(None).cast("string")).when(mode == 1, "There is no table in this picture.")
        .when(mode == 2, F.concat(F.lit("Here it is:\n```html\n"), html, F.lit("\n```\nDone.")))
        .when(mode == 3, F.concat(pipes(head), F.lit("\n|---|---|---|---|---|\n"), pipes(rest)))
        .when(mode == 4, pipes(grid)).when(mode == 5, tokens).when(mode == 6, places).when(mode == 7, noted)
        .when(mode == 8, cells_to_html(F.slice(grid, 1, n - 1))).when(mode == 9, cells_to_html(wrong)).when(mode == 10, cells_to_html(comma)).otherwise(html)
    )


def rendered(truth: DataFrame, mode: int) -> DataFrame:
    """truth with `text`: each table rendered in one mode."""
    return truth.withColumn("text", _render(F.lit(mode), F.col("grid"), F.col("gt_html")))


def responses(spark: SparkSession, sf_dir: str, truth: DataFrame | None = None) -> DataFrame:
    """Every run's answer to every sample, rendered in one of twelve modes; null is a failed call."""
    r = runs(spark, sf_dir)
    own = F.array(*[F.struct(*[F.lit(x[c]).cast(t).alias(c) for c, t in r.dtypes]) for x in r.collect()])  # regions: five rows
    rows = (samples(spark, sf_dir) if truth is None else truth).select("*", F.explode(own).alias("__run")).select("*", "__run.*").drop("__run")
    rows = rows.withColumn("mode", (F.col("o_orderkey") * 31 + F.col("k") * 7) % MODES)
    seconds = F.when(F.col("mode") != 1, (F.col("o_orderkey") + F.col("k") * 3) % 50 / 10.0)
    return rows.withColumn("text", _render(F.col("mode"), F.col("grid"), F.col("gt_html"))).withColumn("seconds", seconds).withColumn("seq", F.col("o_orderkey") * 10 + F.col("k"))


def predictions(spark: SparkSession, sf_dir: str, truth: DataFrame | None = None) -> DataFrame:
    own = ("dataset", "run_id", "sample_id", "seq", "seconds", "preprocess_profile", "backend_tag", "prompt_id", "long_image_side", "mode", "text")
    rows = convert_responses(responses(spark, sf_dir, truth).select(*own), "text")
    ok = F.col("text").isNotNull()
    return rows.select(
        "dataset", "run_id", "sample_id", "seq", ok.alias("run_ok"), (ok & F.col("conversion_ok")).alias("conversion_ok"), F.when(ok, F.col("html")).otherwise("").alias("html"), "seconds",
        F.when(ok, F.col("conversion_tag")).otherwise("call failed").alias("error"), "preprocess_profile", "backend_tag", "prompt_id", "long_image_side", "removed_rows", "mode",
    )


#: The same in SQL: `pair` has a row for each sample and run with what its scores must be.
PAIRS_SQL = r"""
line AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS r,
  count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) AS qty, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
  format('{:,.2f}', CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE)) AS comma FROM lineitem),
tab AS (SELECT k, max(n) AS n, max(qty) FILTER (WHERE r = 1) AS q, count(*) FILTER (WHERE price <> comma) AS commas,
  coalesce(sum(CAST(levenshtein(price, comma) AS DOUBLE) / greatest(length(price), length(comma))) FILTER (WHERE price <> comma), 0) AS comma_cost FROM line GROUP BY k),
run AS (SELECT r_regionkey AS rk, lower(regexp_replace(r_name, '[^A-Za-z]+', '_', 'g')) AS run_id, CASE WHEN r_regionkey % 2 = 0 THEN 'model:' || lower(r_name) ELSE '' END AS backend_tag,
  CASE WHEN r_regionkey >= 3 THEN 'doc' END AS preprocess_profile FROM region),
mode AS (SELECT 'orders_' || o_orderpriority[1] AS dataset, run_id, CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderkey, rk, n, q, commas, comma_cost, (o_orderkey * 31 + rk * 7) % 12 AS mode
  FROM orders JOIN tab ON tab.k = o_orderkey CROSS JOIN run),
pair AS (SELECT *, mode >= 2 AS conv, mode <> 0 AS ran,
  CASE WHEN mode < 2 THEN 0 WHEN mode = 8 THEN 5 * n WHEN mode = 9 THEN 5 * (n + 1) - 1 WHEN mode = 10 THEN 5 * (n + 1) - commas ELSE 5 * (n + 1) END AS correct,
  CASE WHEN mode < 2 THEN 0 WHEN mode = 8 THEN 5 * n ELSE 5 * (n + 1) END AS pred_total, CASE WHEN mode < 2 THEN 0 ELSE 5 * (n + 1) END AS gt_total,
  CASE WHEN mode < 2 THEN 0 WHEN mode = 8 THEN 4 * (n - 1) WHEN mode = 9 THEN 4 * n - 1 ELSE 4 * n END AS num_correct, CASE WHEN mode < 2 THEN 0 ELSE 4 * n END AS num_total,
  CASE WHEN mode < 2 THEN 0.0::DOUBLE WHEN mode = 8 THEN 1 - 1.0::DOUBLE / (n + 1) WHEN mode = 9 THEN 1 - CAST(levenshtein('XXX', q) AS DOUBLE) / greatest(3, length(q)) / (6 * (n + 1))
    WHEN mode = 10 THEN 1 - comma_cost / (6 * (n + 1)) ELSE 1.0 END AS teds,
  CASE WHEN mode < 2 THEN 0.0::DOUBLE WHEN mode = 8 THEN 1 - 1.0::DOUBLE / (n + 1) ELSE 1.0 END AS teds_s,
  CASE WHEN mode <> 1 THEN CAST((o_orderkey + rk * 3) % 50 AS DOUBLE) / 10.0 END AS seconds FROM mode),
score AS (SELECT *, CASE WHEN mode < 2 THEN 0.0 ELSE CAST(num_correct AS DOUBLE) / num_total END AS numeric_acc, CASE WHEN pred_total > 0 THEN CAST(correct AS DOUBLE) / pred_total ELSE 0.0 END AS cell_p,
  CASE WHEN gt_total > 0 THEN CAST(correct AS DOUBLE) / gt_total ELSE 0.0 END AS cell_r FROM pair),
scored AS (SELECT *, CASE WHEN cell_p + cell_r > 0 THEN 2 * cell_p * cell_r / (cell_p + cell_r) ELSE 0.0 END AS f1 FROM score)
"""

#: Summaries of the scored pairs.
SUMMARY_SQL = """SELECT dataset, run_id, count(*) AS tables, round(avg(teds), 9) AS teds, round(avg(teds_s), 9) AS teds_s, round(avg(f1), 9) AS cell_f1, round(CAST(sum(num_correct) AS DOUBLE) / sum(num_total), 9) AS numeric_cell_accuracy,
 round(avg(CAST(NOT ran AS INTEGER)), 9) AS run_failure_rate, round(avg(CAST(ran AND NOT conv AS INTEGER)), 9) AS conversion_failure_rate, round(avg(seconds), 9) AS seconds_per_table FROM scored GROUP BY dataset, run_id"""
