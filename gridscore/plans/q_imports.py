"""Queries of sources, sinks, imports, reports and streams over data derived from the tables; files are written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridscore.operators import ingest, keyed, scoring, upsert
from gridscore.operators.shred import count_elements, grid_cells
from gridscore.plans.derive import PAIRS_SQL, SUMMARY_SQL, dataset_runs, keyed_samples, predictions, responses, samples, table
from gridscore.sources import files, imports
from gridscore.sources.shared import new_path as scratch
from gridscore.sources.schemas import SAMPLE, TOKENS
from gridscore.streaming.latest import board, latest_rows, stream_latest, stream_summaries


def with_pairs(sql: str) -> str:
    return f"WITH {PAIRS_SQL} {sql}"


def _samples(spark, d):
    return samples(spark, d).select("dataset", "sample_id", "image", "gt_html", "meta")


def _sample_files(spark, d):
    at = scratch(spark, "samples")
    files.write_jsonl(_samples(spark, d), at)
    return at


_SAMPLES_SQL = "SELECT dataset, sample_id, 'tables/' || sample_id || '.png' AS image, CAST(6 * (n + 1) AS INTEGER) AS n_elements FROM (SELECT DISTINCT dataset, sample_id, n FROM mode)"


def _sized(df):
    return count_elements(df.select("dataset", "sample_id", "image", "gt_html"), "gt_html", "n_elements").drop("gt_html")


def q_jsonl(spark, d):
    return _sized(files.read_jsonl(spark, _sample_files(spark, d), SAMPLE).unionByName(files.read_jsonl(spark, scratch(spark, "absent"), SAMPLE)))


def q_samples(spark, d):
    return _sized(files.read_samples(spark, _sample_files(spark, d), "orders_1"))


def _annotations(spark, d):
    """One annotated table for each order: its line numbers in a row, a closer too many on every third."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"))
    cell = F.array(F.lit("<td>"), F.lit("</td>"))
    count = F.size("n") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    tokens = F.concat(F.array(F.lit("<tr>")), F.flatten(F.array_repeat(cell, count)), F.array(F.lit("</tr>")))
    cells = F.transform("n", lambda x: F.struct(F.array(F.lit("<b>"), x.cast("string"), F.lit("</b>")).alias("tokens")))
    split = F.when(F.col("l_orderkey") % 2 == 0, "val").otherwise("train")
    name = F.concat(F.col("l_orderkey").cast("string"), F.lit(".png"))
    return li.select(name.alias("filename"), split.alias("split"), F.col("l_orderkey").alias("imgid"), F.struct(F.struct(tokens.alias("tokens")).alias("structure"), cells.alias("cells")).alias("html"))


def _image_names(spark, d):
    """Images of all orders but every fifth, and of as many that no one annotated."""
    o = table(spark, d, "orders").select("o_orderkey").where("o_orderkey % 5 <> 0")
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".png"))
    return o.select(name.alias("name")).union(o.select(F.concat(F.lit("x"), name).alias("name")))


def q_annotations(spark, d):
    at = scratch(spark, "annotations")
    files.write_jsonl(_annotations(spark, d), at)
    return imports.token_samples(files.read_jsonl(spark, at, TOKENS), _image_names(spark, d), "pubs").select("dataset", "sample_id", "image", "gt_html", F.col("meta")["missing_image"].alias("missing"))


_TOKEN_SQL = """WITH l AS (SELECT l_orderkey AS k, string_agg('<td><b>' || l_linenumber || '</b></td>', '' ORDER BY l_linenumber) AS body FROM lineitem GROUP BY l_orderkey)
SELECT {cols} FROM l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) ON o_orderkey = k {where}"""
_TOKEN_HTML = "'<html><body><table><tr>' || body || CASE WHEN k % 3 = 0 THEN '<td></td>' ELSE '' END || '</tr></table></body></html>'"


def q_tokens(spark, d):
    a = _annotations(spark, d)
    return a.select("imgid", imports.tokens_to_html(F.col("html.structure.tokens"), F.col("html.cells")).alias("html"))


def q_reconcile(spark, d):
    return imports.reconcile_inventory(_annotations(spark, d).select(F.col("filename").alias("name")), _image_names(spark, d))


_RECONCILE_SQL = """WITH a AS (SELECT DISTINCT l_orderkey || '.png' AS name FROM lineitem), o AS (SELECT o_orderkey || '.png' AS name FROM orders WHERE o_orderkey % 5 <> 0), i AS (SELECT name FROM o UNION SELECT 'x' || name FROM o),
m AS (SELECT name FROM a EXCEPT SELECT name FROM i), x AS (SELECT name FROM i EXCEPT SELECT name FROM a)
SELECT 'gt_count' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM a UNION ALL SELECT 'image_count', NULL, count(*) FROM i UNION ALL SELECT 'missing_image', name, NULL FROM m UNION ALL SELECT 'extra_image', name, NULL FROM x"""


def q_manifest(spark, d):
    """A manifest of all pages; every third image and every fifth truth is missing."""
    p = table(spark, d, "pages").select("page_id")
    key = F.col("page_id").cast("string")
    m = p.select(F.concat(F.lit("p"), key).alias("id"), F.concat(F.lit("tables/"), key, F.lit(".png")).alias("image"), F.concat(F.lit("gt/"), key, F.lit(".html")).alias("gt"), F.lit("crawl").alias("source"), "page_id")
    images, truths = m.where("page_id % 3 <> 0").select("image"), m.where("page_id % 5 <> 0").select("gt", F.concat(F.lit("<table><tr><td>"), "id", F.lit("</td></tr></table>")).alias("value"))
    good = imports.manifest_samples(m, images, truths, "bench", "r1").select("sample_id", "gt_html", F.lit("usable").alias("state"))
    return good.union(imports.manifest_missing(m, images, truths).select("missing", F.lit(None).cast("string"), F.lit("missing")))


_MANIFEST_SQL = "SELECT 'p' || page_id AS sample_id, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN '<table><tr><td>p' || page_id || '</td></tr></table>' END AS gt_html, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 'usable' ELSE 'missing' END AS state FROM pages"


def q_manifest_files(spark, d):
    """The same from files, for customers: a manifest, a listing of images, and texts of truths, all written and read by Spark. Names look like numbers."""
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    key = F.col("k").cast("string")
    long = F.lpad(key, 12, "0")
    m = p.select("k", F.concat(F.lit("p"), key).alias("id"), long.alias("image"), F.concat(key, F.lit("e5")).alias("gt"), F.lit("crawl").alias("source"), key.alias("number"))
    at = scratch(spark, "manifest")
    m.drop("k").write.json(f"{at}/manifest")
    files.write_texts(m.where("k % 3 <> 0").select(F.col("image").alias("name"), F.lit("x").alias("value")), f"{at}/images")
    files.write_texts(m.where("k % 5 <> 0").select(F.col("gt").alias("name"), F.concat(F.lit("<table><tr><td>"), "id", F.lit("</td></tr></table>")).alias("value")), f"{at}/truths")
    manifest = files.read_manifest(spark, f"{at}/manifest", lines=True)
    images = files.list_packed(spark, f"{at}/images").where("length = 1").select(F.col("path").alias("image"))
    truths = files.read_packed(spark, f"{at}/truths").select(F.col("path").alias("gt"), "value")
    good = imports.manifest_samples(manifest, images, truths, "bench", "r1").select("sample_id", "image", "gt_html", F.col("meta")["dataset_revision"].alias("revision"), F.col("meta")["number"].alias("number"), F.lit("usable").alias("state"))
    null = F.lit(None).cast("string")
    return good.union(imports.manifest_missing(manifest, images, truths).select("missing", null, null, null, null, F.lit("missing")))


_MANIFEST_FILES_SQL = """WITH m AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS ok FROM customer)
SELECT 'p' || k AS sample_id, CASE WHEN ok THEN lpad(CAST(k AS VARCHAR), 12, '0') END AS image, CASE WHEN ok THEN '<table><tr><td>p' || k || '</td></tr></table>' END AS gt_html, CASE WHEN ok THEN 'r1' END AS revision,
 CASE WHEN ok THEN CAST(k AS VARCHAR) END AS number, CASE WHEN ok THEN 'usable' ELSE 'missing' END AS state FROM m"""


def q_json_arrays(spark, d):
    """Arrays of orders, one for each customer, in text files: elements with objects, arrays, brackets and quotes inside them."""
    o = table(spark, d, "orders")
    text = F.concat(F.lit("}] \\ \" { "), "o_orderpriority", F.lit(" ["))
    item = F.struct(F.col("o_orderkey").cast("string").alias("id"), text.alias("image"), F.struct(F.array(F.lit("[{"), F.lit("}")).alias("x"), F.col("o_orderstatus").alias("y")).alias("gt"))
    at = scratch(spark, "arrays")
    o.groupBy("o_custkey").agg(F.to_json(F.collect_list(item)).alias("value")).select("value").write.text(at)
    m = files.read_manifest(spark, at)
    return m.select(F.col("id").cast("long").alias("o_orderkey"), "image", F.get_json_object("gt", "$.y").alias("status"), F.get_json_object("gt", "$.x[0]").alias("x"))


_JSON_ARRAYS_SQL = """SELECT o_orderkey, '}] ' || chr(92) || ' " { ' || o_orderpriority || ' [' AS image, o_orderstatus AS status, '[{' AS x FROM orders"""


def q_page_pairs(spark, d):
    """Pages made of the crawled ones: an image for each list item; a table for each paragraph, on every third page with a table inside."""
    p = table(spark, d, "pages")
    plain, nested = "<table><tr><td>x</td></tr></table>", '<table class="o"><tr><td>a<TABLE><tr><td>y</td></tr></TABLE>b</td></tr></table>'
    made = F.when(F.col("page_id") % 3 == 1, nested).otherwise(plain)
    html = F.regexp_replace(F.regexp_replace("html", "(?s)<li>.*?</li>", '<img src="i.png">'), F.lit("(?s)<p>(.*?)</p>"), made)
    suffix = F.element_at(F.array(F.lit(".html"), F.lit(".htm"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int"))
    out = imports.page_pairs(p.select(F.concat(F.lit("d/"), F.lpad(F.col("page_id").cast("string"), 9, "0"), suffix).alias("path"), html.alias("value")), "web")
    return out.select("sample_id", "image", "gt_html", F.col("meta")["source_file"].alias("source_file"), F.col("meta")["source_index"].alias("source_index"), F.col("meta")["source_table_count"].alias("tables"))


_PAGES_SQL = """WITH p AS (SELECT page_id, page_id % 3 AS rank, len(regexp_extract_all(html, '(?s)<li>.*?</li>')) AS li, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>')) * CASE WHEN page_id % 3 = 1 THEN 2 ELSE 1 END AS pa FROM pages),
x AS (SELECT page_id, rank, pa, unnest(range(least(li, pa))) AS i FROM p), y AS (SELECT *, row_number() OVER (ORDER BY rank, page_id, i) - 1 AS num FROM x)
SELECT 'web_' || CASE WHEN num < 10000 THEN lpad(CAST(num AS VARCHAR), 4, '0') ELSE CAST(num AS VARCHAR) END AS sample_id, 'i.png' AS image, '<html><body>' ||
 CASE WHEN rank <> 1 THEN '<table><tr><td>x</td></tr></table>' WHEN i % 2 = 0 THEN '<table class="o"><tr><td>a<TABLE><tr><td>y</td></tr></TABLE>b</td></tr></table>' ELSE '<TABLE><tr><td>y</td></tr></TABLE>' END || '</body></html>' AS gt_html,
 'd/' || lpad(CAST(page_id AS VARCHAR), 9, '0') || ['.html', '.htm', '.txt'][CAST(rank + 1 AS INTEGER)] AS source_file, CAST(i AS VARCHAR) AS source_index, CAST(pa AS VARCHAR) AS tables FROM y"""


def q_paired(spark, d):
    """Images of three suffixes with the truth of the same stem; every fourth truth is markdown, every seventh is missing."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("s"))
    suffix = F.element_at(F.array(F.lit(".png"), F.lit(".JPG"), F.lit(".gif")), (F.col("k") % 3 + 1).cast("int"))
    images = p.select(F.concat(F.lit("im/"), "s", suffix).alias("path"))
    value = F.when(F.col("k") % 4 == 0, F.concat(F.lit("|a|b|\n|---|---|\n|"), "s", F.lit("|1|"))).otherwise(F.concat(F.lit("<p>t</p><table><tr><td>"), "s", F.lit("</td></tr></table>")))
    out = imports.paired_samples(images, p.where("k % 7 <> 0").select(F.concat(F.lit("gt/"), "s", F.lit(".html")).alias("path"), value.alias("value")), "pairs")
    return out.select("sample_id", "image", "gt_html")


_PAIRED_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS sample_id, 'im/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.png' ELSE '.JPG' END AS image,
 CASE WHEN p_partkey % 4 = 0 THEN '<html><body><table><tr><th>a</th><th>b</th></tr><tr><td>' || p_partkey || '</td><td>1</td></tr></table></body></html>' ELSE '<html><body><table><tr><td>' || p_partkey || '</td></tr></table></body></html>' END AS gt_html
 FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 2"""


def q_paired_files(spark, d):
    """Paired containers of orders: images listed, truths read as whole texts, some with bytes that are no text."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("s"))
    suffix = F.element_at(F.array(F.lit(".png"), F.lit(".JPG"), F.lit(".gif")), (F.col("k") % 3 + 1).cast("int"))
    bad = F.when(F.col("k") % 2 == 0, F.unhex(F.lit("FF")).cast("string")).otherwise("")
    at = scratch(spark, "paired")
    files.write_texts(p.select(F.concat("s", suffix).alias("name"), F.lit("x").alias("value")), f"{at}/images")
    files.write_texts(p.where("k % 7 <> 0").select(F.concat("s", F.lit(".html")).alias("name"), F.concat(F.lit("<table><tr><td>"), "s", bad, F.lit("</td></tr></table>")).alias("value")), f"{at}/truths")
    return imports.paired_samples(files.list_packed(spark, f"{at}/images").select("path"), files.read_packed(spark, f"{at}/truths"), "pairs").select("sample_id", "image", "gt_html")


_PAIRED_FILES_SQL = """WITH o AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS s FROM orders)
SELECT s AS sample_id, s || CASE WHEN k % 3 = 0 THEN '.png' ELSE '.JPG' END AS image,
 '<html><body><table><tr><td>' || s || CASE WHEN k % 2 = 0 THEN chr(65533) ELSE '' END || '</td></tr></table></body></html>' AS gt_html FROM o WHERE k % 7 <> 0 AND k % 3 <> 2"""


def q_items(spark, d):
    """A payload for each supplier, an object of two items or a bare list of one; blank fields fall through; items without an id are numbered over all payloads."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name"))
    html = F.concat(F.lit("<table><tr><td>"), "s_name", F.lit("</td></tr></table>"))
    null = F.lit(None).cast("string")
    item = F.struct(F.when(F.col("k") % 3 != 0, F.concat(F.lit("s"), F.col("k").cast("string"))).alias("id"), F.when(F.col("k") % 2 == 0, "").alias("gt_html"), html.alias("table_html"), F.when(F.col("k") % 5 == 0, null).otherwise("a.png").alias("src"))
    more = F.struct(null.alias("id"), F.lit("<table><tr><td>more</td></tr></table>").alias("gt_html"), null.alias("table_html"), F.lit("b.png").alias("src"))
    body = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.array(item, more).alias("items")))).otherwise(F.to_json(F.array(item)))
    path = F.concat(F.lit("d/"), F.lpad(F.col("k").cast("string"), 9, "0"))
    return imports.item_samples(imports.exploded_items(s.select(path.alias("path"), body.alias("body"))), "items").select("sample_id", "image", "gt_html")


_ITEMS_SQL = """WITH s AS (SELECT s_suppkey AS k, s_name, sum(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END) OVER (ORDER BY s_suppkey) - CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM supplier),
i AS (SELECT CASE WHEN k % 3 <> 0 THEN 's' || k END AS id, n, 'a.png' AS image, s_name AS cell FROM s WHERE k % 5 <> 0 UNION ALL SELECT NULL, n + 1, 'b.png', 'more' FROM s WHERE k % 2 = 0)
SELECT coalesce(id, 'items_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END) AS sample_id, image, '<html><body><table><tr><td>' || cell || '</td></tr></table></body></html>' AS gt_html FROM i"""


def q_manifest_report(spark, d):
    return files.write_dataset(_samples(spark, d), scratch(spark, "dataset"), "html:orders")


def q_dataset_roundtrip(spark, d):
    """Samples written as a dataset and read back from its manifest and truths, with all that an entry tells."""
    at = scratch(spark, "dataset")
    files.write_dataset(_samples(spark, d), at, "html:orders")
    names = [r.dataset for r in _samples(spark, d).select("dataset").distinct().collect()]  # five priorities
    out = None
    for name in sorted(names):
        back = files.read_dataset(spark, at, name)
        own = imports.manifest_samples(back, back.select("image"), back.select("gt", "value"), name, "r2")
        out = own if out is None else out.union(own)
    sized = count_elements(out, "gt_html", "n_elements")
    return sized.select("dataset", "sample_id", "image", "n_elements", *[F.col("meta")[k].alias(k) for k in ("o_orderkey", "source", "gt", "dataset_revision")])


_ROUNDTRIP_SQL = "SELECT dataset, sample_id, 'tables/' || sample_id || '.png' AS image, CAST(6 * (n + 1) AS INTEGER) AS n_elements, sample_id AS o_orderkey, 'html:orders' AS source, 'gt/' || sample_id || '.html' AS gt, 'r2' AS dataset_revision FROM (SELECT DISTINCT dataset, sample_id, n FROM mode)"


def q_data_report(spark, d):
    return imports.data_report(_samples(spark, d))


def _scores(spark, d):
    truth = keyed_samples(spark, d)
    return scoring.score_runs(truth, predictions(spark, d, truth), dataset_runs(spark, d), placed=True)


def q_predictions_file(spark, d):
    """Predictions as JSON lines, each run's odd samples appended once more with a later order; the last counts. Rows meet without their tables."""
    keys = ("dataset", "run_id", "sample_id")
    p = predictions(spark, d).select(*keys, "seq", "run_ok", "conversion_ok", "html", "seconds", "error")
    at = scratch(spark, "predictions")
    files.write_jsonl(p, at, compression="gzip")
    again = files.read_predictions(spark, at).select(*p.columns).where("seq % 20 >= 10").withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("error", F.lit("again"))
    files.write_jsonl(again, at, append=True, compression="gzip")
    told = files.read_predictions(spark, at).select(*keys, "seq", "run_ok", "error", F.col("html").startswith("<html>").alias("table"))
    last = upsert.latest(told, list(keys), "seq")
    return last.groupBy("dataset", "run_id").agg(F.count("*").alias("rows"), F.count_if("run_ok").alias("run_ok"), F.count_if(F.col("error") == "again").alias("again"), F.count_if("table").alias("tables"))


_PREDICTIONS_SQL = "SELECT dataset, run_id, count(*) AS rows, count(*) FILTER (WHERE ran) AS run_ok, count(*) FILTER (WHERE (o_orderkey * 10 + rk) % 20 >= 10) AS again, count(*) FILTER (WHERE conv) AS tables FROM pair GROUP BY dataset, run_id"


def q_score_files(spark, d):
    """Scores by dataset and run; one run is scored and written again without its failed calls and replaces itself only."""
    s = _scores(spark, d).select("dataset", "run_id", "sample_id", "teds", "run_ok")
    at = scratch(spark, "scored")
    files.write_scores(s, at)
    files.write_scores(files.read_scores(spark, at, s.schema).where("run_id = 'europe' AND run_ok").withColumn("teds", F.lit(0.5)), at)
    return files.read_scores(spark, at, s.schema).select("dataset", "run_id", "sample_id", F.round("teds", 9).alias("teds"), "run_ok")


_SCORE_FILES_SQL = "SELECT dataset, run_id, sample_id, CASE WHEN run_id = 'europe' THEN 0.5 ELSE round(teds, 9) END AS teds, ran AS run_ok FROM scored WHERE run_id <> 'europe' OR ran"


def q_summary_file(spark, d):
    """A run summary under the names of summary files, as CSV and back."""
    at = scratch(spark, "summary")
    files.write_csv(files.summary_as_file(scoring.run_summary(_scores(spark, d))), at)
    back = scoring.normalize_summary(files.read_csv(spark, at))
    number = lambda c: F.round(F.col(c).cast("double"), 9).alias(c)
    return back.select("dataset", "run_id", F.col("tables").cast("long").alias("tables"), *[number(c) for c in ("teds", "teds_s", "cell_f1", "numeric_cell_accuracy", "run_failure_rate", "conversion_failure_rate", "seconds_per_table")])


def q_csv(spark, d):
    """Scores through a CSV file with a byte order mark and back."""
    s = _scores(spark, d).select("dataset", "run_id", "sample_id", "teds", "numeric_cells_total", "seconds", "run_ok")
    at = scratch(spark, "scores")
    files.write_csv(s, at)
    back = files.read_csv(spark, at, "dataset string, run_id string, sample_id string, teds double, numeric_cells_total int, seconds double, run_ok boolean")
    return back.withColumn("teds", F.round("teds", 9))


def q_normalize_summary(spark, d):
    """Old headers, as a file would have them."""
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    old = o.select(F.lit("orders").alias("dataset"), F.col("o_orderstatus").alias("model_parser"), F.col("n").cast("string").alias("tables"), F.lit("").alias("TEDS ↑"), F.lit("x").alias("note"))
    return scoring.normalize_summary(old)


def q_union_rows(spark, d):
    """Rows of three tables under the union of their columns, through a CSV file."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    at = scratch(spark, "rows")
    files.write_csv(files.union_rows(c, s, n), at)
    return files.read_csv(spark, at)


_UNION_SQL = """SELECT c_name AS name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS balance, CAST(NULL AS VARCHAR) AS nation FROM customer
 UNION ALL SELECT s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT n_name, NULL, NULL FROM nation"""


def q_ingest(spark, d):
    """Chat bodies on even regions, generate bodies on odd ones; failed calls have none."""
    r = responses(spark, d)
    null = F.lit(None).cast("string")
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    body = F.when(F.col("text").isNull(), null).when(F.col("k") % 2 == 0, chat).otherwise(F.to_json(F.struct(F.lit(" ").alias("response"), F.col("text").alias("thinking"))))
    rows = r.select("dataset", "run_id", "sample_id", "seq", F.when(F.col("k") % 2 == 0, "chat").otherwise("generate").alias("kind"), body.alias("body"), "seconds", F.when(F.col("text").isNull(), "timeout").alias("error"))
    out = ingest.ingest_responses(rows)
    return out.groupBy("dataset", "run_id").agg(F.count_if("run_ok").alias("run_ok"), F.count_if("conversion_ok").alias("conversion_ok"), F.count_if(F.col("error") == "timeout").alias("timeouts"), F.sum("removed_caption_note_rows").alias("removed"))


def q_reconvert(spark, d):
    """Stored predictions whose raw text is converted again; those without stay."""
    r = responses(spark, d)
    p = r.select("dataset", "run_id", "sample_id", "mode", F.col("seq").cast("string").alias("raw_path"), F.lit("").alias("html"), F.lit(False).alias("conversion_ok"), F.lit("old").alias("error"))
    out = ingest.reconvert(p, r.where("text IS NOT NULL AND mode <> 4").select(F.col("seq").cast("string").alias("raw_path"), F.col("text").alias("value")))
    return out.groupBy("run_id", "mode").agg(F.count("*").alias("rows"), F.count_if("conversion_ok").alias("converted"), F.count_if(F.col("error") == "old").alias("kept"))


def q_reconvert_files(spark, d):
    """Stored predictions of orders with raw texts in containers, some with bytes that are no text; a raw text that is gone leaves its row as it was."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("0"), F.col("o_orderkey").cast("string")).alias("raw_path"))
    bad = F.unhex(F.lit("C3")).cast("string")
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("<table><tr><td>a"), bad, F.lit("</td></tr></table>"))).otherwise("|a|b|\n|---|---|\n|1|2|")
    at = scratch(spark, "raw")
    files.write_texts(p.where("k % 5 <> 0").select(F.col("raw_path").alias("name"), text.alias("value")), at)
    stored = p.select("k", "raw_path", F.lit("old").alias("html"), F.lit(False).alias("conversion_ok"), F.lit("old").alias("error"))
    raw = files.read_packed(spark, at).select(F.col("path").alias("raw_path"), "value")
    return ingest.reconvert(stored, raw).select("k", "html", "conversion_ok", "error")


_RECONVERT_FILES_SQL = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'old' WHEN o_orderkey % 2 = 0 THEN '<html><body><table><tr><td>a' || chr(65533) || '</td></tr></table></body></html>'
 ELSE '<html><body><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>' END AS html, o_orderkey % 5 <> 0 AS conversion_ok,
 CASE WHEN o_orderkey % 5 = 0 THEN 'old' WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'markdown_table_no_merge' END AS error FROM orders"""


def _arrivals(spark, d):
    """Events as prediction rows that arrive in three files, out of order."""
    e = table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").cast("string").alias("run_id"), F.lit("s").alias("sample_id"), F.col("event_id").alias("seq"), "value")
    at = scratch(spark, "arrivals")
    for k in (2, 0, 1):
        e.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(at)


def q_stream_latest(spark, d):
    path, stream = scratch(spark, "latest"), _arrivals(spark, d)
    stream_latest(stream, path, scratch(spark, "progress"), buckets=8).awaitTermination()
    return latest_rows(spark, path, stream.schema).select("dataset", "run_id", "seq", "value")


def q_upsert_keyed(spark, d):
    """Even events as a bucketed table by type and user, into which the odd ones go."""
    e = table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "value")
    keys, name = ["dataset", "run_id"], f"keyed_{uuid.uuid4().hex}"
    keyed.create_keyed(upsert.latest(e.where("seq % 2 = 0"), keys, "seq"), name, keys, 8)
    keyed.upsert_keyed(spark, name, e.where("seq % 2 = 1"), keys, "seq", 8)
    return spark.table(name).select("dataset", "run_id", "seq", "value")


_KEYED_SQL = "SELECT event_type AS dataset, CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 2 DESC, event_id DESC) = 1"


def q_stream_leaderboard(spark, d):
    s = _arrivals(spark, d).select("dataset", "run_id", F.col("run_id").alias("sample_id"), "seq", *[F.col("value").alias(c) for c in ("teds", "teds_s", "cell_f1", "seconds")], F.lit(1).alias("numeric_cells_correct"), F.lit(2).alias("numeric_cells_total"), F.lit(False).alias("run_failure"), F.lit(False).alias("conversion_failure"))
    path = scratch(spark, "board")
    stream_summaries(s, path, scratch(spark, "progress"), buckets=8).awaitTermination()
    return board(spark, path).select("dataset", "run_id", "tables", F.round("teds", 9).alias("teds"), "numeric_cell_accuracy")


_LAST = "SELECT event_type AS dataset, CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1"


def q_prepare(spark, d):
    """Samples of each dataset: a fixed draw of twenty, and the report on them."""
    return imports.report_rows(upsert.fixed_samples(_samples(spark, d), 20, 20260917))


ENTRIES = {
    "src_jsonl_roundtrip": (q_jsonl, with_pairs(_SAMPLES_SQL)),
    "src_samples": (q_samples, with_pairs(_SAMPLES_SQL + " WHERE dataset = 'orders_1'")),
    "src_token_annotations": (q_annotations, _TOKEN_SQL.format(cols=f"'pubs' AS dataset, CAST(k AS VARCHAR) AS sample_id, k || '.png' AS image, {_TOKEN_HTML} AS gt_html, CASE WHEN o_orderkey IS NULL THEN 'true' ELSE 'false' END AS missing", where="WHERE k % 2 = 0")),
    "tokens_to_html": (q_tokens, _TOKEN_SQL.format(cols=f"k AS imgid, {_TOKEN_HTML} AS html", where="")),
    "reconcile_inventory": (q_reconcile, _RECONCILE_SQL),
    "src_manifest": (q_manifest, _MANIFEST_SQL),
    "src_manifest_files": (q_manifest_files, _MANIFEST_FILES_SQL),
    "src_json_arrays": (q_json_arrays, _JSON_ARRAYS_SQL),
    "dataset_roundtrip": (q_dataset_roundtrip, with_pairs(_ROUNDTRIP_SQL)),
    "import_page_pairs": (q_page_pairs, _PAGES_SQL),
    "import_paired": (q_paired, _PAIRED_SQL),
    "import_paired_files": (q_paired_files, _PAIRED_FILES_SQL),
    "import_items": (q_items, _ITEMS_SQL),
    "import_manifest_report": (q_manifest_report, with_pairs("SELECT dataset, count(DISTINCT sample_id) AS sample_count, 'html:orders' AS source FROM mode GROUP BY dataset")),
    "prepare_datasets": (q_prepare, with_pairs(", o AS (SELECT DISTINCT dataset, sample_id FROM mode), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('20260917:' || sample_id), sample_id) AS n FROM o) SELECT dataset, count(*) OVER (PARTITION BY dataset) AS sample_count, sample_id FROM r WHERE n <= 20")),
    "data_report": (q_data_report, with_pairs("SELECT dataset, count(DISTINCT sample_id) AS sample_count FROM mode GROUP BY dataset")),
    "predictions_file": (q_predictions_file, with_pairs(_PREDICTIONS_SQL)),
    "score_files": (q_score_files, with_pairs(_SCORE_FILES_SQL)),
    "summary_file": (q_summary_file, with_pairs(SUMMARY_SQL)),
    "src_csv_scores": (q_csv, with_pairs("SELECT dataset, run_id, sample_id, round(teds, 9) AS teds, CAST(num_total AS INTEGER) AS numeric_cells_total, seconds, ran AS run_ok FROM scored")),
    "normalize_summary": (q_normalize_summary, "SELECT 'orders' AS dataset, o_orderstatus AS run_id, CAST(count(*) AS VARCHAR) AS tables, CAST(NULL AS VARCHAR) AS teds, 'x' AS note FROM orders GROUP BY o_orderstatus"),
    "sink_csv_scores": (q_union_rows, _UNION_SQL),
    "ingest_responses": (q_ingest, with_pairs("SELECT dataset, run_id, count(*) FILTER (WHERE ran) AS run_ok, count(*) FILTER (WHERE conv) AS conversion_ok, count(*) FILTER (WHERE NOT ran) AS timeouts, CAST(sum(CASE WHEN mode = 7 THEN 3 WHEN ran THEN 0 END) AS BIGINT) AS removed FROM pair GROUP BY dataset, run_id")),
    "reconvert_run": (q_reconvert, with_pairs("SELECT run_id, mode, count(*) AS rows, count(*) FILTER (WHERE conv AND mode <> 4) AS converted, count(*) FILTER (WHERE mode IN (0, 4)) AS kept FROM pair GROUP BY run_id, mode")),
    "reconvert_files": (q_reconvert_files, _RECONVERT_FILES_SQL),
    "stream_latest": (q_stream_latest, _LAST),
    "upsert_keyed": (q_upsert_keyed, _KEYED_SQL),
    "stream_leaderboard": (q_stream_leaderboard, f"WITH l AS ({_LAST}) SELECT dataset, run_id, count(*) AS tables, round(avg(value), 9) AS teds, 0.5::DOUBLE AS numeric_cell_accuracy FROM l GROUP BY dataset, run_id"),
}
