"""Queries of text functions, names, requests and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscore.functions import runs as R
from gridscore.functions import sql
from gridscore.functions import textnorm as X
from gridscore.operators import requests
from gridscore.plans.derive import table

_WS = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'))"


def _docs(spark, d, **cols):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in cols.items()])


def q_normalize_text(spark, d):
    return _docs(spark, d, text=X.normalize_text(F.col("text")))


def q_clean_cell(spark, d):
    """Whole texts with each kind of dangling tag, and with none."""
    tail = F.element_at(F.array(F.lit("</"), F.lit(" <"), F.lit("</td"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, d, cell=X.clean_cell_text(F.concat("text", tail)))


_CLEAN_SQL = f"""WITH t AS (SELECT doc_id, {_norm("text || ['</', ' <', '</td', ''][CAST(doc_id % 4 + 1 AS INTEGER)]")} AS s FROM documents)
SELECT doc_id, {_norm(r"regexp_replace(regexp_replace(regexp_replace(s, '</\s*$', ''), '<\s*$', ''), '</\s*[A-Za-z][^>]*$', '')")} AS cell FROM t"""


def q_normalize_cell(spark, d):
    return _docs(spark, d, text=X.normalize_cell_text(F.col("text")))


def q_clean_latex(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.clean_latex_text(F.concat(F.lit(r"\("), "p_name", F.lit(r"\) "), F.lit("x_{"), F.col("p_size").cast("string"), F.lit("}^{2} "), F.lit(r"\(\pm\)"), F.lit(r" 3\%"))).alias("cell"))


_LATEX_SQL = f"SELECT p_partkey, {_norm('p_name')} || ' x' || p_size || '2 ± 3%' AS cell FROM part"


def q_normalize_number(spark, d):
    """Prices, negative shares, signed whole numbers with a unit, flags without a digit, and texts that only look like powers."""
    kind = F.col("l_linenumber") % 5
    quantity = F.col("l_quantity").cast("int").cast("string")
    form = F.when(kind == 0, F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2)).when(kind == 1, F.concat(F.lit("−"), F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.lit(" %")))
    form = form.when(kind == 2, F.concat(F.lit("+"), quantity, F.lit(". mg"))).when(kind == 3, F.concat(quantity, F.lit(" E2"))).otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", form.alias("text"), X.normalize_number(form).alias("number"))


_NUMBER_SQL = r"""WITH t AS (SELECT *, l_linenumber % 5 AS kind, CASE l_linenumber % 5 WHEN 0 THEN format('{:,.2f}', CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE)) WHEN 1 THEN '−' || CAST(l_quantity AS DECIMAL(12,2)) || ' %' WHEN 2 THEN '+' || CAST(l_quantity AS INTEGER) || '. mg'
 WHEN 3 THEN CAST(l_quantity AS INTEGER) || ' E2' ELSE l_returnflag END AS text, CAST(round(CASE WHEN l_linenumber % 5 = 0 THEN l_extendedprice ELSE l_quantity END * 100) AS BIGINT) AS cents FROM lineitem),
z AS (SELECT *, rtrim(CAST(cents AS VARCHAR), '0') AS d, length(CAST(cents AS VARCHAR)) - length(rtrim(CAST(cents AS VARCHAR), '0')) - 2 AS e FROM t),
n AS (SELECT *, CASE WHEN kind = 1 THEN '-' ELSE '' END || CASE WHEN cents = 0 THEN '0' WHEN e = 0 THEN d WHEN e < 0 AND length(d) + e > 0 THEN d[:length(d) + e] || '.' || d[length(d) + e + 1:]
 WHEN e < 0 THEN '0.' || repeat('0', -(length(d) + e)) || d ELSE d[1] || CASE WHEN length(d) > 1 THEN '.' || d[2:] ELSE '' END || 'E+' || (length(d) + e - 1) END AS decimal FROM z)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, text, CASE kind WHEN 3 THEN CAST(l_quantity AS INTEGER) || 'E2' WHEN 4 THEN NULL ELSE decimal END AS number FROM n"""


def q_default_run_id(spark, d):
    c = table(spark, d, "customer")
    profile = F.element_at(F.array(F.lit("Doc"), F.lit("none"), F.lit(""), F.lit(None).cast("string")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", R.default_run_id(F.lit("ollama"), F.concat("c_name", F.lit(":"), "c_mktsegment"), F.lit("html_table_v1"), profile).alias("run_id"))


_RUN_ID_SQL = "SELECT c_custkey, 'ollama_' || trim(regexp_replace(c_name || ':' || c_mktsegment, '[^A-Za-z0-9._-]+', '_', 'g'), '_') || CASE WHEN c_custkey % 4 = 0 THEN '_doc' ELSE '' END || '_html_table_v1' AS run_id FROM customer"


def q_parse_flags(spark, d):
    e = table(spark, d, "events")
    word = F.element_at(F.array(*map(F.lit, ("True", "true", "1", "TRUE", "0", "yes"))), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", X.parse_flag(word).alias("flag"), X.parse_number(F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(""))).alias("number"))


_FLAGS_SQL = "SELECT event_id, event_id % 6 < 3 AS flag, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) END AS number FROM events"


def q_generate_response(spark, d):
    """Every third response is blank and falls back to the thinking."""
    t = table(spark, d, "conversations")
    body = F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("response"), F.upper("role").alias("thinking")))
    return t.select("conv_id", "turn", R.generate_response_text(body).alias("text"))


def q_chat_response(spark, d):
    """A string content on even turns, an array of parts on odd ones."""
    t = table(spark, d, "conversations")
    null = F.lit(None).cast("string")
    part = lambda kind, text, content: F.struct(F.lit(kind).alias("type"), text.alias("text"), content.alias("content"))
    parts = F.array(part("text", F.col("text"), null), part("x", F.lit(""), F.lit("")), part("y", null, F.col("role")))
    one = lambda c: F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("message"))).alias("choices")))
    return t.select("conv_id", "turn", R.chat_response_text(F.when(F.col("turn") % 2 == 0, one(F.col("text"))).otherwise(one(parts))).alias("text"))


def q_image_ref(spark, d):
    p = table(spark, d, "pages")
    src = F.when(F.col("page_id") % 4 == 0, "data:image/jpeg;base64,AAAA").when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://example.com/p/"), F.col("page_id").cast("string"), F.lit(".webp?x=1"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("img/"), F.col("page_id").cast("string"))).otherwise("file:///a/b.gif")
    return p.select("page_id", R.image_reference(src).alias("r")).select("page_id", "r.kind", "r.suffix", "r.path")


_IMAGE_SQL = """SELECT page_id, ['data', 'http', 'path', 'file'][CAST(page_id % 4 + 1 AS INTEGER)] AS kind, ['.jpg', '.webp', '.png', '.gif'][CAST(page_id % 4 + 1 AS INTEGER)] AS suffix,
 CASE page_id % 4 WHEN 1 THEN '/p/' || page_id || '.webp' WHEN 2 THEN 'img/' || page_id WHEN 3 THEN '/a/b.gif' END AS path FROM pages"""


def q_match_models(spark, d):
    models = table(spark, d, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("tag")).distinct()
    targets = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.lit(None).cast("string").alias("model_tag"), F.array(F.concat(F.lit("*"), F.lower(F.right("p_type", F.lit(3))))).alias("model_patterns")).groupBy("id").agg(F.first("model_tag").alias("model_tag"), F.array_distinct(F.flatten(F.collect_list("model_patterns"))).alias("model_patterns"))
    out = requests.match_models(models, targets)
    return out.select("id", F.array_join("installed", ",").alias("installed"), "status")


_MATCH_SQL = """WITH m AS (SELECT DISTINCT lower(replace(p_type, ' ', '-')) AS tag FROM part), p AS (SELECT DISTINCT p_brand AS id, lower(right(p_type, 3)) AS tail FROM part)
SELECT id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS installed, 'available' AS status FROM p JOIN m ON tag LIKE '%' || tail GROUP BY id"""


def q_build_requests(spark, d):
    """A request of each customer's nation's model for each order."""
    o = table(spark, d, "orders").select(F.lit("orders").alias("dataset"), F.col("o_orderkey").cast("string").alias("sample_id"), F.concat(F.lit("tables/"), F.col("o_orderkey").cast("string")).alias("image"), (F.col("o_custkey") % 25).alias("k"))
    targets = table(spark, d, "nation").select(F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("run_id"), F.when(F.col("n_nationkey") % 3 == 0, "deepseek-ocr:3b").when(F.col("n_nationkey") % 3 == 1, "qwen3-vl:8b").otherwise("other").alias("model"), F.when(F.col("n_nationkey") % 2 == 0, "chat").otherwise("generate").alias("kind"),
        F.lit("html_table_v1").alias("prompt_id"), *[F.lit(None).cast("int").alias(c) for c in ("min_image_side", "long_image_side", "num_ctx", "num_predict")], F.lit(8192).alias("max_tokens"), F.lit(None).cast("int").alias("top_k"))
    names = F.array(F.lit("html_table_v1"), F.lit("deepseek_ocr_prompt_v1"))
    prompts = table(spark, d, "region").where("r_regionkey < 2").select(F.get(names, F.col("r_regionkey").cast("int")).alias("prompt_id"), F.concat(F.lit("Prompt "), F.col("r_regionkey").cast("string")).alias("text"))
    pending = o.select("dataset", F.concat(F.lit("run"), F.col("k").cast("string")).alias("run_id"), "sample_id")
    return requests.build_requests(pending, o, targets, prompts)


_REQUEST_SQL = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS s, o_custkey % 25 AS k FROM orders), t AS (SELECT *, CASE k % 3 WHEN 0 THEN 'deepseek-ocr:3b' WHEN 1 THEN 'qwen3-vl:8b' ELSE 'other' END AS model, k % 3 = 0 AS own FROM o JOIN nation ON n_nationkey = k)
SELECT 'orders' AS dataset, 'run' || k AS run_id, s AS sample_id, model, CASE WHEN own THEN 'deepseek_ocr_prompt_v1' ELSE 'html_table_v1' END AS prompt_id, CASE WHEN own THEN CAST(1024 AS INTEGER) END AS min_image_side, CASE WHEN own THEN CAST(1536 AS INTEGER) END AS long_image_side,
 CASE WHEN k % 2 = 0 THEN '{"model":"' || model || '","messages":[{"role":"user","content":[{"type":"image_url","image_url":{"url":"tables/' || s || '"}},{"type":"text","text":"Prompt ' || CASE WHEN own THEN 1 ELSE 0 END || '"}]}],"temperature":0.0,"max_tokens":8192}'
 ELSE '{"model":"' || model || '","prompt":"Prompt ' || CASE WHEN own THEN 1 ELSE 0 END || '","images":["tables/' || s || '"],"stream":false,"options":{"temperature":0' || CASE WHEN own THEN ',"num_ctx":8192' ELSE '' END || '}' || CASE WHEN k % 3 = 1 THEN ',"think":false' ELSE '' END || '}' END AS body FROM t"""

def q_sql_functions(spark, d):
    """The text functions from SQL, over parts and line items."""
    sql.register(spark)
    table(spark, d, "part").createOrReplaceTempView("sql_part")
    table(spark, d, "lineitem").createOrReplaceTempView("sql_lines")
    return spark.sql("""SELECT p_partkey, normalize_text(concat('  ', p_name, char(9), ' ', p_type, ' ')) AS text, clean_cell_text(concat(p_name, ' </td')) AS cell, round(cell_edit_distance(p_name, p_type), 9) AS share,
        normalize_number(concat(CAST(CAST(least_price AS DECIMAL(12,2)) AS STRING), ' kg')) AS number FROM sql_part JOIN (SELECT l_partkey, min(l_extendedprice) AS least_price FROM sql_lines GROUP BY l_partkey) ON l_partkey = p_partkey""")


_SQL_FUNCTIONS = """WITH l AS (SELECT l_partkey, CAST(round(min(l_extendedprice) * 100) AS BIGINT) AS cents FROM lineitem GROUP BY l_partkey),
z AS (SELECT *, rtrim(CAST(cents AS VARCHAR), '0') AS d, length(CAST(cents AS VARCHAR)) - length(rtrim(CAST(cents AS VARCHAR), '0')) - 2 AS e FROM l)
SELECT p_partkey, p_name || ' ' || p_type AS text, p_name AS cell, round(CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type), 1), 9) AS share,
 CASE WHEN cents = 0 THEN '0' WHEN e = 0 THEN d WHEN e < 0 AND length(d) + e > 0 THEN d[:length(d) + e] || '.' || d[length(d) + e + 1:]
 WHEN e < 0 THEN '0.' || repeat('0', -(length(d) + e)) || d ELSE d[1] || CASE WHEN length(d) > 1 THEN '.' || d[2:] ELSE '' END || 'E+' || (length(d) + e - 1) END AS number FROM part JOIN z ON l_partkey = p_partkey"""


def q_sql_table_cells(spark, d):
    """Cells of a table with a span for each order, from SQL."""
    sql.register(spark)
    o = table(spark, d, "orders")
    html = F.concat(F.lit("<p>x</p><table><tr><td rowspan=2>"), F.col("o_orderkey").cast("string"), F.lit("</td><td>"), "o_orderstatus", F.lit("</td></tr><tr><td>"), "o_orderpriority", F.lit("</td></tr></table>"))
    o.select("o_orderkey", html.alias("html")).createOrReplaceTempView("sql_tables")
    return spark.sql("SELECT o_orderkey, c.r, c.c, c.text FROM sql_tables, LATERAL table_cells(html) AS c")


_TABLE_CELLS = """SELECT o_orderkey, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CASE WHEN c = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN r = 0 THEN o_orderstatus ELSE o_orderpriority END AS text
FROM orders, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(r, c)"""


ENTRIES = {
    "sql_functions": (q_sql_functions, _SQL_FUNCTIONS),
    "sql_table_cells": (q_sql_table_cells, _TABLE_CELLS),
    "normalize_text": (q_normalize_text, f"SELECT doc_id, {_norm('text')} AS text FROM documents"),
    "clean_cell_text": (q_clean_cell, _CLEAN_SQL),
    "normalize_cell_text": (q_normalize_cell, f"SELECT doc_id, replace(lower({_norm('text')}), 'ß', 'ss') AS text FROM documents"),
    "clean_latex_text": (q_clean_latex, _LATEX_SQL),
    "normalize_number": (q_normalize_number, _NUMBER_SQL),
    "default_run_id": (q_default_run_id, _RUN_ID_SQL),
    "parse_flags": (q_parse_flags, _FLAGS_SQL),
    "parse_generate_response": (q_generate_response, "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN upper(role) WHEN coalesce(trim(text), '') = '' THEN upper(role) ELSE text END AS text FROM conversations"),
    "parse_chat_response": (q_chat_response, "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE CASE WHEN coalesce(text, '') = '' THEN '' ELSE text || chr(10) END || role END AS text FROM conversations"),
    "classify_image_ref": (q_image_ref, _IMAGE_SQL),
    "match_model_patterns": (q_match_models, _MATCH_SQL),
    "build_requests": (q_build_requests, _REQUEST_SQL),
}
