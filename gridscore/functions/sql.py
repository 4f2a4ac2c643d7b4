"""The text functions for SQL: temporary SQL functions, which the analyzer inlines, and the cells of a table as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridscore.functions import textnorm as X


def _quoted(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


_DANGLING = "{}"
for _rule in X.DANGLING:
    _DANGLING = f"regexp_replace({_DANGLING}, {_quoted(_rule)}, '')"

#: name, parameters, type, body; later ones may use earlier ones.
FUNCTIONS = (
    ("normalize_text", "s STRING", "STRING", f"trim(regexp_replace(coalesce(s, ''), {_quoted(X.WS)}, ' '))"),
    ("clean_cell_text", "s STRING", "STRING", f"normalize_text({_DANGLING.format('normalize_text(s)')})"),
    ("significant", "digits STRING", "STRING", f"""CASE WHEN length(digits) <= {X.PRECISION} THEN digits ELSE CAST(CAST(left(digits, {X.PRECISION}) AS DECIMAL(38,0))
        + CASE WHEN substring(digits, {X.PRECISION + 1}) RLIKE '^[6-9]|^5.*[1-9]' OR substring(digits, {X.PRECISION + 1}) RLIKE '^50*$' AND left(digits, {X.PRECISION}) RLIKE '[13579]$' THEN 1 ELSE 0 END AS STRING) END"""),
    ("decimal_text", "minus STRING, d STRING, e INT", "STRING", """minus || CASE WHEN d = '' THEN '0' WHEN e = 0 THEN d WHEN e < 0 AND length(d) + e > 0 THEN left(d, length(d) + e) || '.' || substring(d, length(d) + e + 1)
        WHEN e < 0 AND length(d) + e > -6 THEN '0.' || repeat('0', -(length(d) + e)) || d
        ELSE left(d, 1) || CASE WHEN length(d) > 1 THEN '.' || substring(d, 2) ELSE '' END || 'E' || CASE WHEN length(d) + e > 0 THEN '+' ELSE '' END || CAST(length(d) + e - 1 AS STRING) END"""),
    ("trimmed_decimal", "minus STRING, d STRING, e INT", "STRING", "decimal_text(minus, rtrim('0', d), e + length(d) - length(rtrim('0', d)))"),
    ("plain_decimal", "minus STRING, digits STRING, places INT", "STRING", f"trimmed_decimal(minus, significant(digits), greatest(length(digits) - {X.PRECISION}, 0) - places)"),
    ("decimal_of", "n STRING", "STRING", r"plain_decimal(CASE WHEN n LIKE '-%' THEN '-' ELSE '' END, ltrim('0', regexp_replace(n, r'[^0-9]', '')), length(regexp_extract(n, r'\.([0-9]*)$', 1)))"),
    ("number_or_text", "s STRING", "STRING", f"CASE WHEN translate(s, '{X.DIGITS}', '{X.ASCII_DIGITS}') RLIKE {_quoted(X.NUMBER)} THEN decimal_of(regexp_extract(translate(s, '{X.DIGITS}', '{X.ASCII_DIGITS}'), {_quoted(X.NUMBER)}, 1)) ELSE s END"),
    ("normalize_number", "s STRING", "STRING", f"CASE WHEN normalize_text(s) RLIKE r'(?U)\\d' THEN number_or_text(regexp_replace(translate(replace(normalize_text(s), ',', ''), '−–—', '---'), {_quoted(X.WS)}, '')) END"),
    ("cell_edit_distance", "a STRING, b STRING", "DOUBLE", "levenshtein(a, b) / greatest(char_length(a), char_length(b), 1)"),
)


@F.udtf(returnType="r int, c int, text string")
class TableCells:
    """The cells of the first table of a text, spans expanded: row, column, text."""

    def eval(self, html: str):
        from gridscore.operators.shred import grid_of, parse

        table = parse(html)
        for r, row in enumerate(grid_of(table)[0] if table is not None else ()):
            for c, text in enumerate(row):
                yield r, c, text


def register(spark: SparkSession) -> None:
    """normalize_text, clean_cell_text, normalize_number, cell_edit_distance and table_cells for this session's SQL."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("table_cells", TableCells)
