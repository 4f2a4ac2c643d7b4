"""Quality rules with cross-document line frequency, native.

Per host, normalised lines are hashed and the documents holding each line are counted with map-side
combining (each document counts once). Lines above the limit are boilerplate and are removed from the text; a document
left with too few of its words once those lines are gone is rejected as depleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.llm.common import WS, line_key

SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"


def _without(c: Column, chars: str) -> Column:
    """Code points of c that are not in chars."""
    return F.char_length(F.regexp_replace(c, "[" + "".join(f"\\x{ord(x):02X}" for x in chars) + "]+", ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array, first occurrences included.

    Windows are compared by hash. Where all are distinct nothing is sorted; elsewhere (hash, start) pairs are
    sorted once, and the starts of equal neighbours are swept in order.
    """
    tri = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
    )
    return F.when(F.size(words) < 3, F.lit(None)).otherwise(tri)


def base_statistics(docs: DataFrame, text_col: str = "text", out: str = "statistics") -> DataFrame:
    """docs with a struct `out`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); null text counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__w", words_of(t)).withColumn("__tri", repeated_words(F.col("__w")))
    rows = rows.withColumn("__sorted", F.when(F.size(F.array_distinct("__tri")) < F.size("__tri"), F.array_sort(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
    rows = rows.withColumn("__at", F.array_sort(F.transform(F.filter(s, lambda x, j: same(j, j - 1) | same(j, j + 1)), lambda x: x["i"])))
    swept = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    text_lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    rows = rows.withColumn("__ls", text_lines)
    found = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        (F.char_length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__ls") - F.size(F.array_distinct("__ls"))).cast("long").alias("n_dup_lines"),
        F.coalesce(swept, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn(out, found).drop("__w", "__tri", "__sorted", "__at", "__ls")


def frequent_lines(docs: DataFrame, id_col: str, host_col: str, text_col: str, max_docs: int) -> DataFrame:
    """(__host, __h) of the lines that more than max_docs documents of a host hold. A document is an id, however many rows it has; a null host is a host."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.xxhash64(line_key(x))))
    return (
        docs.where(F.col(id_col).isNotNull())
        .select(F.xxhash64(host_col).alias("__host"), F.col(id_col).alias("__id"), F.explode(keys).alias("__h"))
        .where(F.col("__h") != F.xxhash64(F.lit("")))
        .groupBy("__host", "__h")
        .agg(F.count_distinct("__id").alias("__docs"))
        .where(F.col("__docs") > max_docs)
        .select("__host", "__h")
    )


def _row_key(id_col: str, host_col: str, text_col: str) -> list[Column]:
    """What rows share that hold the same document: id, and host and text as 128 bits of hash."""
    return [F.col(id_col).alias("__id"), F.xxhash64(host_col).alias("__host"), F.xxhash64(text_col).alias("__t"), F.xxhash64(F.lit(1), F.col(text_col)).alias("__u")]


def removed_words(docs: DataFrame, id_col: str, host_col: str, text_col: str, max_docs: int) -> DataFrame:
    """(__id, __host, __t, __u, removed_lines, removed_words, __gone: hashes of the removed lines) of documents that hold frequent lines, once for equal rows."""
    key = ["__id", "__host", "__t", "__u"]
    lines = docs.where(F.col(id_col).isNotNull()).select(*_row_key(id_col, host_col, text_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("__pos", "__line")).select(
        *key, "__pos", F.xxhash64(line_key(F.col("__line"))).alias("__h"), F.regexp_count("__line", F.lit(WORD)).alias("__n")
    )
    frequent = frequent_lines(docs, id_col, host_col, text_col, max_docs)
    once = lines.where("__n > 0").join(frequent.hint("merge"), ["__host", "__h"]).groupBy(*key, "__pos").agg(F.min("__n").alias("__n"), F.min("__h").alias("__h"))
    return once.groupBy(*key).agg(F.count("*").alias("removed_lines"), F.sum("__n").alias("removed_words"), F.collect_set("__h").alias("__gone"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_words: int = 50, max_docs: int = 100, max_removed: float = 0.7, out: str = "rules", with_text: bool = True) -> DataFrame:
    """docs with a struct `out`: the text without its frequent lines (null if not with_text, so that no text is shuffled where docs is not to
    keep its own), statistics of the text as given, base_failed, removed_lines, removed_words, depleted, kept. Every row and column of docs stays; a column that is named as `out` is replaced, names that begin with two
    underscores are the operator's own.

    base_failed: n_words < min_words, or more than half of the words repeat in 3-word windows. depleted: frequent lines, those
    that more than max_docs documents of the host hold, make up more than max_removed of the words. Rows with a null id are judged by their own
    text only, and keep it. Each row that shares an id is judged by its own lines; together they count as one document.
    Null texts are empty and stay null. Texts of any length are read whole. An empty table gives an empty table.
    """
    stats = base_statistics(docs.drop(out), text_col, "__s").select("*", *[c.alias(f"__own{k}") for k, c in enumerate(_row_key(id_col, host_col, text_col))])
    removed = removed_words(docs, id_col, host_col, text_col, max_docs)
    same = [F.col(f"__own{k}") == F.col(c) for k, c in enumerate(("__id", "__host", "__t", "__u"))]
    rows = stats.join(removed.withColumnsRenamed({"removed_lines": "__lines", "removed_words": "__words"}).hint("merge"), same, "left")
    rest = F.filter(F.split(text_col, "\n", -1), lambda x: ~F.array_contains("__gone", F.xxhash64(line_key(x))))
    failed = (F.col("__s.n_words") < min_words) | (100 * F.col("__s.n_repeat_words") > 50 * F.col("__s.n_words"))
    depleted = F.coalesce("__words", F.lit(0)) > max_removed * F.col("__s.n_words")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    found = F.struct(
        (text if with_text else F.lit(None).cast("string")).alias("text"),
        "__s.*",
        failed.alias("base_failed"),
        F.coalesce("__lines", F.lit(0)).alias("removed_lines"),
        F.coalesce("__words", F.lit(0)).alias("removed_words"),
        depleted.alias("depleted"),
        (~failed & ~depleted).alias("kept"),
    )
    return rows.withColumn(out, found).drop("__id", "__host", "__t", "__u", "__gone", "__s", "__lines", "__words", *[f"__own{k}" for k in range(4)])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, the verdicts and what was removed; rows as in apply_rules."""
    return apply_rules(docs.select("doc_id", "source", "text"), with_text=False).select("doc_id", "rules.*").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_words"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM w),
t AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM t WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
x AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS i FROM r, (VALUES (0), (1), (2)) v(j)) GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) AS n, sum(length(a)) AS c FROM p GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k WHERE n > 0 GROUP BY doc_id),
f AS (SELECT source, key FROM k WHERE n > 0 GROUP BY source, key HAVING count(DISTINCT doc_id) > 100),
g AS (SELECT k.doc_id, count(*) AS lines, sum(k.n) AS n FROM k JOIN f ON k.key = f.key AND k.source IS NOT DISTINCT FROM f.source WHERE k.n > 0 GROUP BY k.doc_id),
s AS (SELECT d.doc_id, coalesce(ws.n, 0) AS n_words, coalesce(ws.c, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(u.n, 0) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words, coalesce(g.lines, 0) AS removed_lines, coalesce(g.n, 0) AS removed_words
  FROM d LEFT JOIN ws USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN g USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  (NOT base_failed AND NOT removed_words > 0.7 * n_words) AS kept, CAST(removed_lines AS BIGINT) AS removed_lines, CAST(removed_words AS BIGINT) AS removed_words FROM b
"""
