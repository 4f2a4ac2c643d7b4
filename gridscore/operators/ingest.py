"""Recorded responses to prediction rows, and conversion over again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscore.functions.runs import chat_response_text, generate_response_text
from gridscore.operators.convert import convert_responses
from gridscore.operators.once import converted_once


def ingest_responses(responses: DataFrame) -> DataFrame:
    """responses: dataset, run_id, sample_id, seq, kind (chat or generate), body (JSON; null for a failed call), seconds, error -> prediction rows."""
    text = F.when(F.col("kind") == "chat", chat_response_text(F.col("body"))).otherwise(generate_response_text(F.col("body")))
    rows = responses.withColumn("run_ok", F.col("body").isNotNull()).withColumn("__text", F.coalesce(text, F.lit("")))
    rows = convert_responses(rows, "__text")
    ok = F.col("run_ok")
    return rows.select(
        "dataset", "run_id", "sample_id", "seq", "run_ok", (ok & F.col("conversion_ok")).alias("conversion_ok"), F.when(ok, F.col("html")).otherwise("").alias("html"), "seconds",
        F.when(ok, F.col("conversion_tag")).otherwise(F.col("error")).alias("error"), F.when(ok, F.col("removed_rows")).alias("removed_caption_note_rows"), F.when(ok, F.char_length("__text")).alias("response_chars"),
    )


def reconvert(predictions: DataFrame, raw_texts: DataFrame, converted: str | None = None) -> DataFrame:
    """predictions with html, conversion_ok and error as the current rules make them from raw_texts (raw_path, value); rows without a raw text stay.

    converted: a folder where conversions are kept, by text and version of the rules; what lies there is not converted again.
    """
    texts = raw_texts.select("raw_path", "value")
    raw = converted_once(texts, "value", converted) if converted else convert_responses(texts, "value")
    raw = raw.select("raw_path", F.col("html").alias("__html"), F.col("conversion_ok").alias("__ok"), F.col("conversion_tag").alias("__tag"))
    rows = predictions.join(raw.hint("merge"), "raw_path", "left")
    found = F.col("__ok").isNotNull()
    new = {"html": "__html", "conversion_ok": "__ok", "error": "__tag"}
    return rows.withColumns({c: F.when(found, F.col(n)).otherwise(F.col(c)) for c, n in new.items()}).select(*predictions.columns)
