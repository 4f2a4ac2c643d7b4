"""Chat formatting with typed content parts, native.

A turn's content is an array of parts (type, text, ref, units). A visitor turns each part into one string:
text parts are escaped text; image, audio and document parts become ordered placeholders, whose reference and
expanded token count are recorded. Turns are rendered row by row, placed by a running sum of lengths, and
gathered once per conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,units:bigint>"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, placeholders by part type, and the tokens that one unit (tile, second, page) expands to."""

    open: str = "<s>[INST]"
    sep: str = "[/INST]"
    close: str = "</s>"
    placeholders: dict = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"})
    tokens_per_unit: dict = field(default_factory=lambda: {"image": 256, "audio": 25, "document": 512})
    control: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<|image|>", "<|audio|>", "<|document|>")

    def escape(self, c: Column) -> Column:
        """No control string is left; a backslash stands before what was a backslash and inside what was a control string."""
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for x in self.control:
            c = F.replace(c, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
        return c

    @staticmethod
    def unescape(c: Column) -> Column:
        return F.regexp_replace(c, r"(?s)\\(.)", "$1")

    def visit(self, part: Column) -> Column:
        """(body, kind, ref, tokens) of a part; an unknown or null type is text, a null text is empty."""
        kinds = list(self.placeholders)
        kind = F.when(part["type"].isin(kinds), part["type"])
        body = self.escape(F.coalesce(part["text"], F.lit("")))
        tokens = F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"\w+|[^\w\s]"))
        for k in kinds:
            body = F.when(kind == k, F.lit(self.placeholders[k])).otherwise(body)
            tokens = F.when(kind == k, F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1)) * self.tokens_per_unit[k]).otherwise(tokens)
        return F.struct(body.alias("body"), kind.alias("kind"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"))


def text_parts(text: Column) -> Column:
    """One text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("units")))


def format_chats(turns: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", template: ChatTemplate | None = None, loss_roles: tuple = ("assistant",)) -> DataFrame:
    """One row per conversation: its id as conv_id, formatted, n_turns, loss_spans, attachments, n_tokens.

    parts: an array of PART; null or empty is an empty turn. Turns are ordered by turn (null first), then role and
    rendered text, so ties and repeated rows give one result. A null role is an empty role. A null conversation id
    is a conversation of its own. loss_spans: (turn, start, length) of each trained text, in code points from the start of
    the formatted text, and turn_start of its turn. attachments: (position, turn, kind, ref, tokens) in order.
    A conversation is one record and is bounded by what one row may hold. An empty table gives an empty table.
    """
    t = template or ChatTemplate()
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("__turn"), F.coalesce(F.col(role_col), F.lit("")).alias("__role"), F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), t.visit).alias("__parts"))
    body = F.array_join(F.transform("__parts", lambda p: p["body"]), "")
    rows = rows.withColumn("__head", F.concat(F.lit(t.open), t.escape(F.col("__role")), F.lit(t.sep))).withColumn("__body", body).withColumn("__piece", F.concat("__head", "__body", F.lit(t.close)))
    order = Window.partitionBy("conv_id").orderBy("__turn", "__role", "__body")
    rows = rows.withColumn("__nth", F.row_number().over(order)).withColumn("__start", F.sum(F.char_length("__piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("__piece"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("__nth", "__start", "__role", F.char_length("__head").alias("head"), F.char_length("__body").alias("len"), "__piece", "__parts"))).alias("__t"))
    spans = F.transform(F.filter("__t", lambda x: x["__role"].isin(list(loss_roles))), lambda x: F.struct(x["__nth"].alias("turn"), (x["__start"] + x["head"]).alias("start"), x["len"].alias("length"), x["__start"].alias("turn_start")))
    files = F.flatten(F.transform("__t", lambda x: F.transform(F.filter(x["__parts"], lambda p: p["kind"].isNotNull()), lambda p: F.struct(x["__nth"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
    tokens = F.aggregate(F.flatten(F.transform("__t", lambda x: x["__parts"])), F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("__t", lambda x: x["__piece"]), "").alias("formatted"),
        F.size("__t").cast("long").alias("n_turns"),
        spans.alias("loss_spans"),
        F.transform(files, lambda x, i: F.struct(i.alias("position"), x["turn"].alias("turn"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))).alias("attachments"),
        tokens.alias("n_tokens"),
    )


def parse_chats(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """formatted with turns (array of role, text) and loss_text, read back from the formatted text and its spans."""
    t = template or ChatTemplate()
    q = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    pieces = F.split("formatted", q(t.close), -1)
    rule = f"(?s)^{q(t.open)}(.*?){q(t.sep)}(.*)$"
    out = formatted.withColumn("__pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    read = F.transform("__pieces", lambda p: F.struct(t.unescape(F.regexp_extract(p, rule, 1)).alias("role"), t.unescape(F.regexp_extract(p, rule, 2)).alias("text")))
    under = F.transform("loss_spans", lambda s: t.unescape(F.substring(F.element_at("__pieces", s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"])))
    return out.withColumn("turns", read).withColumn("loss_text", F.array_join(under, "")).drop("__pieces")


def digest(conversations: DataFrame) -> DataFrame:
    """All conversations plus conversation -7, whose two texts are control strings."""
    extra = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    out = parse_chats(format_chats(rows, text_parts(F.col("text"))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped(c: str) -> str:
    out = f"replace({c}, chr(92), chr(92) || chr(92))"
    for x in ChatTemplate().control:
        out = f"replace({out}, '{x}', '{x[0]}' || chr(92) || '{x[1:]}')"
    return out


ORACLE = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, {_escaped("role")} AS er, {_escaped("text")} AS et FROM r)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
