"""Repair of conversations: the cheapest edits that make roles alternate.

Rows are partitioned by conversation once and sorted by turn; equal rows are marked by a window over the same partitioning. mapInPandas
streams a partition and carries a dynamic program across Arrow batches: for each of four states of the pattern `(s?(ua)+)?` the least cost, the rank of
its edits in ASCII order and a running SHA-256 of the rows so far, copied where ways part. So no text is held beyond its batch. What remains of a row is four
bytes of backpointers, which go to a scratch file of the task once a conversation is long; as Spark's own spill files they are nobody else's, and
a task that runs elsewhere makes them anew.

Why forward steps may compare edits: insertions stand before the row's own edit (or at the very end), so all ways that lead to one row end with
an edit of that row, none is the beginning of another one, and their order is decided by the order of the ways they extend and then by the letters added.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.llm.common import CRC_SQL, WS

#: Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Faults of a row; NONE marks a row that only names its conversation.
SOUND, BLANK, DUPLICATE, TRUNCATED, NONE = 0, 1, 2, 3, 4
FAR = 1 << 60
#: States: nothing yet, a system row, a user row, an assistant row (one may end in the first and the last). Roles that may follow each.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEW = ("user", "user", "assistant", "user")
ENDS = (0, 3)
#: Bytes of backpointers that stay in memory.
HELD = 1 << 20


def inserted(state: int, n: int) -> int:
    """The state after n inserted rows; what may be inserted follows from the state."""
    for _ in range(n):
        state = AFTER[state][NEW[state][0]]
    return state


@lru_cache(65536)
def step(costs: tuple[int, ...], ranks: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, int, tuple[int, int, str] | None], ...]:
    """For each state after a row: cost, rank, and (state before, insertions, edit) or None where it can't be reached.

    Costs are relative to the least one, so the calls of a long conversation repeat.
    """
    best: list = [None] * 4
    for old, cost in enumerate(costs):
        if cost >= FAR:
            continue
        for n in range(3):
            at = inserted(old, n)
            edits = [("D", at, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                stay = CUT * (fault == TRUNCATED)
                edits += [("R", AFTER[at][NEW[at][0]], REROLE + stay)] + ([("K", AFTER[at][initial], KEEP + stay)] if initial in AFTER[at] else [])
            for letter, new, price in edits:
                way = (cost + INSERT * n + price, ranks[old], "I" * n + letter, (old, n, letter))
                if best[new] is None or way < best[new]:
                    best[new] = way
    order = {w: r for r, w in enumerate(sorted((w[1], w[2]) for w in best if w))}
    return tuple((w[0], order[w[1], w[2]], w[3]) if w else (FAR, 0, None) for w in best)


class Scratch:
    """Bytes that are appended and then read from the end; beyond HELD they lie in a file of the task."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=HELD)
        self.size = 0

    def append(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def backwards(self, width: int) -> Iterator[bytes]:
        """Records of one width, the last one first, a block at a time."""
        block, end = (1 << 16) * width, self.size
        while end:
            begin = max(0, end - block)
            self.file.seek(begin)
            data = self.file.read(end - begin)
            for i in range(len(data) - width, -1, -width):
                yield data[i : i + width]
            end = begin


class Repair:
    """A conversation as it is read: its counts and its dynamic program."""

    LETTERS = "DKR"

    def __init__(self, conv: str | None, known: bool) -> None:
        self.conv, self.known = conv, known
        self.turns, self.first, self.last, self.illegal, self.before = 0, None, None, 0, None
        self.faults = [0] * 5
        self.base, self.costs, self.ranks = 0, (0, FAR, FAR, FAR), (0, 0, 0, 0)
        self.hashes: list = [hashlib.sha256(), None, None, None]
        self.lines = [False] * 4
        self.back = Scratch()

    def add(self, has_turn: bool, turn: int, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if fault == NONE:
            return
        if has_turn and (self.last is None or turn != self.last):
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        least = min(self.costs)
        self.base += least
        ways = step(tuple(c - least if c < FAR else FAR for c in self.costs), self.ranks, initial if initial in ("s", "u", "a") else "", fault)
        hashes, lines, packed = [None] * 4, [False] * 4, bytearray(4)
        for new, (_, _, way) in enumerate(ways):
            if way:
                old, n, letter = way
                packed[new] = old | n << 2 | self.LETTERS.index(letter) << 4
                sha, some, state = self.hashes[old].copy(), self.lines[old], old
                rows = []
                for _ in range(n):
                    rows.append(NEW[state] + ":")
                    state = inserted(state, 1)
                if letter != "D":
                    rows.append(f"{role if letter == 'K' else NEW[state]}:{text}")
                for row in rows:
                    sha.update((("\n" if some else "") + row).encode())
                    some = True
                hashes[new], lines[new] = sha, some
        self.hashes, self.lines = hashes, lines
        self.costs, self.ranks = tuple(w[0] for w in ways), tuple(w[1] for w in ways)
        self.back.append(bytes(packed))

    def finish(self) -> dict:
        ends = []
        for state, cost in enumerate(self.costs):
            for n in range(3) if cost < FAR else ():
                if inserted(state, n) in ENDS:
                    ends.append((cost + INSERT * n, self.ranks[state], n, state))
        cost, _, n, state = min(ends)
        sha, some, at = self.hashes[state], self.lines[state], state
        letters = ["I" * n]
        for _ in range(n):
            sha.update((("\n" if some else "") + NEW[at] + ":").encode())
            some, at = True, inserted(at, 1)
        for packed in self.back.backwards(4):
            way = packed[state]
            letters.append("I" * (way >> 2 & 3) + self.LETTERS[way >> 4])
            state = way & 3
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {
            "conv": self.conv, "known": self.known, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED],
            "illegal": self.illegal, "cost": self.base + cost, "audit": "".join(reversed(letters)), "repaired_sha256": sha.hexdigest(),
        }


REPAIRED = "conv string, known boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas over rows (conv, known, has_turn, turn, role, text, fault, at) sorted by conversation and turn: a row for each conversation."""
    own, done = None, []
    for batch in batches:
        for conv, known, *row in batch.itertuples(index=False, name=None):
            if own is None or conv != own.conv or known != own.known:
                if own is not None:
                    done.append(own.finish())
                own = Repair(conv, known)
            own.add(*row[:-1])
        if done:
            yield pd.DataFrame(done)
            done = []
    if own is not None:
        yield pd.DataFrame([own.finish()])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """A row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation go by turn (null first), rows of one turn by role and text. Null roles and texts are one space, a null id is a
    conversation. The first fault of a row counts: blank (white space only), duplicate (role and text of an earlier row), truncated (the last
    character that is not white space is no `.`, `!` or `?`). Blank and duplicate rows are deleted; see the costs above for the rest. Of the cheapest edits the
    ASCII-least audit (K keep, R rerole, D delete, I insert, in order) is taken, whose roles' initials match `(s?(ua)+)?`; it tells the result,
    `role:text` joined by line feeds, from which the digest comes. gaps counts the turns missing between the least and the greatest one.
    Rows where `gone` is true count as absent, but their conversation has a row: zeros, an empty audit, the digest of nothing.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    conv, turn = F.col(conv_col), F.col(turn_col)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(
        F.coalesce(conv.cast("string"), F.lit("")).alias("conv"), conv.isNotNull().alias("known"), turn.isNotNull().alias("has_turn"),
        F.coalesce(turn.cast("long"), F.lit(0)).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.lit(False) if gone is None else gone).alias("gone"),
    ).repartition(n, "conv", "known")
    same = Window.partitionBy("conv", "known", "gone", "role", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).orderBy("has_turn", "turn")
    fault = (
        F.when(F.col("gone"), NONE).when(F.btrim("text", F.lit(WS)) == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.substring(F.rtrim("text", F.lit(WS)), -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    # This window, whose numbers aren't used, demands one partition and the order of turns for each conversation, whatever Spark made of the steps before.
    turns = Window.partitionBy("conv", "known").orderBy("has_turn", "turn", "role", "text", F.col("fault") == DUPLICATE)
    ordered = own.withColumn("fault", fault).drop("gone").withColumn("at", F.row_number().over(turns))
    out = ordered.mapInPandas(_repairs, REPAIRED)
    own_id = F.when(F.col("known"), F.col("conv")).cast(rows.schema[conv_col].dataType).alias(conv_col)
    return out.select(own_id, *[c for c in out.columns if c not in ("conv", "known")])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows hurt by crc32 of `conv_id:turn` modulo 20, a null being one space: 0 drops a row, 1 empties its text,
    2 takes its `.`, `!` and `?` away, 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged first (see damaged and repair)."""
    return repair(damaged(conversations), gone=F.col("gone"))


ORACLE = r"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    CRC % 20 AS k FROM (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM base CROSS JOIN (VALUES (0), (1)) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM o),
f AS (SELECT *, CASE WHEN t = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM g),
ins(s0, s1, letters, price, lines) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 5, chr(10) || 'user:'), (1, 2, 'I', 5, chr(10) || 'user:'), (2, 3, 'I', 5, chr(10) || 'assistant:'), (3, 2, 'I', 5, chr(10) || 'user:'),
  (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 'II', 10, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(s1, s2, letter, price, initial, named) AS (VALUES (0, 0, 'D', 2, '', ''), (1, 1, 'D', 2, '', ''), (2, 2, 'D', 2, '', ''), (3, 3, 'D', 2, '', ''),
  (0, 2, 'R', 1, '', 'user'), (1, 2, 'R', 1, '', 'user'), (2, 3, 'R', 1, '', 'assistant'), (3, 2, 'R', 1, '', 'user'),
  (0, 1, 'K', 0, 's', ''), (0, 2, 'K', 0, 'u', ''), (1, 2, 'K', 0, 'u', ''), (2, 3, 'K', 0, 'a', ''), (3, 2, 'K', 0, 'u', '')),
moves AS (SELECT s0, s2, letters || letter AS letters, ins.price + edits.price AS price, lines, letter, initial, named FROM ins JOIN edits USING (s1)),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT p.conv_id, p.i + 1, m.s2, min({'cost': CAST(p.best.cost + m.price + CASE WHEN f.fault = 't' AND m.letter <> 'D' THEN 5 ELSE 0 END AS BIGINT), 'audit': p.best.audit || m.letters,
      'lines': p.best.lines || m.lines || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || m.named || ':' || f.text END})
    FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 JOIN moves m ON m.s0 = p.state
    WHERE m.letter = 'D' OR (f.fault NOT IN ('b', 'd') AND (m.letter = 'R' OR m.initial = left(f.role, 1))) GROUP BY p.conv_id, p.i, m.s2),
c AS (SELECT b.conv_id, count(f.i) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps, count(*) FILTER (WHERE f.fault = 'b') AS blank,
    count(*) FILTER (WHERE f.fault = 'd') AS duplicate, count(*) FILTER (WHERE f.fault = 't') AS truncated,
    count(*) FILTER (WHERE left(f.previous, 1) || left(f.role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) b LEFT JOIN f ON b.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY b.conv_id),
e AS (SELECT p.conv_id, min({'cost': CAST(p.best.cost + ins.price AS BIGINT), 'audit': p.best.audit || ins.letters, 'lines': p.best.lines || ins.lines}) AS best
  FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n JOIN ins ON ins.s0 = p.state WHERE ins.s1 IN (0, 3) GROUP BY p.conv_id)
SELECT c.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(substr(e.best.lines, 2)) AS repaired_sha256
FROM c JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
""".replace("CRC", CRC_SQL.replace("VALUE", "key"))
