"""Conversation repair against trying every sequence of edits, and odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridscore.llm import conversation_repair as cr

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not t else "d" if (role, text) in seen else "t" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) over all edits with at most two insertions in one place."""
    marks, best = faults(rows), None
    inserts = [()] + [(a,) for a in ("user", "assistant")] + [(a, b) for a in ("user", "assistant") for b in ("user", "assistant")]

    def go(i, cost, audit, lines):
        nonlocal best
        initials = "".join(x[0] for x in lines if x)
        if best and cost > best[0] or not re.fullmatch(r"s?(?:ua)*u?", initials) or any(not x or x[0] not in "sua" for x in lines):
            return
        for new in inserts:
            paid, done, all_lines = cost + 5 * len(new), audit + "I" * len(new), lines + [f"{x}:" for x in new]
            if i == len(rows):
                if re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in all_lines)) and (best is None or (paid, done) < best[:2]):
                    best = (paid, done, all_lines)
                continue
            go(i + 1, paid + 2, done + "D", all_lines)
            if marks[i] in ("b", "d"):
                continue
            stay = 5 * (marks[i] == "t")
            go(i + 1, paid + stay, done + "K", all_lines + [f"{rows[i][0]}:{rows[i][1]}"])
            for role in ("user", "assistant"):
                go(i + 1, paid + stay + 1, done + "R", all_lines + [f"{role}:{rows[i][1]}"])

    go(0, 0, "", [])
    return best


def plain(turns):
    """What repair returns for one conversation's (turn, role, text), nulls being spaces."""
    own = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns))
    rows = [(r, x) for _, _, r, x in own]
    marks, known = faults(rows), [t for has, t, _, _ in own if has]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(rows)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def got(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_every_sequence_of_edits(spark, batch):
    rng = random.Random(3)
    convs = {k: [(rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Yes.", "No", "Why? ", "", " \n", None, f"Own {rng.random()}!"])) for _ in range(rng.randint(1, 6))] for k in range(150)}
    convs[None] = [(0, "user", "A."), (1, "assistant", "B.")]
    rows = [(k, *t) for k, ts in convs.items() for t in ts]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("conv", "known", "fault", "gone", "has_turn", "kind", "copy")})
        out = got(cr.repair(df))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert out.keys() == convs.keys()
    for k, turns in convs.items():
        assert out[k] == plain(turns), turns


def test_damage_and_what_is_left(spark):
    """Each kind of damage; a conversation that loses all rows; an empty table."""
    rows = [(c, t, r, "One. Two! Three?") for c in range(60) for t, r in enumerate(("user", "assistant", "user", "assistant"))] + [(c, 0, "user", None) for c in range(100, 160)] + [(None, None, None, None)]
    out = got(cr.digest(spark.createDataFrame(rows, TURNS)))
    want = {}
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = want.setdefault(c, [])
        r, x = r if r is not None else " ", x if x is not None else " "
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [] if kind == 0 else [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out == {c: plain(ts) if ts else nothing for c, ts in want.items()} and nothing in out.values()
    assert got(cr.digest(spark.createDataFrame([], TURNS))) == {}


def test_giant_conversation(spark):
    """Backpointers beyond what memory holds, read back block by block."""
    n = cr.HELD // 3 // 2 * 2
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    lost = n // 4 * 2
    gaps, _, _, _, illegal, cost, audit, sha = got(cr.repair(df.where(F.col("turn") != lost)))[1]
    assert (gaps, illegal, cost, len(audit), audit.count("D")) == (1, 1, 2, n - 1, 1) and audit.index("D") == lost - 1
    kept = [t for t in range(n) if t not in (lost, lost - 1)]
    assert sha == hashlib.sha256("\n".join(f"{'assistant' if t % 2 else 'user'}:{t}." for t in kept).encode()).hexdigest()
    store = cr.Scratch()
    for k in range(cr.HELD):
        store.append(k.to_bytes(4, "big"))
    assert [int.from_bytes(x, "big") for x in store.backwards(4)] == list(range(cr.HELD - 1, -1, -1))
