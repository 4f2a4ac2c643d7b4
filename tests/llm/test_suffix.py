"""Suffix arrays against sorting, and repeats against a plain scan."""

import hashlib
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from gridscore.llm.suffix_dedup import suffix_array


def test_suffix_array():
    rng = random.Random(4)
    for k in range(400):
        n = rng.randint(0, 60)
        s = [rng.randint(1, rng.choice([1, 2, 3, 20])) for _ in range(n)] + [0]
        if k % 5 == 0:
            s = s[:-1] * rng.randint(1, 4) + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def plain(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(40, 160))) for _ in range(6)]
    texts = ["", "short", "a" * 399, "a" * 400, "a" * 1201, "ab" * 700, None]
    for _ in range(40):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice(["", "x", "yy"]).join(parts))
    texts += [texts[9], texts[9][:-7], texts[10][5:]]
    return texts


@pytest.mark.parametrize("seed, max_group", [(1, 20_000), (2, 20_000), (2, 3)])
def test_planted(spark, seed, max_group):
    from gridscore.llm.suffix_dedup import remove_repeats

    texts = planted(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, max_group=max_group).collect()}
    assert got == dict(enumerate(plain([(t or "").encode() for t in texts], 400)))


def test_small_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([k for k, _ in texts], plain([t for _, t in texts], 400)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.queries()["op3_suffix_dedup"](spark, sf).collect()}
    assert got == want


def test_repeated_rows_and_empty(spark):
    from gridscore.llm.suffix_dedup import digest

    t = "".join(random.Random(3).choice("abcd") for _ in range(450))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "x" + t[:420])], "doc_id long, text string")
    assert sorted(r.n_removed for r in digest(df).collect()) == [420, 450, 450, 450]
    assert digest(df.limit(0)).collect() == []
