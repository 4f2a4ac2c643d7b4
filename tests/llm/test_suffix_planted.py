"""Planted passages of over 50 words in 6,000 documents: op3 against a plain scan of all 400-byte windows, and what it catches.

The contract counts bytes: a passage of over 50 words that has fewer than 400 bytes stays where it is, and n_bytes is the input's length, so
what was caught shows in n_removed alone.
"""

import hashlib
import random

import numpy as np

from gridscore.llm import suffix_dedup

LENGTH = 400


def scan(texts):
    """For each text the mask of bytes that lie in a window of LENGTH bytes which also starts elsewhere, by hashes of all windows (mod 2^64)."""
    p = np.uint64(0x9E3779B97F4A7C15 | 1)
    hashes, starts = [], []
    with np.errstate(over="ignore"):
        for k, t in enumerate(texts):
            b = np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(1)
            n = len(b) - LENGTH + 1
            if n < 1:
                continue
            h = np.zeros(n, np.uint64)
            for i in range(LENGTH):  # Horner over all windows at once
                h = h * p + b[i : i + n]
            hashes.append(h)
            starts.append(np.stack([np.full(n, k), np.arange(n)], 1))
    masks = [np.zeros(len(t), bool) for t in texts]
    if hashes:
        h, at = np.concatenate(hashes), np.concatenate(starts)
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        for k, i in at[counts[inverse] > 1].tolist():
            masks[k][i : i + LENGTH] = True
    return masks


def test_planted_passages(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 11)))
    passages = [" ".join(word() for _ in range(rng.randint(51, 75))) for _ in range(60)]
    planted = {}
    texts = []
    for k in range(6000):
        body = " ".join(word() for _ in range(rng.randint(10, 60)))
        if k % 10 == 0:
            planted[k] = rng.randrange(len(passages))
            body = f"{body}\n{passages[planted[k]]}\n{word()}"
        texts.append(body)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    out = {r.doc_id: r for r in suffix_dedup.digest(df).collect()}
    raw = [t.encode() for t in texts]
    for k, (t, mask) in enumerate(zip(raw, scan(raw))):
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.concatenate([[0], mask.astype(int), [0]])) == 1).sum())
        r = out[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()), k
    long = {i for i, p in enumerate(passages) if len(p) >= LENGTH}
    shared = {i for i in long if sum(v == i for v in planted.values()) > 1}
    assert 0 < len(long) < len(passages)  # over 50 words, and some have no 400 bytes
    for k in range(len(texts)):
        size = len(passages[planted[k]]) if k in planted else 0
        if size >= LENGTH and planted[k] in shared:
            assert out[k].n_removed >= LENGTH
        elif size < LENGTH - 20:  # nearer ones may reach 400 bytes with what stands around them by chance
            assert out[k].n_removed == 0
