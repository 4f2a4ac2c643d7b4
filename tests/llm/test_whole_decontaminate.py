"""Decontamination compares every word of a window, at every place, however documents fall into shards."""

import random

import numpy as np

from gridscore.llm.decontaminate import Windows, find_matches


def test_decoys_with_tied_counts_are_not_exact():
    rng = np.random.default_rng(5)
    n, size = 4_000, 13
    text = [[f"w{i}x{j}" for j in range(size)] for i in range(n)]
    windows = Windows([(str(i), " ".join(t).encode()) for i, t in enumerate(text)], size)
    decoys, whole = [], set()
    for i, t in enumerate(text):
        t = list(t)
        if i % 4:
            k = rng.integers(size)
            t[k : k + 1] = ["other"]
            decoys.append(text[i][k])  # alone elsewhere, so that counts are tied
        else:
            whole.add(i)
        decoys.extend(["other", *t, "other"])
        for w in text[i]:
            decoys.extend([w] * int(rng.integers(3)))
        decoys.append("other")
    stream = np.array([windows.vocab.get(w.encode(), -1) for w in decoys], np.int32)
    got = {int(i) for item, _, size, in_place in windows.matches(stream, 10) for i in item[in_place == size]}
    assert got == whole


def test_near_matches_brute(spark):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(60)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([5, 11, 12, 13, 20]))] + [f"rare{i}"] for i in range(12)]
    docs = []
    for k in range(240):
        copy = list(rng.choice(items))
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(["zzz", *vocab])
        copy[-1] = rng.choice([copy[-1], "misspelt"])
        copy = copy[rng.choice([0, 0, 0, 1, 3, 5]) :][: rng.choice([99, 99, 11, 7])]
        around = [rng.choice(vocab) for _ in range(rng.choice([0, 0, 9, 30]))]
        docs.append(rng.choice([copy + around, around + copy, [], copy]))

    def near(doc):
        n = 0
        for item in items:
            size = min(13, len(item))
            for i in range(len(item) - size + 1):
                window = item[i : i + size]
                for start in range(-size, len(doc)):
                    same = sum(0 <= start + j < len(doc) and doc[start + j] == w for j, w in enumerate(window))
                    n += 10 <= same < size
        return n

    want = {k: near(d) for k, d in enumerate(docs)}
    assert sum(n > 0 for n in want.values()) > 40
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    for parts in (1, 3, 60):
        got = find_matches(df.repartition(parts), benchmark, block_chars=500 if parts == 3 else 20_000_000).select("doc_id", "matches.n_near", "matches.n_words").collect()
        assert {r.doc_id: r.n_near for r in got} == want
        assert {r.doc_id: r.n_words for r in got} == {k: len(d) for k, d in enumerate(docs)}


def test_what_matches_return(spark):
    """Runs of exact windows and proximity matches, item by item, in words of the document."""
    item = " ".join(f"w{k}" for k in range(20))
    broken = item.replace("w5 ", "x5 ")
    benchmark = spark.createDataFrame([("a", item), ("a", item), ("b", "short One"), (None, item), ("c", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x y {item} z {item}"), (2, broken), (3, "a short, ONE."), (4, None), (None, item), (5, "nothing here")], "doc_id long, text string")
    out = {r.doc_id: r.matches for r in find_matches(docs, benchmark).collect()}
    assert len(out) == 6
    assert [tuple(s) for s in out[1].spans] == [(2, 22), (23, 43)] and out[1]["items"] == ["a"] and out[1].n_near == sum(1 for x in out[1].near)
    assert [tuple(s) for s in out[2].spans] == [(6, 19 + 1)] and {(x.item, x.start, x.stop, x.in_place) for x in out[2].near} >= {("a", k, k + 13, 12) for k in range(6)}
    assert out[3]["items"] == ["b"] and [tuple(s) for s in out[3].spans] == [(1, 3)]
    assert out[4].n_words == 0 and out[4].spans == [] and out[5].n_near == 0 and out[None]["items"] == ["a"]


def test_index_holds_every_word(spark):
    from gridscore.llm.decontaminate import BEGINS, build_index

    docs = spark.createDataFrame([(k, f"the {k} cat The dog {'long ' * k}") for k in range(30)], "doc_id long, text string").repartition(3)
    index = build_index(docs, shard_bytes=100)
    rows = index.postings.collect()
    assert len({r.shard for r in rows}) > 3
    assert sum(len(r.places) for r in rows if r.term == "the") == 60 and sum(len(r.places) for r in rows if r.term == "long") == sum(range(30))
    assert sum(len(r.places) for r in rows if r.term != BEGINS) == sum(r.n_words for r in index.documents.collect())
    assert sorted(r.id for r in index.documents.collect()) == list(range(30))
