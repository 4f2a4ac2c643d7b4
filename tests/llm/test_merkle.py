"""The Merkle manifest against a plain tree, its layout, and odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridscore.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return H(enc(doc_id), enc(source), enc(lang), enc(n_chars), enc(text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    out = []
    for nodes in tree[:-1]:
        first = at - at % 3
        out.append((nodes[first:at], nodes[at + 1 : first + 3]))
        at //= 3
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, by lists only."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels([leaf(*r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            whole = path(trees[s], at) + path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r[0], r[1].replace("\n", ""), *r[2:]) if tampered else leaf(*r)
            for a, b in whole:
                node = H(*a, node, *b)
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], H(*(n for a, b in whole for n in (*a, *b))), node, node == top[-1][0]))
    return out


def got(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()]


order = lambda rows: sorted(rows, key=str)


def test_layout_addresses():
    for n in range(1, 7):
        at = merkle.addresses(n)
        assert [len(a) for a in at] == [3**d for d in range(n)]
        assert sorted(p for a in at for p in a.tolist()) == list(range((3**n - 1) // 2)) and at[0][0] == 0
    # Four levels: a top of two, then nine subtrees of two, each together.
    at = merkle.addresses(4)
    assert at[1].tolist() == [1, 2, 3] and at[2].tolist() == [4 + 4 * k for k in range(9)] and at[3].tolist() == [5 + 4 * (k // 3) + k % 3 for k in range(27)]


def test_blocks_hold_the_plain_tree():
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 9, 10, 100, 242, 243):
        nodes = [rng.randbytes(32) for _ in range(n)]
        layout = merkle.build_block(nodes, n < 243)
        tree = levels([x.hex() for x in nodes])
        assert layout[:32].hex() == tree[-1][0]
        for at, own in enumerate(merkle.siblings(layout, n, n < 243)):
            assert [([x.hex() for x in a], [x.hex() for x in b]) for a, b in own] == path(tree, at)
            assert merkle.unpack_path(merkle.pack_path(own)) == own and merkle.fold(nodes[at], own) == layout[:32]


@pytest.mark.parametrize("parts", [1, 5])
def test_tiers_against_plain(spark, parts):
    """Several tiers of blocks in a source, and of sources; nulls in every column, equal ids, repeated rows, odd names."""
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", "one\ntwo\n", "no feed", "é\n" * 50])
    rows = [(k, text(), rng.choice([None, "en"]), "hot", rng.choice([None, k])) for k in range(800)]
    rows += [(1000 + k, text(), "de", f"s{k // 2}", k) for k in range(560)]
    rows += [(None, "a\nb", None, None, None), (None, "a\nb", None, None, None), (7, None, None, None, None), (7, "x\n", "en", "ü", 1), (7, "y\n", "en", "ü", 1), (8, "\n", "en", "", 1), (9, "long\n" * 50_000, "en", "z", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(parts).withColumns({c: F.lit(1) for c in ("g", "pos", "leaf", "root", "tag", "block", "upper", "o")})
    assert order(got(merkle.digest(df))) == order(plain(rows))


def test_small_tables(spark):
    assert got(merkle.digest(spark.createDataFrame([], DOCS))) == []
    one = [(2, "a\nb", "en", "s", 3)]
    assert got(merkle.digest(spark.createDataFrame(one, DOCS))) == plain(one)
    assert plain(one)[0][1] == plain(one)[0][2] == plain(one)[0][3]
