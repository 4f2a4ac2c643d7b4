"""Merkle manifest of a dataset, its subtrees laid out as van Emde Boas did.

Rows are leaves: SHA-256 of their fields. Within a group leaves stand in order, every three neighbours become one node, and so on
up to the group's root; the roots of the groups, in order, become one root the same way. The tree is cut into blocks: aligned
subtrees of five levels of edges. A block is one row, whose nodes lie in one binary in van Emde Boas order: the upper half of
the levels first, then each subtree of the lower half, each laid out alike. The roots of a tier's blocks are the leaves of the
next tier, until every group has one block. Construction fills a block from its leaves upwards and proofs read siblings, both by
address alone. Proofs go down the tiers: a block takes the path above it and hands each child its own.

Leaves are numbered by range partitions, so a group of any size is dealt over all tasks, and only digests, ids and group names are shuffled.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.common import CRC_SQL, stored
from gridscore.operators.ordinal import amount_before

#: Children of a node, and levels of edges in a block (243 leaves).
ARITY, HEIGHT = 3, 5
WIDTH = 32


def encoded(c: Column) -> Column:
    """A value as `-` if null, else its UTF-8 byte count, a colon and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256, as 32 bytes, of the fields in order."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in fields]).cast("binary"), 256))


@cache
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """For each depth of a complete tree of so many levels of nodes, the place of each of its nodes in van Emde Boas order."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    above = levels // 2
    below = levels - above
    size = lambda n: (ARITY**n - 1) // (ARITY - 1)
    starts = size(above) + np.arange(ARITY**above) * size(below)
    return addresses(above) + tuple((starts[:, None] + inner[None, :]).ravel() for inner in addresses(below))


def block_height(count: int, alone: bool) -> int:
    """Levels of edges of a block: all where its group has other blocks, else as few as its leaves need."""
    height = 0
    while ARITY**height < count:
        height += 1
    return height if alone else HEIGHT


def node_hash(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def build_block(leaves: list[bytes], alone: bool) -> bytes:
    """The nodes of a block in van Emde Boas order; places without a node are zero bytes."""
    height = block_height(len(leaves), alone)
    at = addresses(height + 1)
    out = bytearray(WIDTH * sum(map(len, at)))
    nodes = leaves
    for depth in range(height, -1, -1):
        for place, node in zip(at[depth].tolist(), nodes):
            out[place * WIDTH : (place + 1) * WIDTH] = node
        nodes = [node_hash(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
    return bytes(out)


def siblings(layout: bytes, count: int, alone: bool) -> list[list[tuple[list[bytes], list[bytes]]]]:
    """For each leaf of a block, level by level upwards: the nodes of its run to its left and to its right, read from the layout."""
    height = block_height(count, alone)
    at = addresses(height + 1)
    paths: list[list[tuple[list[bytes], list[bytes]]]] = [[] for _ in range(count)]
    width = count
    for depth in range(height, 0, -1):
        nodes = [layout[p * WIDTH : (p + 1) * WIDTH] for p in at[depth][:width].tolist()]
        step = ARITY ** (height - depth)
        for leaf, path in enumerate(paths):
            own = leaf // step
            first = own - own % ARITY
            path.append((nodes[first:own], nodes[own + 1 : first + ARITY]))
        width = -(-width // ARITY)
    return paths


def pack_path(path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """A byte for the nodes on the left, one for those on the right, and the nodes, level by level."""
    return b"".join(bytes((len(a), len(b))) + b"".join(a) + b"".join(b) for a, b in path)


def unpack_path(packed: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    out, i = [], 0
    while i < len(packed):
        left, right = packed[i], packed[i + 1]
        nodes = [packed[j : j + WIDTH] for j in range(i + 2, i + 2 + WIDTH * (left + right), WIDTH)]
        out.append((nodes[:left], nodes[left:]))
        i += 2 + WIDTH * (left + right)
    return out


def fold(leaf: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for left, right in path:
        leaf = node_hash([*left, leaf, *right])
    return leaf


@F.arrow_udf(T.BinaryType())
def _layout(leaves: pa.Array, alone: pa.Array) -> pa.Array:
    return pa.array((build_block(x, a) for x, a in zip(leaves.to_pylist(), alone.to_pylist())), pa.binary())


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _child_paths(layout: pa.Array, count: pa.Array, alone: pa.Array, upper: pa.Array) -> pa.Array:
    rows = zip(layout.to_pylist(), count.to_pylist(), alone.to_pylist(), upper.to_pylist())
    return pa.array(([pack_path(p) + above for p in siblings(x, n, a)] for x, n, a, above in rows), pa.list_(pa.binary()))


PROOF = T.StructType().add("proof", T.BinaryType()).add("folded", T.BinaryType())


@F.arrow_udf(T.ArrayType(PROOF))
def _proofs(leaves: pa.Array, layout: pa.Array, alone: pa.Array, upper: pa.Array) -> pa.Array:
    out = []
    for own, x, a, above in zip(leaves.to_pylist(), layout.to_pylist(), alone.to_pylist(), upper.to_pylist()):
        higher = unpack_path(above)
        tail = b"".join(n.hex().encode() for left, right in higher for n in (*left, *right))
        rows = []
        for leaf, path in zip(own, siblings(x, len(own), a)):
            inner = b"".join(n.hex().encode() for left, right in path for n in (*left, *right))
            rows.append({"proof": hashlib.sha256(inner + tail).digest(), "folded": fold(fold(leaf, path), higher)})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("proof", pa.binary()), ("folded", pa.binary())])))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """(g, block, alone, members, layout, root) of nodes (g, pos, digest, tag): one tier. members (pos, digest, tag) are at most 243."""
    full = ARITY**HEIGHT
    rows = nodes.groupBy("g", F.expr(f"pos DIV {full}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "tag"))).alias("members"))
    rows = rows.withColumn("alone", (F.col("block") == 0) & (F.size("members") < full))
    return stored(rows.withColumn("layout", _layout("members.digest", "alone")), name).withColumn("root", F.substring("layout", 1, WIDTH))


def build(nodes: DataFrame, name: str = "merkle") -> list[DataFrame]:
    """The tiers of blocks over nodes (g, pos, digest, tag), pos from 0 in each group without gaps; in the last tier every group has one block.

    A tier has a 243rd of the rows of the one below. Groups may be null; an empty table has one empty tier.
    """
    tiers = [_blocks(nodes, name)]
    while tiers[-1].where("block > 0").limit(1).count():
        tiers.append(_blocks(tiers[-1].select("g", F.col("block").alias("pos"), F.col("root").alias("digest"), F.lit(0).alias("tag")), name))
    return tiers


def with_path(tier: DataFrame, paths: DataFrame) -> DataFrame:
    """The blocks of a tier with the columns of paths (g, block, upper and whatever else goes down the tree)."""
    p = paths.withColumnsRenamed({"g": "__g", "block": "__block"})
    return tier.drop("root").join(p.hint("merge"), tier["g"].eqNullSafe(F.col("__g")) & (tier["block"] == F.col("__block"))).drop("__g", "__block")


def children(met: DataFrame) -> DataFrame:
    """The nodes at the foot of blocks that have met their paths: (digest, pos, tag), the packed path from each up to the root, and the other columns."""
    rest = [c for c in met.columns if c not in ("block", "alone", "members", "layout", "upper")]
    paths = _child_paths("layout", F.size("members"), "alone", "upper")
    return met.select(*rest, F.explode(F.arrays_zip("members", paths.alias("upper"))).alias("__c")).select(*rest, "__c.members.*", "__c.upper")


def paths_to_blocks(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """above (g, upper, ...), the packed paths of the groups' roots, handed down: (g, block, upper, ...) for the blocks of the lowest tier."""
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers[1:]):
        paths = stored(children(with_path(tier, paths)).drop("digest", "tag").withColumnRenamed("pos", "block"), "paths")
    return paths


def manifest(rows: DataFrame, group: Column, order: Column, fields: list[Column], tampered: Column | None = None, tag: Column | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """The tiers of the groups and those above the groups' roots (see build); the last block of the latter begins with the root.

    Leaves ascend by order (null first), ties by digest: rows that are equal throughout are leaves of their own, whichever stands first.
    Groups ascend bytewise, null first. A member's tag is (order, tampered digest or null, tag). Fields may be null and of any length;
    they are hashed where they are read. An empty table has no root.
    """
    none = F.lit(None)
    leaves = rows.select(
        group.cast("string").alias("g"), order.alias("o"), leaf_digest(*fields).alias("digest"),
        (none.cast("binary") if tampered is None else tampered).alias("tampered"), (none.cast("string") if tag is None else tag).alias("t"),
    )
    placed = amount_before(leaves, ["o", "digest"], F.lit(1), "pos", within=["g"])
    groups = build(placed.select("g", "pos", "digest", F.struct("o", "tampered", "t").alias("tag")))
    roots = groups[-1].select("g", F.col("root").alias("digest"))
    placed = amount_before(roots, ["g"], F.lit(1), "pos")
    return groups, build(placed.select(F.lit(0).alias("g"), "pos", "digest", F.col("g").alias("tag")), "merkle-top")


def prove(groups: list[DataFrame], top: list[DataFrame]) -> DataFrame:
    """A row for each leaf: g, o, t, leaf, subroot, root, proof (digest of all siblings up to the root, in order) and folded (the root
    that the tampered leaf, else the leaf, gives with the original siblings). Digests are 32 bytes."""
    whole = top[-1].select("g", "root", F.lit(b"").alias("upper"))
    roots = children(with_path(top[0], paths_to_blocks(top, whole))).select(F.col("tag").alias("g"), F.col("digest").alias("subroot"), "root", "upper")
    met = with_path(groups[0], paths_to_blocks(groups, stored(roots, "paths")))
    proofs = _proofs(F.transform("members", lambda m: F.coalesce(m["tag"]["tampered"], m["digest"])), "layout", "alone", "upper")
    rows = met.select("g", "subroot", "root", F.explode(F.arrays_zip("members", proofs.alias("proofs"))).alias("__c"))
    return rows.select("g", "__c.members.tag.o", "__c.members.tag.t", F.col("__c.members.digest").alias("leaf"), "subroot", "root", "__c.proofs.proof", "__c.proofs.folded")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of docs, which is tampered with where crc32 of its id is even.

    A null id is not tampered with and stands first in its source; rows of one id are leaves of their own. Tampering deletes line
    feeds, so a text without any, or none, still verifies.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even & F.contains("text", F.lit("\n")), leaf_digest(*own, F.replace("text", F.lit("\n"), F.lit(""))))
    out = prove(*manifest(docs, F.col("source"), F.col("doc_id"), [*own, F.col("text")], changed))
    hexed = lambda c, name: F.lower(F.hex(c)).alias(name)
    return out.select(
        F.col("o").alias("doc_id"), hexed("leaf", "leaf"), hexed("subroot", "subroot"), hexed("root", "root"), hexed("proof", "proof_sha256"), hexed("folded", "folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


ORACLE = r"""
WITH RECURSIVE enc AS (SELECT doc_id, source, text, concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
    coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head FROM documents),
l AS (SELECT doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    CASE WHEN CRC & 1 = 0 THEN sha256(concat(head, coalesce(concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')), '-'))) END AS changed FROM enc),
n AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
t AS (SELECT source, 0 AS lvl, pos, n, leaf AS d FROM n
  UNION ALL SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
sr AS (SELECT source, d AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, subroot AS d FROM sr
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
runs AS (SELECT source, lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM t WHERE n > 1 GROUP BY ALL),
top AS (SELECT lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM u WHERE n > 1 GROUP BY ALL),
root AS (SELECT d AS root, lvl AS height FROM u WHERE n = 1),
steps AS (SELECT n.doc_id, n.source, n.leaf, n.pos AS own, r.lvl AS step, r.ds, CAST((n.pos // CAST(pow(3, r.lvl) AS BIGINT)) % 3 AS INT) AS slot
    FROM n JOIN runs r ON n.source IS NOT DISTINCT FROM r.source AND r.run = n.pos // CAST(pow(3, r.lvl + 1) AS BIGINT)
  UNION ALL SELECT n.doc_id, n.source, n.leaf, n.pos, sr.height + top.lvl, top.ds, CAST((sr.pos // CAST(pow(3, top.lvl) AS BIGINT)) % 3 AS INT)
    FROM n JOIN sr ON n.source IS NOT DISTINCT FROM sr.source JOIN top ON top.run = sr.pos // CAST(pow(3, top.lvl + 1) AS BIGINT)),
f AS (SELECT source, pos, 0 AS step, coalesce(changed, leaf) AS cur, '' AS proof FROM n
  UNION ALL SELECT f.source, f.pos, f.step + 1, sha256(concat(array_to_string(s.ds[1:s.slot], ''), f.cur, array_to_string(s.ds[s.slot + 2:], ''))),
    concat(f.proof, array_to_string(s.ds[1:s.slot], ''), array_to_string(s.ds[s.slot + 2:], ''))
    FROM f JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.pos = s.own AND f.step = s.step)
SELECT n.doc_id, n.leaf, sr.subroot, root.root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = root.root AS verified
FROM n JOIN sr ON n.source IS NOT DISTINCT FROM sr.source CROSS JOIN root
JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.pos = f.pos AND f.step = sr.height + root.height
""".replace("CRC", CRC_SQL.replace("VALUE", "CAST(doc_id AS VARCHAR)"))
