"""Tree similarity of table pairs: an ordered tree edit distance, as a distributed job over the pairs that need one.

1. Pairs of one shape whose contents differ by at most two renames in sum are scored in the JVM.
2. The rest is made distinct by the digests of its trees. Each distinct pair has a size, the product of its trees' nodes; pairs are
   put into buckets by size, and each bucket is dealt into as many slots as its share of all work asks for, so big tables spread.
3. An Arrow function solves a slot's pairs, with and without text at once, and results are joined back by digests.

The distance is the dynamic program over pairs of subtrees whose roots no leftmost path continues; insertions and deletions cost 1, a
rename costs 1 if tag or spans differ and the share of edited content elsewhere. Rows of the program are arrays: a subtree of one side meets all
subtrees of one shape on the other at once, and pairs with a leaf have a closed form. Both trees are mirrored where rightmost paths leave less to
do. So the work is about the product of the sizes times the depths, and memory one number for each pair of nodes. A pair is solved in one piece,
whatever its size: none is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.functions.textnorm import let
from gridscore.operators.shred import TAG_CLOSE, TAG_OPEN, _hash128, nodes_of, parse, unwrap
from gridscore.sources.shared import new_path, store

_PLAIN = {ord(TAG_OPEN): "<", ord(TAG_CLOSE): ">"}
_TOKEN = re.compile(f"{TAG_OPEN}[^{TAG_CLOSE}]*{TAG_CLOSE}|.", re.S)


def edit_distances(a: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distance of a sequence of numbers to each row of a matrix of such sequences, of which the first `lengths` numbers count."""
    at = np.arange(others.shape[1] + 1)
    row = np.broadcast_to(at, (len(others), len(at)))
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (others != x), out=new[:, 1:])
        new -= at  # an insertion adds one a step, so the least over all that come before is a running minimum
        np.minimum.accumulate(new, axis=1, out=new)
        new += at
        row = new
    return row[np.arange(len(others)), lengths]


def content_costs(own: list[tuple[str, int]], others: list[tuple[str, int]], mode: str) -> Iterator[tuple[int, np.ndarray]]:
    """For each distinct (content, size) of one side: its number and the rename costs to all of the other side, between cells of the same spans."""
    numbers: dict[str, int] = {}
    symbols = lambda x: x.translate(_PLAIN) if mode == "chars" else _TOKEN.findall(x)
    coded = lambda x: np.array([numbers.setdefault(t, len(numbers)) for t in symbols(x)], np.int32)
    mine, theirs = [coded(x) for x, _ in own], [coded(x) for x, _ in others]
    sizes = np.array([n for _, n in others])
    lengths = np.array([len(x) for x in theirs])
    groups = []  # of like length, so that little is filled up
    for k in np.unique(np.ceil(np.log2(lengths + 1))):
        rows = np.flatnonzero(np.ceil(np.log2(lengths + 1)) == k)
        filled = np.full((len(rows), lengths[rows].max()), -1, np.int32)
        for i, r in enumerate(rows):
            filled[i, : lengths[r]] = theirs[r]
        groups.append((rows, filled))
    for i, x in enumerate(mine):
        out = np.empty(len(others))
        for rows, filled in groups:
            out[rows] = edit_distances(x, filled, lengths[rows])
        yield i, out / np.maximum(np.maximum(sizes, own[i][1]), 1)


def rename_costs(a: list[dict], b: list[dict], structure_only: bool, mode: str) -> np.ndarray:
    """The cost of renaming each node of a tree to each of another one."""
    kinds: dict[tuple, int] = {}
    kind = lambda nodes: np.array([kinds.setdefault((n["tag"], n["colspan"], n["rowspan"]), len(kinds)) for n in nodes])
    cost = (kind(a)[:, None] != kind(b)[None, :]).astype(float)
    if structure_only:
        return cost
    text = lambda n: (n["content"] or "", n["size"])
    cells = [[i for i, n in enumerate(t) if n["tag"] == "td"] for t in (a, b)]
    own, others = ({x: k for k, x in enumerate(dict.fromkeys(text(t[i]) for i in c))} for t, c in zip((a, b), cells))
    if not own or not others:
        return cost
    columns, theirs = np.array(cells[1]), np.array([others[text(b[j])] for j in cells[1]])
    rows: dict[int, list[int]] = {}
    for i in cells[0]:
        rows.setdefault(own[text(a[i])], []).append(i)
    for k, costs in content_costs(list(own), list(others), mode):
        for i in rows[k]:
            cost[i, columns] = np.where(cost[i, columns] == 0, costs[theirs], 1.0)
    return cost


def _children(nodes: list[dict]) -> list[list[dict]]:
    """The trees under the root, in order."""
    out, k = [], len(nodes) - 2
    while k >= 0:
        start = nodes[k]["leftmost"]
        out.append(nodes[start : k + 1])
        k = start - 1
    return out[::-1]


def _signature(tree: list[dict]) -> list[tuple]:
    return [(n["tag"], n["colspan"], n["rowspan"], n["content"], i - n["leftmost"] + tree[0]["leftmost"]) for i, n in enumerate(tree)]


def _rooted(trees: list[list[dict]], root: dict) -> list[dict]:
    out: list[dict] = []
    for tree in trees:
        shift = len(out) - tree[0]["leftmost"]
        out.extend({**n, "leftmost": n["leftmost"] + shift} for n in tree)
    return [*out, {**root, "leftmost": 0}]


def without_shared_ends(a: list[dict], b: list[dict]) -> tuple[list[dict], list[dict]]:
    """Both trees without the equal first and last trees under equal roots, which leaves the distance as it is.

    Nodes outside such a tree can map into it on one side only, and mapping it to its equal instead costs no more.
    """
    x, y = _children(a), _children(b)
    if any(a[-1][k] != b[-1][k] for k in ("tag", "colspan", "rowspan", "content")):
        return a, b
    sx, sy = [_signature(t) for t in x], [_signature(t) for t in y]
    least = min(len(x), len(y))
    lo = next((i for i in range(least) if sx[i] != sy[i]), least)
    hi = next((i for i in range(least - lo) if sx[-1 - i] != sy[-1 - i]), least - lo)
    return _rooted(x[lo : len(x) - hi], a[-1]), _rooted(y[lo : len(y) - hi], b[-1])


def _mirrored(nodes: list[dict]) -> list[dict]:
    """The tree with all children in opposite order."""
    n, out = len(nodes), []
    size = [i - x["leftmost"] + 1 for i, x in enumerate(nodes)]
    stack = [(n - 1, False)]
    while stack:
        i, seen = stack.pop()
        if seen:
            out.append({**nodes[i], "leftmost": len(out) + 1 - size[i]})
            continue
        stack.append((i, True))
        children, k = [], i - 1
        while k >= nodes[i]["leftmost"]:
            children.append(k)
            k = nodes[k]["leftmost"] - 1
        stack.extend((c, False) for c in reversed(children))
    return out


def _roots(leftmost: np.ndarray) -> np.ndarray:
    """Nodes with children that are no leftmost child: the roots of the subtrees that the program compares, in post-order."""
    last = {int(first): i for i, first in enumerate(leftmost)}
    return np.array(sorted(i for first, i in last.items() if first < i), int)


def _work(nodes: list[dict]) -> int:
    leftmost = np.array([n["leftmost"] for n in nodes])
    roots = _roots(leftmost)
    return int((roots - leftmost[roots] + 1).sum())


def _leaf_pairs(d: np.ndarray, la: np.ndarray, lb: np.ndarray) -> None:
    """Rename costs become distances of subtrees where either has one node: the best rename of it, or none, and insertions for the rest."""
    leaves = [np.flatnonzero(x == np.arange(len(x))) for x in (la, lb)]
    for m, first, own in ((d, lb, leaves[0]), (d.T, la, leaves[1])):
        for k in range(len(first) - 1, -1, -1):  # an outer subtree before those inside it, which it reads
            if first[k] < k:
                for chunk in range(0, len(own), 512):
                    rows = own[chunk : chunk + 512]
                    m[rows, k] = np.minimum(m[rows, first[k] : k + 1].min(axis=1), 2.0) + (k - first[k])
    for chunk in range(0, len(leaves[0]), 512):
        at = np.ix_(leaves[0][chunk : chunk + 512], leaves[1])
        d[at] = np.minimum(d[at], 2.0)


def _only_added(a: list[dict], b: list[dict]) -> bool:
    """Whether the longer tree without its nodes of kinds that the other lacks is the other; the distance is then the difference of their sizes, the least there is."""
    kinds = lambda t: [(n["tag"], n["colspan"], n["rowspan"], n["content"]) for n in t]
    first = lambda t: [n["leftmost"] for n in t]
    return only_added((kinds(a), first(a)), (kinds(b), first(b)))


def only_added(a: tuple[list, list], b: tuple[list, list]) -> bool:
    """_only_added of trees as the kinds of their nodes, in post-order, and where their subtrees begin."""
    (own, first), (kinds, begins) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    known, n = set(own), 0
    before = []  # nodes kept before this one: where a subtree that begins here begins then
    for kind, begin in zip(kinds, begins):
        before.append(n)
        if kind in known:
            if n == len(own) or own[n] != kind or first[n] != before[begin]:
                return False
            n += 1
    return n == len(own)


def tree_distance(a: list[dict], b: list[dict], structure_only: bool = False, mode: str = "chars") -> float:
    # where texts don't count, kinds may differ that cost nothing: such trees take the program
    if len(a) != len(b) and _only_added(a, b):
        return float(abs(len(a) - len(b)))
    a, b = without_shared_ends(a, b)
    if min(len(a), len(b)) == 1 and a[-1]["tag"] == b[-1]["tag"] != "td":
        return float(abs(len(a) - len(b)))
    x, y = _mirrored(a), _mirrored(b)
    if _work(x) * _work(y) < _work(a) * _work(b):
        a, b = x, y
    la, lb = (np.array([n["leftmost"] for n in t]) for t in (a, b))
    d = rename_costs(a, b, structure_only, mode)  # turns into distances of subtrees
    _leaf_pairs(d, la, lb)
    shapes: dict[tuple, list[int]] = {}
    for j in _roots(lb).tolist():
        shapes.setdefault((j - lb[j], (lb[lb[j] : j + 1] - lb[j]).tobytes()), []).append(j)
    for i in _roots(la).tolist():
        for shape in sorted(shapes):  # smaller ones first: larger ones read their distances
            _compare(d, la, lb, i, np.array(shapes[shape]))
    return float(d[-1, -1])


def _compare(d: np.ndarray, la: np.ndarray, lb: np.ndarray, i: int, roots: np.ndarray) -> None:
    """The program for the subtree at i and all subtrees of one shape at roots: distances of what lies on their leftmost paths go into d."""
    first, start = int(la[i]), lb[roots]
    width = int(roots[0] - start[0]) + 1
    columns = start[:, None] + np.arange(width)
    cut = lb[columns[0]] - start[0]  # what of a forest stands before the subtree that ends at a node
    path = np.flatnonzero((cut == 0) & (lb[columns[0]] < columns[0]))  # nodes with children on the leftmost path
    steps = np.arange(width + 1, dtype=float)
    row = np.broadcast_to(steps, (len(roots), width + 1))
    last_use = {int(la[x]) - first: x for x in range(first, i + 1)}
    rows = {0: row}
    for x in range(first, i + 1):
        before = int(la[x]) - first
        costs = d[x][columns]
        best = rows[before][:, cut] + costs
        new_pairs = before == 0 and la[x] < x
        if new_pairs:
            best[:, path] = row[:, path] + costs[:, path]
        new = np.empty((len(roots), width + 1))
        new[:, 0] = x - first + 1
        np.minimum(row[:, 1:] + 1, best, out=new[:, 1:])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        new += steps
        if new_pairs:
            d[x, columns[:, path]] = new[:, path + 1]
        row = new
        if last_use[before] == x:
            rows.pop(before)
        if x - first + 1 in last_use:
            rows[x - first + 1] = row


def _in_place(pred: Column, truth: Column, mode: str) -> Column:
    """The distance of two trees of one shape, node by node, where no other mapping can be better; else null."""
    a, b = pred["nodes"], truth["nodes"]
    text = lambda n: F.translate(n["content"], TAG_OPEN + TAG_CLOSE, "<>")
    cost = lambda x, y: F.when(x["content"] != y["content"], F.levenshtein(text(x), text(y)) / F.greatest(x["size"], y["size"], F.lit(1))).otherwise(0.0)
    total = F.when(pred["digest"] == truth["digest"], 0.0)
    if mode == "chars":
        total = total.otherwise(F.aggregate(F.zip_with(a, b, cost), F.lit(0.0), lambda t, x: t + x))
    # any mapping but node to node needs a deletion and an insertion, which cost 2
    return F.when(pred["shape"] == truth["shape"], let(total, lambda c: F.when(c <= 2.0, c)))


def _solver(mode: str, read=list):
    """mapInArrow over (pd, gd, a, b, same) sorted by digests: each distinct pair's distances; where shapes are the same, none without text is needed. read makes nodes of a and b."""
    schema = pa.schema([("pd", pa.string()), ("gd", pa.string()), ("d_text", pa.float64()), ("d_bare", pa.float64())])

    def bare(nodes):
        return [{**n, "content": None, "size": 0} for n in nodes]

    def run(batches):
        last = None
        for batch in batches:
            out = []
            for pd, gd, a, b, same in zip(*[c.to_pylist() for c in batch.columns]):
                if (pd, gd) != last:
                    last, a, b = (pd, gd), read(a), read(b)
                    out.append((pd, gd, tree_distance(a, b, False, mode), 0.0 if same else tree_distance(bare(a), bare(b), True, mode)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], [], []), schema.types)], schema=schema)

    return run


def _slots(hard: DataFrame, work: Column | None = None) -> DataFrame:
    """hard with `slot`, from its size bucket (by work, else the nodes' product) and its digests, and the number of slots in the column's alias."""
    n = int(hard.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = hard.withColumn("__work", F.size("a").cast("double") * F.size("b") if work is None else work).withColumn("__bucket", F.floor(F.log2("__work")).cast("int"))
    rows = sized.groupBy("__bucket").agg(F.sum("__work").alias("w"), F.count("*").alias("n")).collect()  # at most 62 rows
    whole = sum(r.w for r in rows) or 1.0
    slot, first = F.lit(0), 0
    for r in sorted(rows, key=lambda r: r["__bucket"]):
        k = max(1, min(r.n, round(n * r.w / whole)))
        slot = F.when(F.col("__bucket") == r["__bucket"], F.lit(first) + F.pmod(F.xxhash64("pd", "gd"), F.lit(k)).cast("int")).otherwise(slot)
        first += k
    return sized.withColumn("slot", slot).drop("__work", "__bucket").repartitionById(max(1, first), "slot")


def tree_scores(pairs: DataFrame, pred: str = "p", truth: str = "g", where: Column | None = None, mode: str = "chars") -> DataFrame:
    """pairs without its shredded tables, with teds and teds_s: max(0, 1 - distance / elements under the larger table), with and without text.

    Where either has no table, or the condition doesn't hold, both are 0. pairs are stored once, without trees that are scored already.
    """
    p, g = F.col(pred), F.col(truth)
    there = p["nodes"].isNotNull() & g["nodes"].isNotNull()
    if where is not None:
        there = there & F.coalesce(where, F.lit(False))
    same = p["shape"] == g["shape"]
    rest = [c for c in pairs.columns if c not in (pred, truth)]
    rows = pairs.withColumn("__there", there).withColumn("__text", F.when(F.col("__there"), _in_place(p, g, mode)))
    hard = F.col("__there") & F.col("__text").isNull()
    rows = rows.select(
        *rest, "__there", "__text", same.alias("__same"), F.greatest(p["n_elements"], g["n_elements"], F.lit(1)).alias("__n"),
        F.when(hard, p["digest"]).alias("pd"), F.when(hard, g["digest"]).alias("gd"), F.when(hard, p["nodes"]).alias("a"), F.when(hard, g["nodes"]).alias("b"),
    )
    rows = store(rows, new_path(pairs.sparkSession, "pairs"))
    left = rows.where("pd IS NOT NULL").select("pd", "gd", "a", "b", F.col("__same").alias("same"))
    solved = _slots(left).drop("slot").sortWithinPartitions("pd", "gd").mapInArrow(_solver(mode), "pd string, gd string, d_text double, d_bare double")
    solved = solved.select(F.col("pd").alias("__p"), F.col("gd").alias("__g"), "d_text", "d_bare")
    met = rows.drop("a", "b").join(solved.hint("merge"), (F.col("pd") == F.col("__p")) & (F.col("gd") == F.col("__g")), "left")
    share = lambda d: F.when(F.col("__there"), F.greatest(F.lit(0.0), 1 - d / F.col("__n"))).otherwise(0.0)
    text, bare = F.coalesce("__text", "d_text"), F.when(F.col("__same"), 0.0).otherwise(F.col("d_bare"))
    return met.select(*rest, share(text).alias("teds"), share(bare).alias("teds_s"))


def _read(ignore_nodes: tuple[str, ...]):
    """Nodes of a text's first table without those of some tags."""
    def read(text: str) -> list[dict]:
        table = parse(text)
        if ignore_nodes:
            unwrap(table, ignore_nodes)
        return nodes_of(table)

    return read


def text_scores(pairs: DataFrame, compared: str, mode: str = "chars", ignore_nodes: tuple[str, ...] = ()) -> DataFrame:
    """tree_scores of pairs that compare_texts or compare_trees has seen: pairs without html, gt_html and its column, with teds and teds_s; 0 where the column is null.

    Pairs are stored once, with the texts of the hard ones only; no tree is shuffled or stored, and where nothing is hard nothing is joined.
    """
    c = F.col(compared)
    rest = [x for x in pairs.columns if x not in (compared, "html", "gt_html")]
    hard = F.coalesce(c["hard"], F.lit(False))
    rows = pairs.select(
        *rest, F.coalesce(c["there"], F.lit(False)).alias("__there"), c["n"].alias("__n"), c["d_text"].alias("d_text"), c["d_bare"].alias("d_bare"),
        F.when(hard, _hash128("html")).alias("pd"), F.when(hard, _hash128("gt_html")).alias("gd"), F.when(hard, F.col("html")).alias("a"), F.when(hard, F.col("gt_html")).alias("b"),
    )
    rows = store(rows, new_path(pairs.sparkSession, "pairs"))
    share = lambda d: F.when(F.col("__there"), F.greatest(F.lit(0.0), 1 - F.col(d) / F.col("__n"))).otherwise(0.0).alias({"d_text": "teds", "d_bare": "teds_s"}[d])
    out = lambda df: df.select(*rest, share("d_text"), share("d_bare"))
    left = rows.where("pd IS NOT NULL")
    if left.isEmpty():
        return out(rows)
    slots = _slots(left.select("pd", "gd", "a", "b", F.lit(False).alias("same"), F.col("__n").cast("double").alias("n")), F.col("n") * F.col("n")).drop("slot", "n")
    solved = slots.sortWithinPartitions("pd", "gd").mapInArrow(_solver(mode, _read(ignore_nodes)), "pd string, gd string, d_text double, d_bare double")
    met = left.drop("a", "b", "d_text", "d_bare").join(solved.hint("merge"), ["pd", "gd"])
    return out(rows.where("pd IS NULL")).unionByName(out(met))
