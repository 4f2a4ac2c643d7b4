"""Every operator that SQL cannot express, against a plain version of its contract."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash

import __spark_entry__ as entry

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(spark, name, sf=SMALL):
    return entry.queries()[name](spark, sf).collect()


def documents(spark, sf=SMALL):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op2_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    out = rows(spark, "op2_language_id", MID)
    assert len(out) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in out)
    own = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in own) >= 0.97 * len(own)


def test_op5_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    out = {r.doc_id: r for r in rows(spark, "op5_quality_classifier", MID)}
    own = [(out[k].score, q) for k, q in truth.items() if held(k)]
    good, bad = [s for s, q in own if q], [s for s, q in own if not q]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.9 * len(good) * len(bad)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())


def test_op7_main_text(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in rows(spark, "op7_html_extract"):
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_op9_brute(spark):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{MID}/benchmark.parquet").collect():
        w = low(r.text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    texts = documents(spark, MID)
    found = 0
    for r in rows(spark, "op9_decontaminate", MID):
        w, hit, items = low(texts[r.doc_id]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= got
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        found += r.contaminated
    assert found


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps):
    up = {k: k for k in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {k: root(k) for k in fps}


def test_op10_brute(spark):
    fps = {k: simhash(t) for k, t in documents(spark, MID).items()}
    want = classes(fps)
    out = rows(spark, "op10_simhash", MID)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {(k, f"{v:016x}", want[k]) for k, v in fps.items()}


def test_op10_text_ids(spark):
    from gridscore.llm.simhash import near_duplicates

    texts = {"b": "one two three four", "a": "one two three four", "c": "other words than these", "d": "", "e": None}
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in [*texts.items(), (None, "x")]], "name string, text string, fp int, component int, root int")
    out = {r.name: (r.fp, r.component) for r in near_duplicates(df, "name").collect()}
    assert {k: c for k, (_, c) in out.items()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", None: None} and out["a"][0] == out["b"][0]


@pytest.mark.parametrize("max_list", [2, 5, 2048])
def test_links_of_long_lists(spark, max_list):
    import random

    from gridscore.llm import simhash as S

    rng = random.Random(max_list)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {i: rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for i in range(300)}
    fps = {v: k for k, v in fps.items()}
    fps = {k: v for v, k in fps.items()}
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(sign(v),) for v in fps.values()], "fp long")
    got = {r.node: r.component for r in S.components(S.fingerprint_links(nodes, max_list)).collect()}
    same = lambda c: sorted(sorted(k for k in c if c[k] == x) for x in set(c.values()))
    assert same({k: got.get(sign(v), sign(v)) for k, v in fps.items()}) == same(classes(fps))


def test_op8_packing(spark):
    from gridscore.llm.packing import optimal_boundaries

    texts = documents(spark)
    out = rows(spark, "op8_packing")
    size = defaultdict(int)
    for r in out:
        size[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_len
    assert dict(size) == {k: len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", t or "")) for k, t in texts.items()}
    batches = defaultdict(list)
    for r in out:
        batches[r.batch].append(r)
    for b in batches.values():
        assert len({r.bucket_len for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_len <= 65536
    import random

    rng = random.Random(1)
    cost = lambda h, bs: sum(n * (min(b for b in bs if b >= k) - k) for k, n in h.items())
    for _ in range(60):
        h = {rng.randint(0, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        k = rng.randint(1, 4)
        top = max(h)
        best = min(cost(h, [*c, top]) for j in range(k) for c in combinations([x for x in h if x < top], j))
        got = optimal_boundaries(h, k)
        assert len(got) <= k and got[-1] == top and cost(h, got) == best
    assert optimal_boundaries({}, 3) == []


def test_op8_plain_packer(spark):
    """The query's batches from plain Python: pieces by a scan for units, boundaries by trying all, batches in order of id and piece."""
    import re
    from collections import Counter

    texts = documents(spark, MID)
    unit = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0b\f\r]")
    pieces = {}
    for k, t in texts.items():
        at = [m.start() for m in unit.finditer(t or "")]
        starts = [0, *at[4096::4096]]
        for i, (a, z) in enumerate(zip(starts, [*starts[1:], len(t or "")])):
            pieces[k, i] = (a, z, min(4096, len(at) - i * 4096))
    out = rows(spark, "op8_packing", MID)
    assert {(r.doc_id, r.piece): (r.start, r.stop, r.n_tokens) for r in out} == pieces and len(out) == len(pieces)
    for k, t in texts.items():
        own = sorted(a for (d, _), a in pieces.items() if d == k) if len(t or "") > 20_000 else [(0, len(t or ""), 0)]
        assert "".join((t or "")[a:z] for a, z, _ in own) == (t or "")
    # least padding with 16 bounds, by the plain recurrence over distinct lengths
    tally = sorted(Counter(n for _, _, n in pieces.values()).items())
    ahead = [0]
    for _, n in tally:
        ahead.append(ahead[-1] + n)
    weight = [0]
    for length, n in tally:
        weight.append(weight[-1] + length * n)
    cost = lambda i, j: (ahead[j] - ahead[i]) * tally[j - 1][0] - (weight[j] - weight[i])
    row = [0] + [float("inf")] * len(tally)
    for _ in range(16):
        row = [0] + [min(row[i] + cost(i, j) for i in range(j)) for j in range(1, len(tally) + 1)]
    assert sum(r.bucket_len - r.n_tokens for r in out) == row[-1]
    bounds = sorted({r.bucket_len for r in out})
    assert all(r.bucket_len == min(b for b in bounds if b >= r.n_tokens) for r in out)
    shards = defaultdict(list)
    for r in out:
        shards[r.batch.rsplit("-", 1)[0]].append(r)
    for own in shards.values():
        own.sort(key=lambda r: (r.doc_id, r.piece))
        room = max(1, 65536 // max(1, own[0].bucket_len))
        assert [(int(r.batch.rsplit("-", 1)[1]), r.slot) for r in own] == [divmod(i, room) for i in range(len(own))]


def test_op8_pieces_are_the_text(spark):
    from gridscore.llm.packing import pack_documents, piece_texts

    texts = {1: "a b  c, d \u00e9\U0001f600 e\n", 2: None, 3: "", 4: "  \t ", 5: "x" * 50, 6: "w " * 40 + " . "}
    df = spark.createDataFrame([(k, t, 1, "z", 0) for k, t in texts.items()], "doc_id long, text string, start int, batch string, piece int")
    for max_len in (1, 3, 64):
        got = defaultdict(list)
        for r in piece_texts(df, pack_documents(df, max_len=max_len)).collect():
            got[r.doc_id].append((r.piece, r.piece_text))
        assert {k: "".join(t for _, t in sorted(v)) for k, v in got.items()} == {k: t or "" for k, t in texts.items()}
