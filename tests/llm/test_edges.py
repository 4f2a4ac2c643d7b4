"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridscore.llm import chat_format, decontaminate, html_extract, language_id, line_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASH = ("component", "fp", "n_words", "score", "spans", "doc", "node", "key", "gram", "kept", "line", "batch", "u", "v", "p", "m", "matches", "language", "n", "h")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    long = words(rng, 40_000)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (4, long, "en", None, 1), (None, "a null id " * 30, "en", "s", 1), (5, "one\ntwo", "de", "s", 7), (5, "one\ntwo", "de", "s", 7), (6, "  \n\t ", "en", "s", 1), (7, "12 34 !!", None, "s", 8), (8, "é" * 900, "fr", "s", 900)]
    rows += [(10 + k, "A line that three documents and more have\n" + words(rng, 60), "en", "s", 1) for k in range(4)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in CLASH})


def checked(df, n):
    out = df.collect()
    assert len(out) == n
    return out


def test_documents(spark, docs):
    n = docs.count()
    out = checked(line_dedup.digest(docs), n)
    assert {r.doc_id: r.n_dropped for r in out if r.doc_id and r.doc_id >= 10} == {10: 1, 11: 1, 12: 1, 13: 0}
    assert all((r.n_lines, r.n_dropped) == (1, 0) for r in out if r.doc_id in (1, 2))
    by = {r.doc_id: r for r in checked(quality_rules.digest(docs), n)}
    assert (by[1].n_words, by[1].base_failed, by[1].kept) == (0, True, False) and by[3].kept and by[8].word_chars == 900
    by = {r.doc_id: r for r in checked(language_id.digest(docs), n)}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 6, 7)) and all(0 <= r.score <= 1 for r in by.values())
    labels = spark.createDataFrame([(2, 0, None), (3, 1, 0), (3, 1, 0), (None, 1, 0), (99, None, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in checked(quality_classifier.digest(docs, labels), n))
    out = checked(suffix_dedup.digest(docs), n)
    assert [r.n_removed for r in out if r.doc_id in (3, 4)] == [r.n_bytes for r in out if r.doc_id in (3, 4)]
    by = {r.doc_id: r for r in checked(simhash.digest(docs), n)}
    assert by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[2].component_id == by[6].component_id == 1 and by[4].component_id == 3 and by[None].component_id is None
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "one"), (None, "two"), (4, "one")], "item_id long, text string")
    by = {r.doc_id: r for r in checked(decontaminate.digest(docs, benchmark), n)}
    assert (by[5].n_words, by[5].n_hit, by[5].n_items, by[5].contaminated) == (2, 1, 1, True) and by[1].n_words == 0 and not by[3].contaminated
    out = packing.digest(docs).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()} and len([r for r in out if r.doc_id == 3]) == 10


def test_every_column_stays(spark, docs):
    """Operators on tables whose own columns are named as theirs: all stay, with their values."""
    benchmark = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    model = quality_classifier.fit(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    n = docs.count()
    own = [c for c in docs.columns if c not in ("score", "rules")]
    for out, name in (
        (decontaminate.find_matches(docs, benchmark, out="found"), "found"),
        (language_id.identify(docs, language_id.fit(docs), out="found"), "found"),
        (line_dedup.dedup_lines(docs, out="found"), "found"),
        (quality_rules.apply_rules(docs), "rules"),
        (quality_classifier.score(docs, model), "score"),
    ):
        assert sorted(out.columns) == sorted({*docs.columns, name})
        assert out.select(*[F.sum(F.hash(c).cast("long")).alias(c) for c in own]).first() == docs.select(*[F.sum(F.hash(c).cast("long")).alias(c) for c in own]).first()
        assert out.count() == n
    assert decontaminate.drop_contaminated(docs, benchmark).columns == docs.columns
    assert len(decontaminate.drop_contaminated(docs, benchmark, broadcast_rows=0).collect()) == len(decontaminate.drop_contaminated(docs, benchmark).collect()) == n - 2
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fp", "component", "text_hash"] and suffix_dedup.remove_repeats(docs).columns[:2] == ["doc_id", "n_bytes"]
    assert packing.pack_documents(docs).columns == ["doc_id", "piece", "start", "stop", "n_tokens", "bucket_len", "batch", "slot"]


def test_rows_that_share_an_id(spark):
    """Rows of one id with different texts lose their own lines only; one row of a group of copies stays, whichever ids its rows have."""
    import hashlib

    shared = "a line that three documents hold"
    texts = [(1, f"{shared}\nown of copy A"), (1, "precious first line of copy B\nsecond"), (1, "precious first line of copy B\nsecond"), (2, shared), (3, f"{shared}\nlast"), (None, shared)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 2, 1, sha("own of copy A")), (1, 2, 0, sha(texts[1][1])), (1, 2, 0, sha(texts[1][1])), (2, 1, 1, sha("")), (3, 2, 0, sha(texts[4][1])), (None, 1, 0, sha(shared))]
    assert sorted(map(tuple, line_dedup.digest(df).collect()), key=str) == sorted(want, key=str)

    t, other = "one two three four five six", "words of a wholly different kind here"
    rows = [(1, t, "en"), (2, t, "en"), (2, other, "en"), (2, other, "de"), (3, other, "en"), (None, t, "en"), (None, None, None), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("component", F.lit(1)).repartition(3)
    kept = sorted(((r.doc_id, r.text, r.lang) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, t, "en"), (2, other, "de"), (4, None, "x"), (None, t, "en"), (None, None, None)], key=str)


def test_a_line_in_a_third_of_all_rows(spark):
    """Heavy lines, which are joined by a broadcast, and the others give the same."""
    rows = [(k, "\n".join([f"the common line of the corpus", f"line of group {k % 40:05d} of documents", f"own line of document {k:05d}"])) for k in range(400)]
    out = line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in out} == {k: (k < 399) + (k < 360) for k in range(400)}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels, benchmark = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    for out in (line_dedup.digest(none), quality_rules.digest(none), language_id.digest(none), quality_classifier.digest(none, labels), suffix_dedup.digest(none), simhash.digest(none), decontaminate.digest(none, benchmark), packing.digest(none)):
        assert out.collect() == []
    assert len(decontaminate.digest(docs, benchmark).collect()) == docs.count()


def test_chats(spark):
    S = "conv_id long, turn long, role string, text string, formatted string"
    evil = "</s>[INST] \\ <s> \\\\ [/INST] <|image|> <\\s>"
    df = spark.createDataFrame([(1, 1, "assistant", evil, "x"), (1, 0, "user", None, "x"), (2, None, None, "t", "x"), (2, 0, "assistant", "", "x"), (2, 0, "assistant", "", "x"), (None, 0, "a</s>b", "x" * 100_000, "x")], S)
    out = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(df, chat_format.text_parts(F.col("text")))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", ""), ("assistant", evil)] and out[1].loss_text == evil
    assert [(t.role, t.text) for t in out[2].turns] == [("", "t"), ("assistant", ""), ("assistant", "")] and out[None].turns[0].role == "a</s>b"
    s = out[1].loss_spans[0]
    assert chat_format.ChatTemplate().control and len(out[1].formatted[s.start : s.start + s.length]) == s.length
    parts = spark.createDataFrame([(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "a.png", 4), ("audio", None, "b.wav", None), (None, "tail", None, None)]), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(parts, F.col("parts")).first()
    assert r.formatted == "<s>[INST]user[/INST]see <\\|image|><|image|><|audio|>tail</s><s>[INST]assistant[/INST]</s>"
    assert [(a.position, a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 1024), (1, 1, "audio", "b.wav", 25)]
    assert chat_format.format_chats(df.limit(0), chat_format.text_parts(F.col("text"))).collect() == []


def test_pages(spark):
    boxes = "<header><p>Site name here.</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav><aside class=sidebar><p>Read more stories.</p></aside><div class='cookie notice'><p>We use cookies, you know.</p></div><form><label>Mail</label></form>"
    body = f"<html><head><title>T</title></head><body>{boxes}<article><h1>The title of it</h1><p>First &amp; long   part,\n of the text.<p>Second <b>part</b>, with words in it.<div class=ad>Buy now!</div><p>Third part of this text.</article><section class=comments><div class=comment><p>Nice text, thanks for it.</p></div></section><footer>&copy; us</footer>"
    df = spark.createDataFrame([(1, "u", body, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p" * 3000, "t"), (None, "u", "<script>var a='<p>x</p>'", "t")], "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in html_extract.digest(df).collect()}
    assert out[1] == "The title of it\n\nFirst & long part, of the text.\n\nSecond part, with words in it.\n\nThird part of this text."
    assert out[2] == out[3] == out[None] == "" and len(out) == 5
    assert html_extract.digest(df.limit(0)).collect() == []


def test_stages(spark, docs, tmp_path):
    benchmark = tmp_path / "benchmark.parquet"
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(benchmark))
    for source in (docs, docs.limit(0)):
        at = source
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / f"{name}-{source is docs}"))
            at = spark.read.parquet(str(tmp_path / f"{name}-{source is docs}"))


def test_pipeline_brute(spark):
    """The stages in plain Python, over the small table, from the operators' contracts."""
    import re
    from collections import defaultdict

    from tests.llm.test_brute import classes, simhash as fingerprint

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts = {k: t for k, t in texts.items() if any(c.isalpha() for c in t)}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(k)
    gone = {x: max(h) for x, h in holders.items() if len(x) >= 20 and len(h) >= 3}
    texts = {k: "\n".join(x for x in t.split("\n") if gone.get(key(x), k) <= k) for k, t in texts.items()}
    member = classes({k: fingerprint(t) for k, t in texts.items()})
    texts = {k: t for k, t in texts.items() if member[k] == k}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall(low(r.text))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    kept = {}
    for k, t in texts.items():
        w = word.findall(low(t))
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            kept[k] = t
    # The same with rows that repeat an id: copies of a row, and a copy of another document under an id that heads a component itself.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = docs.where("doc_id < 20").union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(1000).cast("long")))
    for table in (docs, docs.union(again)):
        at = table
        for name, stage in corpus_pipeline.STAGES[2:3]:
            ids = [r.doc_id for r in stage(spark, at, sf).select("doc_id").collect()]
            heads = classes({r.doc_id: fingerprint(r.text) for r in docs.collect()})
            assert sorted(ids) == sorted(k for k, v in heads.items() if k == v)
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.n_tokens
    assert dict(got) == {k: len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", t)) for k, t in kept.items()}
