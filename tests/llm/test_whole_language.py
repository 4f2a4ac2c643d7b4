"""Languages are learned from texts of any length and any script."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gridscore.llm import language_id

LETTERS = {"aa": "abcdefghij", "bb": "fghijklmno", "cc": "klmnopqrst"}


def prose(rng, lang, n):
    own = random.Random(lang)
    vocab = ["".join(own.choice(LETTERS[lang]) for _ in range(own.randint(2, 7))) for _ in range(150)]
    return " ".join(rng.choice(vocab) for _ in range(n))


def right(rows, lang):
    own = [r for r in rows if r.held_out and r.lang == lang]
    assert len(own) > 10
    return sum(r.lang_pred == lang for r in own) / len(own)


def test_texts_of_any_length_are_learned(spark):
    rng = random.Random(2)
    rows = [(k, lang, prose(rng, lang, n)) for k, (lang, n) in enumerate([("aa", 200), ("bb", 8), ("cc", 2000)] * 120)]
    rows.append((9_999_998, "dd", "1 2 3 " * 3000 + "wxyzwxyz"))  # letters outside the span
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = language_id.fit(docs)
    assert learned.names[:3] == ["aa", "bb", "cc"] and ("dd" in learned.names) == (not docs.where(F.col("doc_id") == 9_999_998).select(language_id.held_out(F.col("doc_id"))).first()[0])
    out = language_id.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert [right(out, lang) for lang in LETTERS] == [1, 1, 1]


def test_nothing_to_learn_drops_nothing_with_letters(spark):
    rows = [(1, None, "some text"), (2, None, "12 34"), (3, None, None), (4, None, "été")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, "").collect()) == [1, 4]
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.digest(docs).collect()} == {1: (None, 0), 2: ("und", 0), 3: ("und", 0), 4: (None, 0)}


def test_languages_beyond_250_letters(spark):
    """Three languages that share their letters but not words, and one with 300 lower letters."""
    rng = random.Random(6)
    letters = [chr(0x5E00 + k) for k in range(600)]
    docs, vocab = [], {name: ["".join(random.Random(f"{name}{k}").choices(letters, k=3)) for k in range(400)] for name in ("p", "q", "r")}
    vocab["s"] = ["".join(random.Random(f"s{k}").choices([chr(0x4E00 + j) for j in range(300)], k=6)) for k in range(400)]
    for k in range(480):
        name = "pqrs"[k % 4]
        docs.append((k, name, " ".join(rng.choices(vocab[name], k=60))))
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    out = language_id.digest(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert [right(out, name) for name in "pqrs"] == [1, 1, 1, 1]


def test_phrases_are_longest_matches():
    """Against plain parsing: the longest match in the learned text, or one unknown symbol; a phrase ends at a block's end."""
    rng = random.Random(9)
    own = {"p": [" ".join(rng.choices(["ab", "abc", "bca", "\u00e9a", "cab"], k=60))], "q": [" ".join(rng.choices(["xa", "xyb", "\u4e2d", "yx"], k=40))]}
    learned = language_id.Languages(own, 200)
    sample = [learned._sample(own[name], 200).tobytes() for name in learned.names]
    texts = ["", "a", "zzz", "ab zz abc", "\u4e2d\u4e2d \u4e2e"] + [" ".join(rng.choices(["ab", "bc", "z", "x", "\u00e9", "\u4e2d", "abcab", "12"], k=n)) for n in (5, 40, 90, 300, 1000)]
    codes, ends, _ = learned.code(texts)
    got = learned.phrases(codes, ends)
    start = 0
    for k, end in enumerate(ends.tolist()):
        for j, body in enumerate(sample):
            n = 0
            for at in range(start, end, language_id.BLOCK):
                block = codes[at : min(end, at + language_id.BLOCK)].tobytes()
                while block:
                    size = max((m for m in range(1, len(block) + 1) if block[:m] in body), default=1)
                    block, n = block[size:], n + 1
            assert got[k, j] == n, (texts[k], learned.names[j])
        start = end
