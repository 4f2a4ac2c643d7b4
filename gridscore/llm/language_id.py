"""Language identification by cross-parsing entropy.

A suffix automaton is built over labelled text of each language. A text is cut greedily into the longest phrases that occur in
a language's text; phrases, times the logarithm of the amount of that text, over the length of the parsed text, estimate the
cross entropy. The language with the least wins.

Fitting takes a bounded sample: `rows_per_language` labelled rows for each language, in hash order (more of them where they
are short), and of these at most `symbols` letters and runs of others; symbols are their bytes. Parsing takes whole texts: it walks all automata over blocks of 256 symbols in
lockstep, as table lookups; a phrase ends at a block's end, which adds at most one phrase to 256 symbols.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.common import held_out

BLOCK = 256
LETTER = r"\p{L}"
PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.ArrayType(T.DoubleType()))])


class SuffixAutomaton:
    """Transitions and suffix links over a sequence of symbols; every path from state 0 is a substring."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            state = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] != self.length[p] + 1:
                    copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[state] = q
            last = state

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def moves(self, width: int) -> np.ndarray:
        """State times symbol: twice the next row's offset, plus 1 where a phrase ends and the next begins with the symbol.

        One more state stands behind a symbol that occurs nowhere, which is a phrase of its own. The last symbol of the width is
        padding, which returns to the start and ends nothing; the one before is unknown to all.
        """
        nowhere = len(self.next)
        first = np.full(width, nowhere * width * 2, np.int64)
        for c, q in self.next[0].items():
            first[c] = q * width * 2
        out = np.tile((first + 1).astype(np.int32), (nowhere + 1, 1))
        out[0] = first  # a block's first symbol begins its first phrase
        for s, row in enumerate(self.next):
            for c, q in row.items():
                out[s, c] = q * width * 2
        out[:, -1] = 0
        return out.ravel()


class Languages:
    """What is broadcast: a table of moves for each language, over the bytes that its letters hold; bounded by `symbols`.

    Symbols are the UTF-8 bytes of lower-cased letters, and 0 for a run of what isn't a letter. No letter of any script is left out.
    """

    def __init__(self, texts: dict[str, list[str]], symbols: int):
        self._table = None
        self.names, self.moves, self.local, self.log_n = [], [], [], []
        for name in sorted(texts):
            codes = self._sample(texts[name], symbols)
            if len(codes) > 1:
                own = np.unique(codes)
                local = np.full(256, len(own), np.uint16)  # the bytes of other letters are unknown to the language
                local[own] = np.arange(len(own))
                self.names.append(name)
                self.moves.append(SuffixAutomaton(local[codes].tolist()).moves(len(own) + 2))
                self.local.append(local)
                self.log_n.append(np.log2(len(codes) + 1))

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def _sample(self, texts: list[str], symbols: int) -> np.ndarray:
        """Codes of the first `symbols` letters and runs of others, and of the end."""
        raw, _, _ = self._letters(texts)
        return self._bytes(np.concatenate([raw, [0]]).astype(np.uint32)[:symbols])[0]

    def _letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts' letters, with 0 for a run of others, the texts' ends among them, and which texts have letters."""
        if self._table is None:
            self._table = np.array([chr(c).isalpha() for c in range(0x110000)])
        low = [t.lower() for t in texts]
        ends = np.cumsum([len(t) for t in low])
        raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self._table[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = True
        edge[0] = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep |= edge[:-1]
        before = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(letter)])[np.concatenate([[0], ends]).astype(np.int64)]
        return np.where(letter, raw, 0)[keep].astype(np.uint32), before[ends.astype(np.int64)], np.diff(letters) > 0

    def _bytes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of code points, and how many of them come before each."""
        size = 1 + (raw >= 0x80).astype(np.int64) + (raw >= 0x800) + (raw >= 0x10000)
        return np.frombuffer(raw.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), np.concatenate([[0], np.cumsum(size)])

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, the texts' ends among them, and which texts have letters."""
        raw, ends, letters = self._letters(texts)
        codes, before = self._bytes(raw)
        return codes, before[ends], letters

    def phrases(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases by text and language."""
        sizes = np.diff(np.concatenate([[0], ends]))
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(ends - sizes, blocks) + nth * BLOCK
        size = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
        out = np.zeros((len(sizes), len(self.names)))
        order = np.argsort(-size, kind="stable")  # full blocks first: at step k only the first `live` have a symbol left
        start, size, doc = start[order], size[order], doc[order]
        live = np.searchsorted(-size, -np.arange(BLOCK), side="left")
        lanes = [codes[start[:n] + k] for k, n in enumerate(live) if n]
        for j, (table, local) in enumerate(zip(self.moves, self.local)):
            at = np.zeros(len(doc), np.int32)
            count = np.ones(len(doc), np.int32)
            for c in lanes:
                n = len(c)
                move = table[at[:n] + local[c]]
                count[:n] += move & 1
                at[:n] = move >> 1
            out[:, j] = np.bincount(doc, count, len(sizes))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        codes, ends, letters = self.code(texts)
        sizes = np.maximum(1, np.diff(np.concatenate([[0], ends])))
        if not self.names:
            return [None if ok else "und" for ok in letters.tolist()], np.zeros(len(texts)), np.zeros((len(texts), 0))
        bits = self.phrases(codes, ends) * np.array(self.log_n) / sizes[:, None]
        best = bits.argmin(1)  # ties: the first name
        share = np.exp2(-2 * (bits - bits.min(1, keepdims=True)))
        score = np.where(letters, 1 / share.sum(1), 0.0)
        return [self.names[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())], score, bits


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 64, symbols: int = 30_000) -> Languages:
    """Learn from rows that aren't held out and have a language and a text with letters, of any length.

    A longer text gives a span of 4,000 code points, chosen by its id's hash. Texts of 100 code points and more are drawn
    first, the shorter ones after them; where a language's draw has shorter ones and too few symbols, more of these are
    drawn, up to `symbols` rows. So what comes to the driver is bounded for each language.
    """
    text, h = F.col(text_col), F.xxhash64(F.col(id_col).cast("string"))
    span = F.substring(text, (F.pmod(h, F.char_length(text) - 3999) + 1).cast("int"), F.lit(4000))
    lettered = F.when(span.rlike(LETTER), span).otherwise(F.substring(text, F.regexp_instr(text, F.lit(LETTER)), F.lit(4000)))
    labelled = docs.where(F.col(lang_col).isNotNull() & text.rlike(LETTER) & ~held_out(F.col(id_col))).select(
        F.col(lang_col).alias("lang"), F.when(F.char_length(text) > 4000, lettered).otherwise(text).alias("text"), h.alias("h"), (F.char_length(text) < 100).alias("short")
    )

    def draw(rows: DataFrame, limit: int) -> list:
        ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("short", "h", "text")))
        return sorted(ranked.where(F.col("n") <= limit).collect(), key=lambda r: (r.lang, r.n))

    texts: dict[str, list[str]] = {}
    drawn = draw(labelled, rows_per_language)
    for r in drawn:
        texts.setdefault(r.lang, []).append(r.text)
    few = sorted({r.lang for r in drawn if r.short and r.n == rows_per_language and sum(map(len, texts[r.lang])) < symbols})
    if few:
        first = {lang: sum(r.lang == lang and not r.short for r in drawn) for lang in few}
        more: dict[str, list[str]] = {}
        for r in draw(labelled.where(F.col("lang").isin(few) & F.col("short")), symbols):
            more.setdefault(r.lang, []).append(r.text)
        for lang in few:
            texts[lang][first[lang] :] = more[lang]
    return Languages(texts, symbols)


def predictor(session, languages: Languages, at_once: int = 3_000_000):
    """text column -> struct<lang, score, bits>; `und` with score 0 if the text is null or has no letters; a null language
    with score 0 if it has letters but no language could be learned."""
    held = session.sparkContext.broadcast(languages)

    @F.arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, bits, part, size = [], [], [], [], 0

        def flush():
            if part:
                a, b, c = held.value.predict(part)
                names.extend(a)
                scores.append(b)
                bits.extend(c.tolist())
                part.clear()

        for t in texts.to_pylist():
            if size + len(t or "") > at_once:
                flush()
                size = 0
            part.append(t or "")
            size += len(t or "")
        flush()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(bits, pa.list_(pa.float64()))], ["lang", "score", "bits"])

    return predict


def identify(docs: DataFrame, languages: Languages, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct `out` (lang, score from 0 to 1, bits by language); every row and column stays, but for one that is named as `out`.

    Null texts and texts without letters are `und`; texts of any length are read whole; ties go to the first name; equal texts
    get equal answers; an empty table gives an empty table.
    """
    return docs.drop(out).withColumn(out, predictor(docs.sparkSession, languages)(F.col(text_col)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, a row per row of docs; rows as in identify."""
    found = identify(docs.select("doc_id", "text"), fit(docs), out="p")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
