"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (text between block-level tags). A block's features are its ancestors' tags, the words of
their class, id and role, and traits of its text. The field's weights are trained on labelled pages by stochastic gradient
steps on the exact log-likelihood (forward and backward sums); pages are decoded by Viterbi. `labelled_pages` draws
the default training pages from page layouts; any other list of (html, labels) may be given instead.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is not text of a page: code, styles, inert markup, other documents, drawings, form fields, and repeated formulas.
RAW = {"script", "style", "template", "iframe", "svg", "textarea", "select", "annotation", "annotation-xml"}
#: A slash at the end of their tag closes them, and without an end tag nothing is skipped. Other raw text runs on to its end tag.
SLASHED = {"svg"}
#: What may stand in a head. Any other tag closes it.
HEAD = {"html", "head", "title", "meta", "link", "base", "basefont", "bgsound", "style", "script", "noscript", "template", "noframes"}
VOID = {"br", "img", "input", "meta", "link", "hr", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "small", "big", "sub", "sup", "code", "kbd", "samp", "var", "mark", "abbr", "cite", "q", "dfn", "del", "ins", "font", "tt", "time", "bdi", "bdo", "label", "img", "wbr", "br", "ruby", "rt", "rp", "data", "strike", "acronym"}
#: Formulas belong to the text that they stand in; their annotations repeat them.
INLINE |= {"math", "mi", "mo", "mn", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "mover", "munder", "munderover", "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "menclose", "merror", "semantics", "annotation", "annotation-xml"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end tag doesn't reach beyond.
FENCE = {"div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "table", "ul", "ol", "dl", "blockquote", "body", "html", "figure", "details", "fieldset"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
WORD = re.compile(r"[a-z]+")


def _names(attributes: str) -> frozenset[str]:
    found = set()
    for m in ATTR.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1] == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                found.add("hidden")
        elif m[1] == "hidden" or m[1] == "aria-hidden" and value == "true":
            found.add("hidden")
        else:
            for name in WORD.findall(value):
                found.add(name)
                if len(name) > 5:  # compounds share how they begin or end
                    found |= {f"{name[:6]}-", f"-{name[-3:]}"}
    return frozenset(found)


class Parser:
    """Cuts pages into blocks (text, ancestor features, share of text in links). Ancestor features are kept from page to page."""

    def __init__(self) -> None:
        self.known: dict = {}

    def _child(self, above: frozenset[str], tag: str, attributes: str) -> frozenset[str]:
        key = (above, tag, attributes)
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = above | {f"in:{tag}"} | {f"name:{n}" for n in _names(attributes)}
        return self.known[key]

    def blocks(self, page: str) -> list[tuple[str, frozenset[str], float]]:
        out, parts, linked = [], [], 0
        root: frozenset[str] = frozenset()
        stack: list[tuple[str, frozenset[str]]] = []
        links = 0
        open_tags: dict[str, int] = {}  # how many of each are on the stack: what isn't there isn't looked for
        unended: set[str] = set()  # raw elements that no end tag follows any more

        def flush():
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((text, stack[-1][1] if stack else root, min(1.0, linked / len(text))))
                parts, linked = [], 0

        def text(s: str):
            nonlocal linked
            if s:
                if stack and stack[-1][0] == "head" and s.strip():
                    leave_head()
                s = entities.unescape(s) if "&" in s else s
                parts.append(s)
                if links:
                    linked += len(s.strip())

        def pop_to(k: int):
            nonlocal links
            for t, _ in stack[k:]:
                links -= t == "a"
                open_tags[t] -= 1
            del stack[k:]

        def leave_head():
            for k, (t, _) in enumerate(stack[:3]):
                if t == "head":
                    flush()
                    pop_to(k)
                    break

        at = 0
        while m := TAG.search(page, at):
            text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
            block = tag not in INLINE
            if block:
                flush()
            elif tag == "br":
                parts.append(" ")
            if closing:
                for k in range(len(stack) - 1, -1, -1) if open_tags.get(tag) else ():
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if not block and stack[k][0] not in INLINE:
                        break
                continue
            if tag not in HEAD and tag not in RAW:
                leave_head()
            if tag in SLASHED and attributes.rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = None if tag in unended else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end is None:
                    unended.add(tag)
                at = end.end() if end else at if tag in SLASHED else len(page)
                continue
            if tag in VOID or attributes.endswith("/"):
                continue
            if block:
                ends = CLOSES.get(tag, {"p"})
                for k in range(len(stack) - 1, -1, -1) if open_tags.get("p") or any(open_tags.get(x) for x in ends) else ():
                    if stack[k][0] in ends or stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in FENCE and not (tag in CLOSES and stack[k][0] not in ("ul", "ol", "dl", "table")):
                        break
            stack.append((tag, self._child(stack[-1][1] if stack else root, tag, attributes)))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            links += tag == "a"
        text(page[at:])
        flush()
        return out


def text_features(text: str, linked: float) -> list[str]:
    n = len(text)
    return [
        f"len:{0 if n < 20 else 1 if n < 60 else 2 if n < 160 else 3 if n < 500 else 4}",
        f"link:{0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.7 else 3}",
        "ends" if text[-1] in ".!?:;\"'”»)" else "open",
        "comma" if "," in text else "plain",
        "mark" if text[0] in "©|»›•<&" or "©" in text else "none",
    ]


class Field:
    """Two states, 1 for main text. Unary weights by feature, and weights of state pairs, first and last states."""

    def __init__(self, pages: list[tuple[str, list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 3):
        self.weights: dict[str, np.ndarray] = {}
        self.pair, self.first = np.zeros((2, 2)), np.zeros(2)
        parser, rows = Parser(), []
        for page, labels in pages:
            blocks = parser.blocks(page)
            if len(blocks) != len(labels):
                raise ValueError("a labelled page needs one label for each block")
            if blocks:
                rows.append(([[*f, *text_features(t, s), "bias"] for t, f, s in blocks], np.array(labels)))
        squares: dict[str, np.ndarray] = {}
        square_pair, square_first = np.full((2, 2), 1e-6), np.full(2, 1e-6)
        order = list(range(len(rows)))
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, labels = rows[k]
                unary = self._unary(features)
                node, edge = self._marginals(unary)
                want = np.eye(2)[labels]
                slope = want - node
                pairs = np.zeros((2, 2))
                np.add.at(pairs, (labels[:-1], labels[1:]), 1)
                g = pairs - edge
                square_pair += g * g
                self.pair += rate * g / np.sqrt(square_pair)
                g = want[0] - node[0]
                square_first += g * g
                self.first += rate * g / np.sqrt(square_first)
                total: dict[str, np.ndarray] = {}
                for fs, s in zip(features, slope):
                    for f in fs:
                        total[f] = total.get(f, 0) + s
                for f, g in total.items():
                    w = self.weights.setdefault(f, np.zeros(2))
                    g = g - decay * w
                    q = squares.setdefault(f, np.full(2, 1e-6))
                    q += g * g
                    w += rate * g / np.sqrt(q)
        self.margin = {f: float(w[1] - w[0]) for f, w in self.weights.items()}
        self.known: dict = {}

    def _unary(self, features: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in features])

    def _marginals(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the states, and summed over the state pairs."""
        n = len(unary)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = unary[0] + self.first
        for i in range(1, n):
            a[i] = unary[i] + np.logaddexp(a[i - 1][0] + self.pair[0], a[i - 1][1] + self.pair[1])
        for i in range(n - 2, -1, -1):
            r = unary[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.pair[:, 0] + r[0], self.pair[:, 1] + r[1])
        z = np.logaddexp(*a[-1])
        edge = np.zeros((2, 2))
        for i in range(n - 1):
            edge += np.exp(a[i][:, None] + self.pair + unary[i + 1] + b[i + 1] - z)
        return np.exp(a + b - z), edge

    def decode(self, blocks: list[tuple[str, frozenset[str], float]]) -> list[int]:
        """Viterbi over margins (state 1 less state 0)."""
        if not blocks:
            return []
        get, known = self.margin.get, self.known
        (p00, p01), (p10, p11) = self.pair.tolist()
        s0, s1, back, bias = 0.0, 0.0, [], get("bias", 0.0)
        for i, (text, above, linked) in enumerate(blocks):
            m = known.get(above)
            if m is None:
                if len(known) > 20_000:
                    known.clear()
                m = known[above] = sum(get(f, 0.0) for f in above) + bias
            for f in text_features(text, linked):
                m += get(f, 0.0)
            if not i:
                s0, s1 = float(self.first[0]), float(self.first[1]) + m
                continue
            b0, b1 = s1 + p10 > s0 + p00, s1 + p11 > s0 + p01
            s0, s1 = (s1 + p10 if b0 else s0 + p00), (s1 + p11 if b1 else s0 + p01) + m
            back.append((b0, b1))
        state = int(s1 > s0)
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


def labelled_pages(n: int = 450, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages drawn from layouts, with a label for each block."""
    rng = random.Random(seed)
    parser = Parser()

    def words(lo: int, hi: int) -> str:
        w = ["".join(rng.choice("aeioutnrsldé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi))]
        return " ".join(x + "," if rng.random() < 0.08 else x for x in w).capitalize()

    sentence = lambda lo=4, hi=60: words(lo, hi) + rng.choice([".", ".", ".", "!", "?"])

    def prose(lo: int, hi: int) -> str:
        """Main text may be odd: lists, symbols, capitals, no full stop."""
        s, r = sentence(lo, hi), rng.random()
        if r < 0.1:
            return s.replace(" ", rng.choice([" | ", "*** ", "!! ", "; "])) + rng.choice(["", " |", "***"])
        return s[:-1] if r < 0.2 else s.upper() if r < 0.25 else "&copy; " + s if r < 0.27 else s

    pages = []
    for _ in range(n):
        parts: list[tuple[str, int]] = []  # markup with {} for a text, and labels of its texts
        put = lambda markup, *labels: parts.append((markup, labels))

        def links(k: int, tag: str = "li") -> str:
            return "".join(f'<{tag}><a href="/x">{words(1, 3)}</a></{tag}>' for _ in range(k))

        def clutter(where: str) -> None:
            kind = rng.choice(["ad", "aside", "share", "notice", "form", "related", "crumbs", "sidebar", "menu", "bar", "cell"])
            k = rng.randint(1, 5)
            box = lambda names, body: f'<{rng.choice(["div", "section", "div"])} {rng.choice(["class", "class", "id"])}="{rng.choice(names)}">{body}</div>'
            if kind == "ad":
                put(box(["ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad banner", "ad unit"], f"<p>{sentence(2, 25)}</p>" if rng.random() < 0.4 else sentence(2, 25)), 0)
            elif kind == "notice":
                put(box(["cookie", "cookie notice", "notice", "consent", "alert", "gdpr banner", "disclaimer", "popup", "subscribe modal"], f"<p>{sentence(4, 30)}</p><button>{words(1, 2)}</button>"), 0, 0)
            elif kind == "share":
                put(box(["share", "social", "share buttons", "tags", "meta", "byline", "toolbar"], f"<ul>{links(k)}</ul>"), *[0] * k)
            elif kind == "form":
                put(f'<form class="{rng.choice(["search", "newsletter", "login", "signup", ""])}"><label>{words(1, 4)}</label><input name="q"><p>{sentence(3, 20)}</p><button>{words(1, 2)}</button></form>', 0, 0, 0)
            elif kind == "crumbs":
                put(f'<div class="{rng.choice(["breadcrumb", "breadcrumbs", "pagination", "pager"])}"><a href="/">{words(1, 2)}</a> &gt; <a href="/y">{words(1, 2)}</a></div>', 0)
            elif kind == "bar":  # links side by side, under any name or none
                put(f'<div class="{rng.choice(["topbar", "navbar", "linkbar", "toplinks", "quicklinks", words(1, 1)])}">' + rng.choice([" ", " | ", " &middot; "]).join(f'<a href="/x">{words(1, 3)}</a>' for _ in range(k + 1)) + "</div>", 0)
            elif kind == "cell":
                put(f'<table><tr><td class="{rng.choice(["menu", "nav", "left", "sidemenu", words(1, 1)])}">' + rng.choice([" ", "<br>"]).join(f'<a href="/x">{words(1, 3)}</a>' for _ in range(k + 1)) + "</td></tr></table>", 0)
            elif kind == "menu":
                put(f'<div class="{rng.choice(["menu", "nav", "navbar", "navigation"])}"><ul>{links(k)}</ul></div>', *[0] * k)
            else:
                names = {"aside": ["aside"], "related": ["related", "recommended", "more", "popular"], "sidebar": ["sidebar", "widget", "side rail"]}[kind]
                tag = "aside" if kind == "aside" else rng.choice(["div", "aside"])
                put(f'<{tag} class="{rng.choice(names)}"><h3>{words(1, 4)}</h3><p>{sentence(4, 40)}</p><ul>{links(k)}</ul></{tag}>', 0, 0, *[0] * k)

        k = rng.randint(2, 8)
        if rng.random() < 0.5:
            put(f'<header class="{rng.choice(["site", "top", "header", ""])}"><div class="logo">{words(1, 3)}</div><p>{sentence(3, 12)}</p></header>', 0, 0)
        if rng.random() < 0.8:
            put(f"<nav><ul>{links(k)}</ul></nav>", *[0] * k)
        for _ in range(rng.randint(0, 3)):
            clutter("before")
        tag, names = rng.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post"), ("section", "entry content"), ("div", "main"), ("div", "story text"), ("div", words(1, 1)), ("div", f"{words(1, 1)} {words(1, 1)}")])
        put(f'<{tag} class="{names}">' if names else f"<{tag}>")
        if rng.random() < 0.9:
            put(f"<h1>{prose(1, 12)}</h1>", 1)
        for i in range(rng.randint(1, 12)):
            if rng.random() < 0.12:
                clutter("inside")
            r = rng.random()
            if r < 0.66:
                put(f"<p>{prose(1, 120)}</p>", 1)
            elif r < 0.72:
                put(f"<p><b>{prose(1, 40)}<br>", 1)
            elif r < 0.78:
                put(f"<h2>{words(1, 8)}</h2>", 1)
            elif r < 0.83:
                put(f"<ul><li>{prose(1, 20)}</li><li>{prose(1, 20)}</li></ul>", 1, 1)
            elif r < 0.86:
                put(f"<blockquote><p>{sentence(3, 40)}</p></blockquote>", 1)
            elif r < 0.89:
                put(f'<p>{sentence(3, 30)} <a href="/z">{words(1, 4)}</a> {sentence(3, 30)}</p>', 1)
            elif r < 0.91:
                put(f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", 1, 1)
            else:
                clutter("inside")
        put(f"</{tag}>")
        for _ in range(rng.randint(0, 3)):
            clutter("after")
        if rng.random() < 0.5:
            c, outer = rng.randint(1, 4), rng.choice(["section", "div", "div", "ol", "ul"])
            item = "li" if outer in ("ol", "ul") else rng.choice(["div", "div", "article"])
            names = ["comments", "comments", "comment list", "commentlist", "comment-thread", "readercomments", "discussion", "replies", "responses"]
            own = rng.choice(["comment", "comment", "comment body", "commentitem", "reply", ""])
            body = "".join(f'<{item} class="{own}"><p>{sentence(2, 50)}</p></{item}>' if rng.random() < 0.8 else f'<{item} class="{own}">{sentence(2, 50)}</{item}>' for _ in range(c))
            head = f"<h3>{words(1, 3)}</h3>" if item != "li" else ""
            put(f'<{outer} {rng.choice(["class", "id"])}="{rng.choice(names)}">{head}{body}</{outer}>', *[0] * (c + bool(head)))
        if rng.random() < 0.85:
            put(f"<footer>&copy; {words(1, 3)} &middot; {sentence(2, 15)}</footer>", 0)
        page = "<html><head><meta charset=\"utf-8\"></head><body>" + "".join(m for m, _ in parts) + "</body></html>"
        labels = [x for _, ls in parts for x in ls]
        if len(parser.blocks(page)) == len(labels):
            pages.append((page, labels))
    return pages


def extractor(session, field: Field):
    """html column -> main text."""
    held = session.sparkContext.broadcast(field)

    @F.arrow_udf(T.StringType())
    def extract(pages: pa.Array) -> pa.Array:
        model, parser, out = held.value, Parser(), []
        for p in pages:
            blocks = parser.blocks(p.as_py() or "")
            out.append("\n\n".join(t for (t, above, _), s in zip(blocks, model.decode(blocks)) if s and "in:head" not in above))
        return pa.array(out, pa.string())

    return extract


@cache
def _fitted() -> Field:
    return Field(labelled_pages())


def fit(pages: list[tuple[str, list[int]]] | None = None) -> Field:
    """A field of labelled pages; that of the drawn ones is fitted once for a driver."""
    return _fitted() if pages is None else Field(pages)


def extract_text(pages: DataFrame, field: Field, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with `out`: the main blocks in page order, joined by an empty line; null or empty html, or none found: empty.

    Every row and column stays, but for one that is named as `out`. Pages of any length are read whole; equal pages get equal texts; an
    empty table gives an empty table.
    """
    return pages.drop(out).withColumn(out, extractor(pages.sparkSession, field)(F.col(html_col)))


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, a row per row of pages; rows as in extract_text."""
    found = extract_text(pages.select("page_id", "url", "html"), fit())
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
