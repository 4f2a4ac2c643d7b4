"""Text and number normalisation as column functions; all stay inside the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing means it: Java's class lacks U+001C to U+001F.
WS = r"(?U)[\s\x1c-\x1f]+"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: A text without any of these is ASCII in single spaced words, so that normalising leaves it as it is.
UNTIDY = r"^ | $|  |[^ -~]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
#: Decimal digits of all scripts and what they stand for, from the Unicode tables.
_ND = list(filter(str.isdecimal, map(chr, range(128, sys.maxunicode + 1))))
DIGITS, ASCII_DIGITS = "".join(_ND), "".join(str(unicodedata.decimal(c)) for c in _ND)

#: What lower case has otherwise than case folding: final sigma, the kept dotless i, and Cherokee, which folds to capitals.
_SMALL = "\u03c2\ue000" + "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_FOLDED = "\u03c3\u0131" + "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))

# They must equal the evaluated format's.
NOTE_ROW = (
    r"(?iU)^(?:(?:table|figure)\s*\d+[\.:]?\s+|표\s*\d+[\.:]?\s+|caption\s*:|source\s*:|from\s+|note[s]?\s*:|\*+\s*(?:p|P)\s*[<≤=]|"
    r"(?:[a-z]|\*)\s+(?:derived|from|p\s*[<≤=])|derived\s+from|NA,\s+|N\.?A\.?,\s+|(?:mating|matting|fertility|gestation|birth)\s+index\s*=|one\s+female\s+|excludes\s+)"
)
NUMBER = r"^([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))(?:%|[A-Za-z/%°μ]+)?$"
#: What dangles at the end of a cell, and the wrappings that are taken off formulas.
DANGLING = (r"</\s*$", r"<\s*$", r"</\s*[A-Za-z][^>]*$")
PLUS_MINUS = r"\(\pm\)"
LATEX = (r"\\\((.*?)\\\)", r"_\{([^{}]+)\}", r"\^\{([^{}]+)\}")
#: Significant digits of a number; more are rounded, half to even.
PRECISION = 28


def let(c: Column, f) -> Column:
    """f of c, with c evaluated once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK, -1)


def normalize_text(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return let(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike(UNTIDY), F.trim(F.regexp_replace(t, WS, " "))).otherwise(t))


def clean_cell_text(c: Column) -> Column:
    """normalize_text without a dangling tag at the end."""
    def cut(t):
        for rule in DANGLING:
            t = F.regexp_replace(t, rule, "")
        return F.trim(F.regexp_replace(t, WS, " "))

    return let(normalize_text(c), lambda t: F.when(F.contains(t, F.lit("<")), cut(t)).otherwise(t))


def casefold(c: Column) -> Column:
    """Full case folding: upper case spelled out, then lower case without a final sigma; dotless i and Cherokee stay as folding has them."""
    def fold(t):
        kept = F.translate(t, "\u0131\u1e9e", "\ue000\u00df")
        return F.when(is_ascii(t), F.lower(t)).otherwise(F.translate(F.lower(F.translate(F.upper(kept), "\u03c2", "\u03c3")), _SMALL, _FOLDED))

    return let(c, fold)


def normalize_cell_text(c: Column) -> Column:
    return casefold(normalize_text(c))


def clean_latex_text(c: Column) -> Column:
    def unwrapped(t):
        t = F.replace(t, F.lit(PLUS_MINUS), F.lit("±"))
        for rule in LATEX:
            t = F.regexp_replace(t, rule, "$1")
        return F.replace(t, F.lit("\\"), F.lit(""))

    return clean_cell_text(let(c, lambda t: F.when(t.rlike(r"[\\{]"), unwrapped(t)).otherwise(t)))


def ascii_digits(c: Column) -> Column:
    return let(c, lambda t: F.when(is_ascii(t), t).otherwise(F.translate(t, DIGITS, ASCII_DIGITS)))


def decimal_text(sign: Column, digits: Column, exponent: Column) -> Column:
    """The shortest text of sign, digits (no zeros at either end) and exponent: plain from 10^-6 on where no zeros follow the digits, else scientific."""
    n = F.length(digits)
    point = n + exponent
    plain = F.when(exponent == 0, digits).when(point > 0, F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, n))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    power = F.concat(F.when(point > 0, "+").otherwise(""), (point - 1).cast("string"))
    scientific = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("E"), power)
    return F.concat(sign, F.when(digits == "", "0").when((exponent <= 0) & (point > -6), plain).otherwise(scientific))


def normalize_number(c: Column) -> Column:
    """The decimal text that equal numbers share; null without a digit; other texts with digits stay, without commas and white space."""
    def rounded(digits):
        """(digits without zeros at the end, places cut at the end)."""
        rest = F.substring(digits, F.lit(PRECISION + 1), F.greatest(F.length(digits), F.lit(1)))
        head = F.left(digits, F.lit(PRECISION))
        up = rest.rlike("^[6-9]|^5.*[1-9]") | rest.rlike("^50*$") & head.rlike("[13579]$")
        long = (head.cast("decimal(38,0)") + F.when(up, 1).otherwise(0)).cast("string")
        kept = F.when(F.length(digits) > PRECISION, F.struct(long.alias("d"), (F.length(digits) - PRECISION).alias("e"))).otherwise(F.struct(digits.alias("d"), F.lit(0).alias("e")))
        return let(kept, lambda k: F.struct(F.rtrim(k["d"], F.lit("0")).alias("d"), (k["e"] + F.length(k["d"]) - F.length(F.rtrim(k["d"], F.lit("0")))).alias("e")))

    def key(number):
        whole, part = F.regexp_extract(number, r"^[+-]?([0-9]*)", 1), F.regexp_extract(number, r"\.([0-9]*)$", 1)
        sign = F.when(number.startswith("-"), "-").otherwise("")
        digits = let(F.ltrim(F.concat(whole, part), F.lit("0")), rounded)
        return let(digits, lambda d: decimal_text(sign, d["d"], d["e"] - F.length(part)))

    def of(t):
        t = F.replace(t, F.lit(","), F.lit(""))
        return let(F.regexp_replace(F.translate(t, "−–—", "---"), WS, ""), lambda x: let(F.regexp_extract(ascii_digits(x), NUMBER, 1), lambda n: F.when(n == "", x).otherwise(key(n))))

    return let(normalize_text(c), lambda t: F.when(t.rlike(r"(?U)\d"), of(t)))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def file_stem(path: Column) -> Column:
    """Name without folder and last suffix; a leading dot is part of the stem."""
    return F.regexp_extract(path, r"([^/]+?)(?:(?<=[^/])\.[^./]*)?$", 1)


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def parse_flag(c: Column) -> Column:
    """Exactly True, true or 1; null is false."""
    return F.coalesce(c.cast("string").isin("True", "true", "1"), F.lit(False))


def parse_number(c: Column) -> Column:
    return strip(c).try_cast("double")


def fixed4(c: Column) -> Column:
    """Four decimals; null is empty."""
    return F.coalesce(F.format_string("%.4f", c.cast("double")), F.lit(""))


def cell_edit_distance(a: Column, b: Column) -> Column:
    """Edits over the longer length, at least 1."""
    return F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
