"""Text rules: trimming, normalising and splitting labels, and escaping for RDF text."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the source system's runtime defines it, which is neither the blank
# that Spark trims by default nor the set that Java's regular expressions use.
SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Characters escaped in RDF text and what they become; the backslash comes first.
ESCAPES = (
    ("\\", "\\\\"),
    ("\n", "\\n"),
    ("\t", "\\t"),
    ("\r", "\\r"),
    ("\f", "\\f"),
    ('"', '\\"'),
    ("'", "\\'"),
)


_PLAIN = 0x100000  # numbers are passed through texts as characters from here on
_HANGUL = 0xAC00
_BETWEEN = "\x1f"  # no decomposition has it


@cache
def _decompositions() -> tuple[str, str, str]:
    """The characters that have a canonical decomposition, Hangul syllables left to arithmetic; the numbers that stand for them, as
    characters; and the decompositions in that order."""
    found = [(c, d) for c in map(chr, range(0x80, 0x110000)) if not _HANGUL <= ord(c) <= 0xD7A3 and (d := unicodedata.normalize("NFD", c)) != c]
    return "".join(c for c, _ in found), "".join(chr(_PLAIN + k) for k in range(len(found))), _BETWEEN.join(d for _, d in found)


@cache
def _marks() -> tuple[str, str, str]:
    """The characters with a combining class, their classes as characters, and a class of a regular expression that has them."""
    found = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.combining(c)]
    ranges: list[list[int]] = []
    for c in map(ord, found):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    pattern = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    return "".join(found), "".join(chr(_PLAIN + unicodedata.combining(c)) for c in found), pattern


def _syllable(c: Column) -> Column:
    """A Hangul syllable as its letters: their numbers follow from its own."""
    n = F.ascii(c) - _HANGUL
    letter = lambda first, count, k: F.get(F.split(F.lit("".join(chr(first + i) for i in range(count))), ""), k.cast("int"))
    last = n % 28
    return F.concat(
        letter(0x1100, 19, F.floor(n / 588)), letter(0x1161, 21, F.floor(n % 588 / 28)),
        F.when(last > 0, letter(0x11A8, 27, last - 1)).otherwise(""),
    )


def _decomposed(c: Column) -> Column:
    """Every character beyond ASCII by its decomposition. The text is taken in runs of ASCII and single other characters, beside the same
    runs of a copy in which each character that has a decomposition is replaced by its number."""
    composed, numbers, values = _decompositions()
    runs = lambda x: F.regexp_extract_all(x, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), 0)
    table = F.split(F.lit(values), _BETWEEN)

    def one(own: Column, told: Column) -> Column:
        syllable = own.between(chr(_HANGUL), chr(0xD7A3)) & (F.length(own) == 1)
        return F.when(own != told, F.get(table, F.ascii(told) - _PLAIN)).when(syllable, _syllable(own)).otherwise(own)

    return F.array_join(F.zip_with(runs(c), runs(F.translate(c, composed, numbers)), one), "")


def _ordered(c: Column) -> Column:
    """Marks in a row by combining class, those of one class as they come."""
    marks, classes, pattern = _marks()

    def run(piece: Column) -> Column:
        rank = lambda x, k: F.struct(F.ascii(F.translate(x, marks, classes)).alias("rank"), k.alias("at"), x.alias("mark"))
        return F.array_join(F.transform(F.array_sort(F.transform(F.split(piece, ""), rank)), lambda x: x["mark"]), "")

    pieces = F.regexp_extract_all(c, F.lit(f"[{pattern}]+|[^{pattern}]+"), 0)
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(f"^[{pattern}]"), run(x)).otherwise(x)), "")


def _replaced(c: Column) -> Column:
    """The decomposition of a text without Hangul, and without characters that stand for numbers: what the numbers in the copy stand for, all
    between them taken as it is."""
    composed, numbers, values = _decompositions()
    table, first, last = F.split(F.lit(values), _BETWEEN), rf"\x{{{_PLAIN:X}}}", r"\x{10FFFF}"
    pieces = F.regexp_extract_all(F.translate(c, composed, numbers), F.lit(f"[^{first}-{last}]+|[{first}-{last}]"), 0)
    return F.array_join(F.transform(pieces, lambda x: F.when(x >= chr(_PLAIN), F.get(table, F.ascii(x) - _PLAIN)).otherwise(x)), "")


def nfd(c: Column) -> Column:
    """Canonical decomposition, as Column functions alone. Plain ASCII text is its own; text without marks of its own needs no ordering, as
    decompositions are ordered."""
    marks, _, pattern = _marks()
    above = lambda low: rf"(?=[^\x00-\x{{{low - 1:X}}}])"  # noqa: E731  tells most characters by one comparison instead of hundreds
    ordered = F.get(F.transform(F.array(_decomposed(c)), _ordered), 0)  # the lambda names its argument often, and computes it once
    return (
        F.when(~c.rlike(r"[^\x00-\x7F]"), c)
        .when(c.rlike(f"{above(ord(marks[0]))}[{pattern}]"), ordered)
        .when(c.rlike(rf"{above(_HANGUL)}[\x{{{_HANGUL:X}}}-\x{{D7A3}}\x{{{_PLAIN:X}}}-\x{{10FFFF}}]"), _decomposed(c))
        .otherwise(_replaced(c))
    )


def trim_space(c: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def norm_label(c: Column) -> Column:
    """Trimmed, lower-cased, canonically decomposed label; accents stay."""
    return nfd(F.lower(trim_space(c)))


def strip_once_lower(c: Column) -> Column:
    """Lower-cased text without leading white space or, when there is none, without trailing."""
    low = F.lower(c)
    front = F.ltrim(low, F.lit(SPACE))
    return F.when(front != low, front).otherwise(F.rtrim(low, F.lit(SPACE)))


def label_parts(c: Column) -> Column:
    """All comma-separated parts of a label."""
    return F.split(c, ",", -1)


def label_head(c: Column) -> Column:
    """First comma-separated part of a label."""
    return F.split(c, ",", 2)[0]


def escape_literal(c: Column) -> Column:
    """Text with the characters that RDF text cannot hold replaced by their escapes."""
    for char, escaped in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(escaped))
    return c


def unescape_literal(c: Column) -> Column:
    """Inverse of RDF text escaping, numeric escapes included. Text without a backslash, nearly
    all of it, passes through untouched."""
    tokens = F.regexp_extract_all(
        c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\)"), F.lit(0)
    )

    def plain(t: Column) -> Column:
        second = F.substring(t, 2, 1)
        hexes = F.unhex(F.substring(t, 3, 8))
        return (
            F.when(~t.startswith("\\"), t)
            .when((second == "u") & (F.length(t) == 6), F.decode(hexes, "UTF-16BE"))
            .when((second == "U") & (F.length(t) == 10), F.decode(hexes, "UTF-32"))
            .when(second == "n", F.lit("\n"))
            .when(second == "t", F.lit("\t"))
            .when(second == "r", F.lit("\r"))
            .when(second == "f", F.lit("\f"))
            .when(second == "b", F.lit("\b"))
            .when(second == "", t)
            .otherwise(second)
        )

    return F.when(c.contains("\\"), F.array_join(F.transform(tokens, plain), "")).otherwise(c)


def join_list(c: Column) -> Column:
    """Elements of an array of text joined with a comma."""
    return F.concat_ws(",", c)
