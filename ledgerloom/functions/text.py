"""Text canonicalisation and line handling."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.binding import built_once, let

# Every line separator the source system recognises; a CR LF pair only makes a
# further blank line, and those drop out.
_BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
LINE_BREAK = f"[{_BREAKS}]"
# Blanks that are left inside a line once text is decomposed and split.
_BLANK = r" \t\x1F\u1680"
_ENDS = " \t\x1F\u1680\n"
# Anything but single spaces and single line feeds that do not touch: plain searches, as a class of scattered
# characters costs a chain of tests at every character of the text.
_UNTIDY = (*"\t\r\x0B\x0C\x1C\x1D\x1E\x1F", "  ", "\n\n", " \n", "\n ")
# Every character with the Unicode property White_Space, and the four separators before the space.
_ALL_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_RARE_BLANK = r"[\x85\u1680\u2028\u2029]"
_NON_ASCII = r"[^\x00-\x7F]"

# Typographic marks and their plain form.
_MARKS_FROM = "\u2013\u2014\u2015\u2018\u2019\u201c\u201d"
_MARKS_TO = "---''\"\""

# Runs of one letter shrink to a single letter, except the exact
# doubles LL, RR, SS and CC.
# Letters are listed one by one: a class of single letters is one look-up, one of ranges a test for each.
_LETTER_RUNS = (r"([LRSC])\1{2,}", r"([ABDEFGHIJKMNOPQTUVWXYZ])\1+")


@lru_cache
def _combining_marks() -> str:
    return "".join(chr(c) for c in range(0x300, 0x110000) if unicodedata.combining(chr(c)))


def is_ascii(text: Column) -> Column:
    """Whether every character takes one byte."""
    return F.octet_length(text) == F.char_length(text)


def decompose(text: Column) -> Column:
    """Compatibility decomposition (NFKD) through the ICU library Spark ships."""
    return F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True)
    )


def fold_accents(text: Column, marks_from: str = "", marks_to: str = "") -> Column:
    """NFKD without combining marks; plain ASCII text is passed through untouched.

    The marks of Latin letters go by one range; the character table of all
    others is consulted only where something beyond Latin-1 is left.
    """

    def strip(latin: Column) -> Column:
        return F.when(
            ~is_ascii(latin) & latin.rlike(r"[^\x00-\xFF]"), F.translate(latin, marks_from + _combining_marks(), marks_to)
        ).otherwise(latin)

    return F.when(
        ~is_ascii(text), let(F.regexp_replace(decompose(text), r"[\u0300-\u036F]+", ""), strip)
    ).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Canonical form: no accents, upper case, single spaces, no blank lines."""

    def tidy(plain: Column) -> Column:
        lines = F.regexp_replace(plain, f"[{_BLANK}]*[{_BREAKS}][{_BLANK}{_BREAKS}]*", "\n")
        spaced = F.regexp_replace(lines, "[ \t]{2,}|\t", " ")
        untidy = reduce(or_, [F.contains(plain, F.lit(u)) for u in _UNTIDY]) | (~is_ascii(plain) & plain.rlike(_RARE_BLANK))
        return F.btrim(F.when(untidy, spaced).otherwise(plain), F.lit(_ENDS))

    text = let(F.upper(fold_accents(F.coalesce(text, F.lit("")), _MARKS_FROM, _MARKS_TO)), tidy)
    for runs in _LETTER_RUNS:
        text = F.regexp_replace(text, runs, "$1")
    return text


@built_once
def normalized(name: str) -> Column:
    return normalize_text(F.col(name))


def with_normalized(docs: DataFrame, text: str = "text", out: str = "norm") -> DataFrame:
    """Add the canonical text as its own projection (evaluated once per row)."""
    return docs.withColumn(out, normalized(text))


def mentions(text: Column, words: str) -> Column:
    """Whether any of the words, joined by bars, is in the text; a plain search each, not a pattern."""
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words.split("|")])


def lines_of(norm: Column) -> Column:
    """Lines of canonical text as an array (empty text gives no line)."""
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, "\n"))


def trim_blank(text: Column) -> Column:
    """Trim every Unicode blank at both ends; what lies between is not searched."""
    return F.btrim(text, F.lit(_ALL_BLANKS))


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank canonical line, in reading order."""
    return (
        with_normalized(docs.select(key, text), text)
        .select(key, F.posexplode(lines_of(F.col("norm"))).alias("line_no", "line"))
    )


def markup_lines(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Markup to plain lines: every tag breaks the line, blanks and rules drop out."""
    pieces = F.split(F.regexp_replace(F.col(markup), "<[^>]+>", "\n"), LINE_BREAK)
    kept = F.filter(F.transform(pieces, trim_blank), lambda t: (t != "") & (t != "---"))
    return pages.select(key, F.posexplode(kept).alias("line_no", "line"))


def safe_filename(name: Column) -> Column:
    """Base name without accents or unsafe characters; ``document`` if nothing is left."""
    base = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    ascii_only = F.regexp_replace(fold_accents(base), _NON_ASCII, "")
    safe = F.regexp_replace(ascii_only, "[^A-Za-z0-9._-]", "_")
    return F.coalesce(F.nullif(F.btrim(safe, F.lit("._")), F.lit("")), F.lit("document"))
