"""Text functions, Column to Column, with Python's Unicode semantics where Java's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what Python's str.strip takes for white space.
WHITE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Label lines that are no title, and the title of a text without one.
TITLE_LABEL = "论文题目|题目|Title"
NO_TITLE = "未识别标题"
HAN = r"[\x{4E00}-\x{9FFF}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WHITE}+|{WHITE}+\z", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def clean_lines(text: Column) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def filled_lines(text: Column) -> Column:
    """The lines that are not blank, as they are."""
    return F.filter(lines(text), lambda x: strip(x) != "")


def clean_text(text: Column) -> Column:
    return F.array_join(clean_lines(text), "\n")


def word_count(text: Column) -> Column:
    """Han characters, and runs of ASCII letters."""
    return (F.regexp_count(text, F.lit(HAN)) + F.regexp_count(text, F.lit("[a-zA-Z]+"))).cast("long")


def paragraph_count(text: Column) -> Column:
    return F.size(filled_lines(text)).cast("long")


def title(filled: Column) -> Column:
    """The first of the lines under 100 characters that is no label."""
    fits = F.filter(filled, lambda x: (F.length(x) < 100) & ~x.rlike(rf"(?iu)\A(?:{TITLE_LABEL})"))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(NO_TITLE))


def reference_count(section: Column) -> Column:
    """Numbered references, else lines that are not blank."""
    numbered = F.regexp_count(section, F.lit(r"\[\p{Nd}+\]"))
    return F.when(F.coalesce(section, F.lit("")) == "", 0).when(numbered > 0, numbered).otherwise(F.size(filled_lines(section))).cast("long")


def author_key(filename: Column) -> Column:
    """Number and name, or name, from a file name's parts."""
    base = F.regexp_extract(filename, r"([^/]*)/*\z", 1)
    stem = F.coalesce(F.nullif(F.regexp_extract(base, r"\A(.+)\.[^.]+\z", 1), F.lit("")), base)
    parts = F.filter(F.split(stem, rf"(?:[_-]|{WHITE})+"), lambda p: p != "")
    is_number = lambda p: p.rlike(r"\A\p{Nd}+\z")
    at = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    number = F.element_at(F.filter(at, lambda x: is_number(x["p"]) & (F.length(x["p"]) >= 6)), -1)
    names = F.filter(at, lambda x: ~is_number(x["p"]) & (F.length(x["p"]) >= 2))
    after = F.get(F.filter(names, lambda x: x["i"] > number["i"]), F.lit(0))["p"]
    has_number = F.exists(parts, lambda p: is_number(p) & (F.length(p) >= 6))
    return F.when(has_number, F.concat(number["p"], F.lit("-"), F.coalesce(after, F.element_at(parts, -1)))).otherwise(F.coalesce(F.get(names, F.lit(0))["p"], stem))


def comment(basis: Column) -> Column:
    """A grading comment on one line, broken before each chapter mark."""
    flat = F.regexp_replace(F.regexp_replace(basis, "\n", " "), "\r", "")
    return strip(F.regexp_replace(flat, r"(\[[第全])", "\n$1"))


def shortened(text: Column, limit: int, mark: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def fixed(x: Column, digits: int) -> Column:
    """Rounded half up at `digits`, by the same arithmetic as the SQL twins."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
