"""Sections of a text: heading lines start a run, and the last run with content counts for its class.

All of it happens within the row, on arrays, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: How the heading lines of each class begin, in the order that decides.
HEADINGS = {
    "abstract": r"摘\s*要|Abstract",
    "keywords": r"关\s*键\s*词|Keywords",
    "introduction": r"引\s*言|绪\s*论|前\s*言|第\s*1\s*章|Chapter\s*1",
    "body": r"正\s*文|第\s*[2-9]\s*章|Chapter\s*[2-9]",
    "conclusion": r"结\s*论|总\s*结|结\s*语|Conclusion",
    "references": r"参\s*考\s*文\s*献|References|Bibliography",
}


def heading(line: Column, headings: dict[str, str] = HEADINGS) -> Column:
    """The class of a heading line, else null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(headings.items()):
        found = F.when(line.rlike(rf"(?iuU)\A(?:{pattern})"), F.lit(name)).otherwise(found)
    return found


def runs(text: Column, headings: dict[str, str] = HEADINGS) -> Column:
    """array of (cls, content): every run of lines under a heading that has content, in order."""
    tagged = F.transform(T.clean_lines(text), lambda x: F.struct(x.alias("line"), heading(x, headings).alias("cls")))

    def cut(rows: Column) -> Column:
        marks = F.filter(F.transform(rows, lambda r, i: F.struct((i + 1).alias("i"), r["cls"].alias("cls"))), lambda m: m["cls"].isNotNull())
        marks = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit("header").alias("cls"))), marks)
        return F.get(F.transform(F.array(marks), lambda ms: F.transform(ms, lambda m, k: content(rows, m, F.coalesce(F.get(ms, k + 1)["i"], F.size(rows) + 1)))), F.lit(0))

    def content(rows: Column, mark: Column, stop: Column) -> Column:
        held = F.slice(rows, mark["i"] + 1, stop - mark["i"] - 1)
        return F.struct(mark["cls"].alias("cls"), F.array_join(F.transform(held, lambda r: r["line"]), "\n").alias("content"))

    return F.filter(F.get(F.transform(F.array(tagged), cut), F.lit(0)), lambda r: r["content"] != "")


def section(runs_: Column, name: str) -> Column:
    """The content of the last run of a class, else null."""
    return F.get(F.reverse(F.filter(runs_, lambda r: r["cls"] == name)), F.lit(0))["content"]


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", headings: dict[str, str] = HEADINGS) -> DataFrame:
    """(key, cls, content): a row for each class that a text has."""
    cut = docs.select(key, runs(F.coalesce(F.col(text), F.lit("")), headings).alias("_runs"))
    held = F.array(*[F.struct(F.lit(c).alias("cls"), section(F.col("_runs"), c).alias("content")) for c in ("header", *headings)])
    return cut.select(key, F.explode(F.filter(held, lambda x: x["content"].isNotNull())).alias("s")).select(key, "s.cls", "s.content")


def carried(rows: DataFrame, group: str, order: str, text: str, headings: dict[str, str] = HEADINGS) -> DataFrame:
    """`rows` with section (of the latest heading so far) and caption (own text, else a short next one, else the section)."""
    w = Window.partitionBy(group).orderBy(order)
    own = T.strip(F.coalesce(F.col(text), F.lit("")))
    out = rows.withColumn("section", F.coalesce(F.last(heading(own, headings), ignorenulls=True).over(w), F.lit("header")))
    following = F.lead(own).over(w)
    usable = (F.length(following) > 0) & (F.length(following) < 200)
    return out.withColumn("caption", F.when(own != "", F.left(own, F.lit(200))).when(usable, following).otherwise(F.col("section")))
