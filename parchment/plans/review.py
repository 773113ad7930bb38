"""A whole review: features, completeness, detection, similarity, grading, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import completeness, detect, incremental, report, scorer, segment, similarity
from .rubric import Completeness, Detection, Scale, Similarity


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counted features of texts; references are those of the section of that name."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(key), t.alias("text"), segment.runs(t).alias("_r"), *[F.col(c) for c in ("figures", "tables") if c in docs.columns])
    has = lambda name: (F.length(F.coalesce(segment.section(F.col("_r"), name), F.lit(""))) > 0)
    out = cut.select(
        key,
        "text",
        T.title(T.filled_lines(F.col("text"))).alias("title"),
        T.word_count(F.col("text")).alias("words"),
        T.paragraph_count(F.col("text")).alias("paragraphs"),
        T.reference_count(segment.section(F.col("_r"), "references")).alias("references"),
        (F.col("figures") if "figures" in cut.columns else F.lit(0)).cast("long").alias("figures"),
        (F.col("tables") if "tables" in cut.columns else F.lit(0)).cast("long").alias("tables"),
        has("abstract").alias("has_abstract"),
        has("keywords").alias("has_keywords"),
        has("references").alias("has_references"),
    )
    return out


def review(
    docs: DataFrame,
    rules: Completeness = Completeness(),
    signs: Detection = Detection(),
    alike: Similarity = Similarity(),
    grader: scorer.Scorer | None = None,
    cached: DataFrame | None = None,
    scale: Scale = Scale(),
    key: str = "doc_id",
    images: DataFrame | None = None,
    evaluations: DataFrame | None = None,
    judge: Callable[[str, str], str] | None = None,
    order: str | None = None,
) -> DataFrame:
    """A report row per document. `cached` evaluations (key, success, total) are not made again; without a grader there are none.

    evaluations: (key, success, total and what else graders said), over the cached ones, instead of a grader.
    images: (key, image_index, is_likely_aigc, aigc_confidence, quality_issues) of analysed images.
    judge: a second opinion on pairs of high similarity; those that it clears count nowhere.
    order: a column of `docs`; where a key is there more than once, its last row counts.
    """
    if order:
        docs = report.last_of(docs, key, order)
    measured = features(docs, key)
    if images is not None:
        each = F.struct(F.col("image_index").alias("index"), F.col("is_likely_aigc").alias("likely"), F.col("aigc_confidence").alias("confidence"), "quality_issues")
        measured = measured.join(images.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("images")), key, "left")
    # completeness and signs are read from the same row, in one pass over the texts
    found = detect.detected(completeness.check(measured, rules), signs).select(key, "title", "words", F.col("score").alias("completeness"), "probability", "suspicious", "risk")
    sets, members = similarity.classes(docs, alike, key)
    pairs = similarity.compared(sets, alike)
    if judge:
        members, pairs = similarity.cleared(members, pairs, docs, judge, alike, key)
    links = similarity.rollup(members, pairs, alike, key)
    nothing = docs.sparkSession.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, success boolean, total double")
    done = cached if cached is not None else nothing
    if evaluations is not None:
        fresh = evaluations
    else:
        fresh = scorer.evaluate(incremental.pending(docs, done, key), grader, key) if grader else nothing
    graded = incremental.merged(done, fresh, key)
    return report.numbered(report.joined(found, graded, links, key=key, scale=scale), key)
