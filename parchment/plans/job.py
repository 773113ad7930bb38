"""One job: a folder of files becomes a report, and what is known already is not graded again."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import incremental, prompts, report, similarity
from ..sources import answers, files, settings, store
from . import lineage
from .review import features, review
from .rubric import Detection, Rubric, Scale, Similarity, rubric_from

KEY = "author"
#: What is kept of evaluations between jobs.
EVALUATIONS = f"{KEY} string, success boolean, total double, scores map<string,double>, basis string, comment string, problems array<string>, error string"


def asked(docs: DataFrame, instructions: str = "", key: str = KEY) -> DataFrame:
    """(key, prompt): what a grader gets of each document of (key, text, paragraphs, figures, tables)."""
    none = F.lit(0).cast("long")
    counted = features(docs, key).select(key, "text", "words", "paragraphs", "figures", "tables")
    suffix = prompts.metadata(F.col("words"), F.col("paragraphs"), F.col("figures"), F.col("tables"), none, none)
    return counted.select(key, F.concat(F.lit(instructions), prompts.asked(F.col("text"), suffix)).alias("prompt"))


def run(
    spark: SparkSession,
    folder: str,
    out: str,
    config: dict | str | Path = (),
    arguments: dict | None = None,
    env: dict[str, str] | None = None,
    grader: answers.Grader | None = None,
    judge: Callable[[str, str], str] | None = None,
    alike: Similarity = Similarity(),
    signs: Detection = Detection(),
    instructions: str = "",
    per_second: float | None = None,
    reports: str | None = None,
) -> DataFrame:
    """The report rows of the documents in `folder`, a row per author, with a column per dimension.

    Settings come from `arguments`, then the environment, then `config` (a settings file, or what it holds).
    Evaluations of an earlier job are taken from `out`, or else from the latest report under `reports`; only other authors are
    graded, and answers are logged in `out`. Written below `out`: evaluations, the summary as CSV, the report as Markdown.
    """
    loaded = settings.load(config) if isinstance(config, (str, Path)) else dict(config)
    rubric: Rubric = rubric_from(loaded)
    scale: Scale = settings.scale(arguments or {}, env or {}, loaded)
    docs = lineage.checkpoint(files.directory(spark, folder).select(KEY, "name", F.coalesce("text", F.lit("")).alias("text"), "figures", "tables"))
    known = store.restored_or_cached(spark, f"{out}/kept", {"evaluations": EVALUATIONS}, reports)
    cached = lineage.checkpoint(known["evaluations"])
    graded = cached
    if grader:
        due = incremental.pending(docs, cached, KEY)
        fresh = answers.evaluations(answers.ask(asked(due, instructions), grader, f"{out}/answers", KEY, per_second=per_second), rubric.dimensions, scale, KEY)
        graded = lineage.checkpoint(incremental.merged(cached, fresh, KEY))
    rows = review(docs, rubric.completeness, signs, alike, scale=scale, key=KEY, evaluations=graded, judge=judge)
    rows = lineage.checkpoint(report.by_dimension(rows, rubric.dimensions))
    sets, members = similarity.classes(docs, alike, KEY)
    pairs = similarity.compared(sets, alike)
    if judge:
        _, pairs = similarity.cleared(members, pairs, docs, judge, alike, KEY)
    statistics = report.statistics(rows)
    store.save({"evaluations": graded}, f"{out}/kept")
    store.summary(rows, f"{out}/reports/summary", statistics, rubric.dimensions)
    store.markdown(rows, statistics, f"{out}/reports/markdown", rubric.dimensions, lineage.checkpoint(pairs), key=KEY)
    return rows
