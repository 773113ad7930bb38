"""Parsing of graders' answers: evaluations, rubrics, image analyses. All with SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rubric import Dimension, Scale
from .scoring import clamp

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
#: What stands in for absent answers.
NO_BASIS, NO_COMMENT, UNPARSED, UNKNOWN, FAILED = "未提供评分依据", "无评语", "解析失败，请人工复核", "未知", "分析失败"
#: How answers name a total, and a score (after its dimension's name).
TOTAL = r"总[分得分][：:]\s*(\d+)"
SAID = r"[：:]\s*(\d+)"


def unfenced(response: Column) -> Column:
    """The first fenced block if there is one; else the answer without stray backticks."""
    inside = F.regexp_extract(response, FENCE, 1)
    found = F.when(response.rlike(FENCE), inside).otherwise(response)
    return T.strip(F.regexp_replace(T.strip(found), r"\A`+|`+\z", ""))


def parse_evaluation(rows: DataFrame, dimensions: tuple[Dimension, ...], scale: Scale = Scale(), key: str = "id", response: str = "response", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, more ..., parsed, scores map, total, basis, comment, problems array) of each answer.

    The total is recomputed from the dimensions; without dimensions the answer's own counts. An answer
    that is no JSON object is searched for `name: number`; dimensions not found stay absent.
    """
    v = rows.withColumn("_j", F.try_parse_json(unfenced(F.col(response)))).withColumn("_ok", F.coalesce(F.schema_of_variant("_j").startswith("OBJECT"), F.lit(False)))
    get = lambda path, kind: F.try_variant_get("_j", path, kind)
    bounded = lambda x: clamp(F.bround(x), scale.low, scale.high)
    # read once as a map, so that names with signs of their own are found too
    v = v.withColumn("_d", get("$.dimension_scores", "map<string,variant>"))
    score = lambda d: F.coalesce(F.try_variant_get(F.try_element_at("_d", F.lit(d.name)), "$", "double"), F.lit(0.0))
    said = lambda d: F.nullif(F.regexp_extract(F.col(response), rf"\Q{d.name}\E" + SAID, 1), F.lit("")).cast("double")
    json_scores = F.array(*[F.struct(F.lit(d.name).alias("key"), bounded(score(d)).alias("value")) for d in dimensions])
    text_scores = F.filter(F.array(*[F.struct(F.lit(d.name).alias("key"), bounded(said(d)).alias("value")) for d in dimensions]), lambda e: e["value"].isNotNull())
    scores = F.map_from_entries(F.when(F.col("_ok"), json_scores).otherwise(text_scores))
    total = F.lit(0.0)
    for d in dimensions:
        total = total + bounded(score(d)) * d.weight
    json_total = bounded(total) if dimensions else bounded(F.coalesce(get("$.total_score", "double"), F.lit(0.0)))
    text_total = F.coalesce(bounded(F.nullif(F.regexp_extract(F.col(response), TOTAL, 1), F.lit("")).cast("double")), F.lit(0.0))
    listed = get("$.core_problems", "array<string>")
    level = lambda p: F.transform(F.coalesce(get(f"$.core_problems.{p}", "array<string>"), F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"[{p}]"), x))
    problems = F.coalesce(listed, F.concat(level("P0"), level("P1"), level("P2")))
    return v.select(
        key,
        *more,
        F.col("_ok").alias("parsed"),
        scores.alias("scores"),
        F.when(F.col("_ok"), json_total).otherwise(text_total).alias("total"),
        F.when(F.col("_ok"), F.coalesce(get("$.evaluation_basis", "string"), F.lit(NO_BASIS))).otherwise(F.left(F.col(response), F.lit(500))).alias("basis"),
        F.when(F.col("_ok"), F.coalesce(get("$.short_comment", "string"), F.lit(NO_COMMENT))).otherwise(F.lit(UNPARSED)).alias("comment"),
        F.when(F.col("_ok"), problems).otherwise(F.array().cast("array<string>")).alias("problems"),
    )


def normalised_weights(weights: Column) -> Column:
    """Weights that do not sum to about 1 are scaled to two digits, the last taking the rest; then each lies in [0.05, 0.5]."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    scaled = lambda w, s: F.transform(w, lambda x: T.fixed(x / s, 2))
    front = lambda q: F.slice(q, F.lit(1), F.size(q) - 1)
    rest = lambda q: T.fixed(1.0 - F.aggregate(front(q), F.lit(0.0), lambda a, x: a + x), 2)
    shaped = F.get(F.transform(F.array(scaled(weights, total)), lambda q: F.concat(front(q), F.array(rest(q)))), F.lit(0))
    right = F.when((F.size(weights) == 0) | (total == 0), weights).when(F.abs(total - 1.0) > 0.01, shaped).otherwise(weights)
    return F.transform(right, lambda x: clamp(x, 0.05, 0.5))


IMAGE = "array<struct<image_index:int,description:string,relevance:string,has_caption:boolean,quality_issues:array<string>,is_likely_aigc:boolean,aigc_confidence:double>>"


def parse_images(answers: DataFrame, images: DataFrame, keys: tuple[str, ...] = ("doc", "batch")) -> DataFrame:
    """(keys, image_index, section, caption, description, ...): an answer for each image of its batch; missing or unparsable ones get defaults, unknown indexes a blank section."""
    body = unfenced(F.col("response"))
    as_list = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    parsed = answers.withColumn("_items", F.from_json(F.when(F.try_parse_json(as_list).isNotNull(), as_list), IMAGE))
    items = parsed.select(*keys, F.explode("_items").alias("i")).select(*keys, F.coalesce("i.image_index", F.lit(0)).alias("image_index"), F.col("i").alias("item"))
    joined = images.join(items, [*keys, "image_index"], "full")
    it = lambda c, default: F.coalesce(F.col(f"item.{c}"), F.lit(default))
    seen = F.col("item").isNotNull()
    return joined.select(
        *keys,
        "image_index",
        F.coalesce("section", F.lit("")).alias("section"),
        F.coalesce("caption", F.lit("")).alias("caption"),
        F.when(seen, it("description", "")).otherwise(F.lit(FAILED)).alias("description"),
        F.when(seen, it("relevance", UNKNOWN)).otherwise(F.lit(UNKNOWN)).alias("relevance"),
        it("has_caption", False).alias("has_caption"),
        F.when(seen, F.coalesce("item.quality_issues", F.array().cast("array<string>"))).otherwise(F.array(F.lit(FAILED))).alias("quality_issues"),
        it("is_likely_aigc", False).alias("is_likely_aigc"),
        it("aigc_confidence", 0.0).alias("aigc_confidence"),
    )


def parse_rubric(answers: DataFrame, key: str = "id", response: str = "response") -> DataFrame:
    """(key, parsed, names, weights, sections, sections_weight, min_words, min_figures) of generated rubrics.

    A dimension or section given as mere text is its own name, with weight 0.2 or 0; weights are
    normalised; absent settings get their defaults.
    """
    v = answers.withColumn("_j", F.try_parse_json(unfenced(F.col(response))))
    get = lambda path, kind: F.try_variant_get("_j", path, kind)
    each = lambda path: F.coalesce(get(path, "array<variant>"), F.array().cast("array<variant>"))
    name = lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$", "string"))
    is_text = lambda x: F.try_variant_get(x, "$.name", "string").isNull()
    weight = lambda x: F.when(is_text(x), F.lit(0.2)).otherwise(F.coalesce(F.try_variant_get(x, "$.weight", "double"), F.lit(0.0)))
    sections = F.when(F.size(each("$.completeness.sections")) > 0, F.transform(each("$.completeness.sections"), name)).otherwise(F.transform(each("$.sections"), name))
    return v.select(
        key,
        F.col("_j").isNotNull().alias("parsed"),
        F.transform(each("$.dimensions"), name).alias("names"),
        normalised_weights(F.transform(each("$.dimensions"), weight)).alias("weights"),
        sections.alias("sections"),
        F.coalesce(get("$.completeness.sections_weight", "double"), F.lit(40.0)).alias("sections_weight"),
        F.coalesce(get("$.completeness.word_count.min", "long"), get("$.min_word_count", "long"), F.lit(2000)).alias("min_words"),
        F.coalesce(get("$.completeness.figures.min", "long"), F.lit(3)).alias("min_figures"),
    )
