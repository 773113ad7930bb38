"""What graders are asked: texts with their counts, rubrics, and batches of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rubric import Dimension, Scale

MOST, CAPTION, BATCH = 15_000, 120, 5
#: The wording that graders get.
CUT = "\n...（论文内容过长，已截断）"
COUNTS = "\n\n【解析元数据】字数:%d | 段落:%d | 图片:%d | 表格:%d"
NO_IMAGES = "\n【注意】该文档未检测到嵌入图片（可能为纯文本或PDF解析降级结果）"
LIKELY, POOR = "\n【视觉分析】%d张图片疑似AIGC生成", "\n【视觉分析】%d张图片存在质量问题"
IMAGE_LINE = "  图片 #%d — 所在章节：%s，上下文：%s"


def metadata(words: Column, paragraphs: Column, figures: Column, tables: Column, likely: Column, poor: Column) -> Column:
    """The counts that follow a text; likely and poor count analysed images."""
    some = lambda n, line: F.when(n > 0, F.format_string(line, n)).otherwise(F.lit(""))
    return F.concat(F.format_string(COUNTS, words, paragraphs, figures, tables), F.when(figures == 0, F.lit(NO_IMAGES)).otherwise(F.lit("")), some(likely, LIKELY), some(poor, POOR))


def asked(text: Column, suffix: Column) -> Column:
    """A text, shortened, with its counts."""
    return F.concat(T.shortened(text, MOST, CUT), suffix)


def system(template: str, requirements: str, dimensions: tuple[Dimension, ...], scale: Scale = Scale()) -> str:
    """The instructions: each name in braces is filled once and doubled braces become single; braces in what is filled in stay."""
    listed = "\n".join(f"- {d.name}（权重{d.weight * 100:.0f}%）：{d.description}" for d in dimensions)
    for name, value in (("requirements", requirements), ("dimensions", listed)):
        template = template.replace("{" + name + "}", value.replace("{", "{{").replace("}", "}}"), 1)
    return template.format(score_min=f"{scale.low:g}", score_max=f"{scale.high:g}")


def batched(images: DataFrame, doc: str = "doc", index: str = "image_index", size: int = BATCH) -> DataFrame:
    """`images` with the number of their batch within the document, from 1."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(index))
    return images.withColumn("batch", (F.floor((n - 1) / size) + 1).cast("long"))


def image_lists(images: DataFrame, keys: tuple[str, ...] = ("doc", "batch")) -> DataFrame:
    """(keys, listed): a line per image of a batch, in order."""
    line = F.format_string(IMAGE_LINE, F.col("image_index"), F.col("section"), T.shortened(F.col("caption"), CAPTION, "..."))
    lines = F.array_sort(F.collect_list(F.struct("image_index", line.alias("line"))))
    return images.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("listed"))
