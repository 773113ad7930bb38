"""Results kept between runs, and reports written from them."""

from __future__ import annotations

import json
import shutil
import zipfile
from datetime import datetime
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report, scoring
from ..plans.rubric import Dimension, Scale

#: Risks that are not suspicious, and what absent values look like.
HARMLESS = ("正常", "低风险")
ABSENT = "-"


def save(results: dict[str, DataFrame], folder: str, kind: str = "parquet", keep: int = 2) -> int:
    """A snapshot of all results, whose number is returned.

    Every result goes to a folder of the snapshot's own, and a manifest that names them all comes last, by one rename.
    Until then `load` gives the snapshot before, so a job that fails between two results leaves what was there whole,
    and results may be read from the snapshot that they replace. The last `keep` snapshots stay.
    """
    spark = next(iter(results.values())).sparkSession
    number = max(_snapshots(spark, folder), default=0) + 1
    for name, df in results.items():
        df.write.mode("overwrite").format(kind).save(f"{folder}/{number:08d}/{name}")
    _put(spark, f"{folder}/{MANIFESTS}/{number:08d}.json", json.dumps({"kind": kind, "results": sorted(results)}))
    for old in sorted(_snapshots(spark, folder))[:-keep]:
        # first what names it, so that no manifest names what is gone
        for path in (f"{folder}/{MANIFESTS}/{old:08d}.json", f"{folder}/{old:08d}"):
            there, target = _hadoop(spark, path)
            there.delete(target, True)
    return number


def load(spark: SparkSession, folder: str, schemas: dict[str, str], number: int | None = None) -> dict[str, DataFrame]:
    """What the last `save` wrote, or that of a number; an absent result is an empty one."""
    number = max(_snapshots(spark, folder), default=None) if number is None else number
    manifest = {"results": []} if number is None else json.loads("".join(r.value for r in spark.read.text(f"{folder}/{MANIFESTS}/{number:08d}.json").collect()))
    read = lambda name, schema: spark.read.schema(schema).format(manifest["kind"]).load(f"{folder}/{number:08d}/{name}")
    return {name: read(name, schema) if name in manifest["results"] else spark.createDataFrame([], schema) for name, schema in schemas.items()}


MANIFESTS = "manifests"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, content: str) -> None:
    """A small file, there as a whole or not at all."""
    there, part = _hadoop(spark, f"{path}.part")
    out = there.create(part, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    if not there.rename(part, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise FileExistsError(path)


def _snapshots(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the snapshots that were finished."""
    return [int(p.rsplit("/", 1)[1].removesuffix(".json")) for p in _found(spark, f"{folder}/{MANIFESTS}/*.json")]


#: Columns of a report that are no dimension.
PLAIN = ("ordinal", "author", "title", "words", "completeness", "probability", "suspicious", "risk", "evaluation", "success", "highest", "links", "final", "deduction", "similarity", "basis", "comment", "problems", "error")


def restored(summary: DataFrame) -> DataFrame:
    """Results from a report's columns (author, completeness, risk, deduction, similarity); lossy, as the report rounds."""
    digits = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("double"), F.lit(0.0))
    return summary.select(
        "author",
        F.coalesce(F.expr("try_cast(completeness AS double)"), F.lit(0.0)).alias("score"),
        F.least(digits("deduction") / 80.0, F.lit(1.0)).alias("probability"),
        (~F.col("risk").isin(*HARMLESS)).alias("suspicious"),
        (digits("similarity") / 100.0).alias("highest"),
    )


def restored_evaluations(summary: DataFrame) -> DataFrame:
    """(author, success, total, scores, basis, comment, problems, error): the grades that a report shows, successful ones, so that nobody is graded again.

    Every column that no report has of itself is a dimension.
    """
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    has = lambda c: F.col(f"`{c}`") if c in summary.columns else F.lit(None).cast("string")
    dimensions = [c for c in summary.columns if c not in PLAIN]
    entries = F.array(*[F.struct(F.lit(c).alias("key"), number(c).alias("value")) for c in dimensions]) if dimensions else F.array().cast("array<struct<key:string,value:double>>")
    rows = summary.select("author", F.lit(True).alias("success"), (number("evaluation") if "evaluation" in summary.columns else F.lit(None).cast("double")).alias("total"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("scores"), has("basis").alias("basis"), has("comment").alias("comment"), F.from_json(has("problems"), "array<string>").alias("problems"), F.lit(None).cast("string").alias("error"))
    return rows.where("total is not null")


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern matches, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in statuses or [])


def restored_or_cached(spark: SparkSession, folder: str, schemas: dict[str, str], reports: str | None = None) -> dict[str, DataFrame]:
    """The cached results; without a cache what the latest report under `reports` still tells (`report`); else empty results."""
    if _snapshots(spark, folder):
        return load(spark, folder, schemas)
    found = {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    latest = _found(spark, f"{reports}/summary*/rows") if reports else []
    if not latest:
        return found
    # a field may hold line breaks and quotes
    told = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(latest[-1])
    grades = {"evaluations": restored_evaluations(told)} if "evaluations" in schemas else {}
    return found | {"report": restored(told.withColumns({c: F.lit(None).cast("string") for c in ("deduction", "similarity") if c not in told.columns}))} | grades


def summary(rows: DataFrame, folder: str, statistics: DataFrame | None = None, dimensions: tuple[Dimension, ...] = ()) -> None:
    """The report as CSV tables with a header: `rows` in order of their ordinal, `statistics`, and the rubric."""
    flat = rows.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in rows.dtypes])
    _csv(flat.repartitionByRange("ordinal").sortWithinPartitions("ordinal"), f"{folder}/rows")
    if statistics is not None:
        _csv(statistics, f"{folder}/statistics")
    if dimensions:
        _csv(rows.sparkSession.createDataFrame([(d.name, d.weight, d.description) for d in dimensions], "dimension string, weight double, description string"), f"{folder}/rubric")


def _csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def post_normalised(spark: SparkSession, reports: str, scale: Scale = Scale(out_low=60, out_high=90, exponent=1.5), column: str = "final") -> str:
    """Bring the scores of the latest summary under `reports` to another scale, in a summary of its own, whose path is returned.

    Rows without a number keep what they have; the summary that was read stays as it is.
    """
    latest = _found(spark, f"{reports}/summary*/rows")
    if not latest:
        raise FileNotFoundError(f"there is no summary under {reports}")
    rows = spark.read.option("header", True).csv(latest[-1])
    if column not in rows.columns:
        raise ValueError(f"the summary has no column {column}")
    score = F.expr(f"try_cast(`{column}` AS double)")
    done = rows.withColumn(column, F.coalesce(scoring.normalise(score, scale).cast("string"), F.col(column)))
    target = latest[-1].removesuffix("/rows").replace("/summary", "/normalized")
    range_ = rows.agg(F.min(score).alias("lowest"), F.max(score).alias("highest"), F.count(score).alias("n"))
    _csv(done, f"{target}/rows")
    _csv(range_.select("*", F.lit(f"{scale.out_low:g}~{scale.out_high:g}, exponent={scale.exponent:g}").alias("scale")), f"{target}/statistics")
    return target


def _placed(pairs: DataFrame) -> DataFrame:
    """`pairs` with their place `_n` in order of a, then b."""
    return report.numbered(pairs.withColumn("_pair", F.struct("a", "b")), "_pair").withColumnRenamed("ordinal", "_n")


#: The headings of a report.
TITLE, RUBRIC, SCORES, STATISTICS, COPIES, SIGNS, DETAILS = "论文评审报告", "评分维度", "评分汇总", "统计信息", "查重总结", "AIGC 检测总结", "逐个学生评审详情"
NO_COPIES, NO_SIGNS = "✅ 未发现明显抄袭情况", "✅ 未发现明显AI生成内容"


def lines(rows: DataFrame, statistics: DataFrame, dimensions: tuple[Dimension, ...] = (), pairs: DataFrame | None = None, key: str = "doc_id", at: datetime | None = None) -> DataFrame:
    """(part, n, m, value): the lines of a report in order of the first three.

    Title and time, rubric, a table row per document, statistics, similar pairs (a, b, similarity),
    suspicious documents, and the details of each. Lists and maps of `rows` go to the details only.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    columns = [c for c in rows.columns if c != "ordinal" and not kinds[c].startswith(("array", "map", "struct"))]
    text = lambda c: F.coalesce(F.regexp_replace(c.cast("string"), r"[|\n]", " "), F.lit(ABSENT))
    percent = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    has = lambda *names: all(c in kinds for c in names)
    numbers = statistics.first().asDict()

    def fixed(part: int, *values: str) -> DataFrame:
        return spark.createDataFrame([(part, 0, n, v) for n, v in enumerate(values)], "part int, n long, m long, value string")

    def spread(part: int, found: DataFrame, n: Column, value: Column, m: Column = F.lit(0)) -> DataFrame:
        return found.select(F.lit(part).alias("part"), n.cast("long").alias("n"), m.cast("long").alias("m"), value.alias("value"))

    out = [fixed(0, f"# {TITLE}", "", f"> {(at or datetime.now()):%Y-%m-%d %H:%M}", "")]
    if dimensions:
        out.append(fixed(1, f"## {RUBRIC}", "", "| 维度 | 权重 | 说明 |", "| --- | --- | --- |", *(f"| {d.name} | {d.weight * 100:.0f}% | {d.description} |" for d in dimensions), ""))
    out.append(fixed(2, f"## {SCORES}", "", "| 序号 | " + " | ".join(columns) + " |", "|" + " --- |" * (len(columns) + 1)))
    out.append(spread(3, rows, F.col("ordinal"), F.concat(F.lit("| "), F.concat_ws(" | ", F.col("ordinal").cast("string"), *[text(F.col(f"`{c}`")) for c in columns]), F.lit(" |"))))
    out.append(fixed(4, "", f"### {STATISTICS}", "", *(f"- {k}: **{ABSENT if v is None else v}**" for k, v in numbers.items()), "", f"## {COPIES}", ""))
    if pairs is not None:
        out.append(spread(5, _placed(pairs), F.col("_n"), F.format_string("- **%s** 与 **%s** 相似度 %.0f%%", F.col("a").cast("string"), F.col("b").cast("string"), F.col("similarity") * 100)))
    if pairs is None or pairs.isEmpty():
        out.append(fixed(6, NO_COPIES))
    out.append(fixed(7, "", f"## {SIGNS}", ""))
    suspicious = rows.where("suspicious") if has("suspicious", "risk", "probability") else None
    if suspicious is not None:
        out.append(spread(8, suspicious, F.col("ordinal"), F.concat(F.lit("- **"), F.col(key).cast("string"), F.lit("**："), "risk", F.lit("（AI概率 "), percent("probability"), F.lit("）"))))
    if suspicious is None or suspicious.isEmpty():
        out.append(fixed(9, NO_SIGNS))
    out.append(fixed(10, "", "---", "", f"## {DETAILS}", ""))
    title = F.concat(F.lit("### "), F.col(key).cast("string"), F.lit(" — "), text(F.col("title"))) if has("title") else F.concat(F.lit("### "), F.col(key).cast("string"))
    said = [title, F.lit("")]
    said += [F.concat(F.lit(f"- {c}: "), text(F.col(f"`{c}`"))) for c in columns if c not in (key, "title")]
    for c, kind in rows.dtypes:
        if kind == "array<string>":
            said.append(F.concat(F.lit(f"- {c}: "), text(F.array_join(F.col(f"`{c}`"), "; "))))
        elif kind.startswith(("array", "map", "struct")):
            said.append(F.concat(F.lit(f"- {c}: "), text(F.to_json(F.col(f"`{c}`")))))
    said += [F.lit(""), F.lit("---"), F.lit("")]
    details = rows.select("ordinal", F.posexplode(F.array(*said)).alias("m", "value"))
    out.append(spread(11, details, F.col("ordinal"), F.col("value"), F.col("m")))
    return reduce(DataFrame.unionByName, out)


def markdown(rows: DataFrame, statistics: DataFrame, folder: str, dimensions: tuple[Dimension, ...] = (), pairs: DataFrame | None = None, **how) -> None:
    """The report as Markdown text, written in order by the executors."""
    found = lines(rows, statistics, dimensions, pairs, **how)
    found.repartitionByRange("part", "n", "m").sortWithinPartitions("part", "n", "m").select("value").write.mode("overwrite").text(folder)


#: The parts of a Word package.
PACKAGE = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
BODY = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>', "</w:body></w:document>"


def word(rows: DataFrame, statistics: DataFrame, path: str, dimensions: tuple[Dimension, ...] = (), pairs: DataFrame | None = None, **how) -> None:
    """The same report as one Word file, a paragraph a line.

    The executors write the paragraphs, in order, as parts beside it; once all are there the parts are joined as streams of bytes, a
    megabyte at a time, into a file that is renamed at the end. `path` is one that Arrow's file systems know.
    """
    found = lines(rows, statistics, dimensions, pairs, **how).repartitionByRange("part", "n", "m").sortWithinPartitions("part", "n", "m")
    plain = F.regexp_replace("value", UNPRINTABLE, "")
    escaped = F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = f"{path}.parts"
    found.select(F.concat(F.lit(PARAGRAPH[0]), escaped, F.lit(PARAGRAPH[1]))).write.mode("overwrite").text(parts)
    there, target = fs.FileSystem.from_uri(str(path))
    written = sorted(x.path for x in there.get_file_info(fs.FileSelector(f"{target}.parts")) if x.base_name.startswith("part-"))
    with there.open_output_stream(f"{target}.new") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in PACKAGE.items():
            z.writestr(name, content)
        with z.open("word/document.xml", "w", force_zip64=True) as f:
            f.write(BODY[0].encode())
            for part in written:
                with there.open_input_stream(part) as one:
                    shutil.copyfileobj(one, f, 1 << 20)
            f.write(BODY[1].encode())
    there.move(f"{target}.new", target)
    there.delete_dir(f"{target}.parts")


#: A line's paragraph; and what no XML may hold.
PARAGRAPH = '<w:p><w:r><w:t xml:space="preserve">', "</w:t></w:r></w:p>"
UNPRINTABLE = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
