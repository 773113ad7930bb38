"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def few_rows(spark: SparkSession) -> None:
    """Rows go to Python a thousand or 16 MB at a time, so that long texts need little memory on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; dealt out if they come in fewer parts than there are cores, as one small file does."""
    few_rows(spark)
    found, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _own_folder(spark: SparkSession) -> str:
    """A temporary folder, which the process removes at its end; only where one machine does all the work."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster has to name its shared folder in spark.checkpoint.dir")
    folder = tempfile.mkdtemp(prefix="parchment-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a copy in the shared folder of spark.checkpoint.dir.

    A folder of our own is set only where a local session names none, as in tests.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or a temporary one where a local session names none, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own_folder(spark)


class Kept:
    """Copies of frames as Parquet in the shared folder, smaller than checkpoints; `drop` removes one that no plan needs any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.number = spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """The copy, and its path; what only led to it, broadcasts and shuffle files too, is let go at once, as Spark cleans up after the driver's garbage."""
        self.number += 1
        path = f"{self.folder}/{self.number}"
        out = stored(df, path)
        self.spark._jvm.System.gc()
        return out, path

    def drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Members:
    """A filter of fixed size that holds at least the given numbers; others pass it the more often, the more it holds."""

    BITS = 1 << 24

    @classmethod
    def slot(cls, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(cls.BITS))

    def __init__(self, rows: DataFrame, column: str):
        bits = rows.select(self.slot(column).alias("i")).groupBy(F.shiftright("i", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i % 64 as int))")).alias("bits")).toArrow()  # BITS / 64 rows at most
        table = np.zeros(self.BITS // 64, np.int64)
        table[bits["at"].to_numpy()] = bits["bits"].to_numpy()
        self.shared = rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def has(self, slots: np.ndarray) -> np.ndarray:
        return (self.shared.value[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)) == 1


def pieces(data: str | bytes, gap: re.Pattern, size: int = 1 << 20) -> Iterator[str | bytes]:
    """`data` in pieces of about `size`, cut only where `gap` matches, so that what lies between gaps stays whole."""
    at = 0
    while len(data) - at > size and (cut := gap.search(data, at + size)):
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


def stored(df: DataFrame, path: str) -> DataFrame:
    """`df`, written as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def filtered(df: DataFrame, keep, column: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose values of `column` `keep` (a function of a list) marks true."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def id_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null ids fall in no bucket."""
    return F.crc32(column.cast("string")) % F.lit(modulus)


def threshold(bound: int, total: int) -> int:
    """Of hashes from 0 up to 2**62, the one below which about `bound` of `total` lie."""
    return (bound << 62) // max(total, bound, 1)


def first_of_each(df: DataFrame, column: str) -> DataFrame:
    """Of the rows of each task the first of each value of `column`, whose values are few."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            new = []
            for x in b.column(at).to_pylist():
                new.append(x not in seen)
                seen.add(x)
            yield b.filter(pa.array(new, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def bounded_rows(df: DataFrame, sized: str, bound: int, total: int, most_bytes: int = 128 << 20) -> list[Row]:
    """About `bound` of the `total` rows of `df` and never more, repeated ones once, of at most `most_bytes` in column `sized`.

    They are picked by a hash of the whole row, so the same rows each time. At first about twice the
    bound's share of the rows is looked at; where repeated rows leave too few of them, more, up to all. A row
    that takes more than a sixteenth of `most_bytes`, or than what is left of it, is passed over. Only
    hashes and sizes are collected to choose, and then the rows chosen.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], F.octet_length(F.col(f"`{sized}`")).alias("size"))
    marked = named.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *[f"c{i}" for i in range(len(columns))]), 2))
    fits, share = F.coalesce("size", F.lit(0)) <= most_bytes // 16, threshold(2 * bound, total)
    while True:
        found = marked.where((F.col("h") < share) & fits).groupBy("h").agg(F.max("size").alias("size")).orderBy("h").limit(bound).collect()
        if len(found) >= bound or share >= 1 << 62:
            break
        share = min(1 << 62, share * max(4, min(64, 2 * bound // max(len(found), 1))))
    left, chosen = most_bytes, []
    for r in found:
        if (r.size or 0) <= left:
            left -= r.size or 0
            chosen.append((r.h,))
    if not chosen:
        return []
    wanted = df.sparkSession.createDataFrame(chosen, "h long")  # `bound` numbers at most
    rows = first_of_each(marked.where((F.col("h") <= chosen[-1][0]) & fits).join(F.broadcast(wanted), "h"), "h").dropDuplicates(["h"]).orderBy("h").collect()
    return [Row(**{c: r[f"c{i}"] for i, c in enumerate(df.columns)}) for r in rows]
