"""A log of graders' answers, by the hash of what was asked: append-only, and so resumable.

An answer is a small JSON file of its own, written under another name and then renamed, before the
next prompt is asked. A task that comes after one that was lost finds its answers there and asks only
for the rest; so does the next job. Equal prompts are asked once. At most the prompt that was being
asked when an executor died is asked twice. Failures are told, not logged, so that they are tried again next time.

`log` is a folder that driver and executors share, as a path or URI that both Spark and Arrow's file systems know.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Protocol

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..plans.rubric import Dimension, Scale

LOGGED = "hash string, response string, asked_at string"


class Grader(Protocol):
    def answer(self, prompt: str) -> str:
        """What the grader says; raises if it says nothing."""


class Bucket:
    """Lets `rate` calls a second pass on average, and `burst` at once."""

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = burst, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.at = 1.0, self.at + wait
        self.tokens -= 1


def logged(spark: SparkSession, log: str) -> DataFrame:
    """(hash, response, asked_at) of all answers so far."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/answers/*/*.json")
    there = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return spark.read.schema(LOGGED).json(f"{log}/answers/*/*.json") if there else spark.createDataFrame([], LOGGED)


def ask(prompts: DataFrame, grader: Grader, log: str, key: str = "doc_id", prompt: str = "prompt", parallel: int = 8, per_second: float | None = None) -> DataFrame:
    """(key, hash, response, error) of each of `prompts`; those that the log has no answer to are asked, `parallel` at a time.

    `per_second` calls are let through in all, shared among the partitions, each with a bucket of its own.
    """
    spark = prompts.sparkSession
    hashed = prompts.select(key, F.col(prompt).alias("_prompt"), F.sha2(F.col(prompt), 256).alias("hash"))
    due = hashed.where("hash is not null").select("hash", "_prompt").dropDuplicates(["hash"]).join(logged(spark, log).select("hash"), "hash", "left_anti").repartition(parallel, "hash")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, base = fs.FileSystem.from_uri(log)
        bucket = Bucket(per_second / parallel) if per_second else None
        for f in frames:
            out = []
            for h, p in zip(f["hash"], f["_prompt"], strict=True):
                folder, error = f"{base}/answers/{h[:2]}", None
                if there.get_file_info(f"{folder}/{h}.json").type == fs.FileType.NotFound:
                    if bucket:
                        bucket.take()
                    try:
                        said = grader.answer(p)
                    except Exception as e:  # noqa: BLE001  whatever a service does, the job goes on
                        error = f"{type(e).__name__}: {e}"
                    else:
                        there.create_dir(folder)
                        part = f"{folder}/_{uuid.uuid4().hex}"
                        with there.open_output_stream(part) as o:
                            o.write(json.dumps({"hash": h, "response": said, "asked_at": datetime.now(UTC).isoformat()}).encode())
                        there.move(part, f"{folder}/{h}.json")
                out.append((h, error))
            yield pd.DataFrame(out, columns=["hash", "error"])

    # written once, so that what failed is not asked again by a second look at it
    tried = f"{log}/runs/{uuid.uuid4().hex}"
    due.mapInPandas(run, "hash string, error string").write.parquet(tried)
    failed = spark.read.parquet(tried).where("error is not null")
    return hashed.drop("_prompt").join(logged(spark, log).select("hash", "response").dropDuplicates(["hash"]), "hash", "left").join(failed, "hash", "left").select(key, "hash", "response", "error")


def evaluations(answers: DataFrame, dimensions: tuple[Dimension, ...], scale: Scale = Scale(), key: str = "doc_id") -> DataFrame:
    """(key, success, total, scores, basis, comment, problems, error) of `ask`ed answers; without an answer there is no success and a total of 0."""
    parsed = evaluate.parse_evaluation(answers.select(key, "error", F.coalesce("response", F.lit("")).alias("_r"), F.col("response").isNotNull().alias("success")), dimensions, scale, key, "_r", ("success", "error"))
    told = lambda c: F.when(F.col("success"), F.col(c))
    return parsed.select(key, "success", F.when(F.col("success"), F.col("total")).otherwise(0.0).alias("total"), *[told(c).alias(c) for c in ("scores", "basis", "comment", "problems")], "error")
