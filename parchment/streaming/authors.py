"""Extension: the incremental review as a stream with a state per author.

The state is the best file so far: of the kinds of files the best, then the first by name, and its
content's digest. A file that is better, or the same file with other content, replaces it and is evaluated, once; all others
change nothing, however often they come. So a batch needs no earlier results. An author of whom nothing
came for the time `keep` is forgotten, and begins anew with the next file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators import report
from ..sources import files

#: The state store that states with an expiry need; and no batches without data, which would never end where time alone may expire a state.
CONFIG = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
CHOSEN = "author string, name string, text string, version long"


class _Best(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "rank int, name string, digest string, version long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        held = self.best.get() if self.best.exists() else None
        best, text = (tuple(held) if held else None), None
        for frame in rows:
            for rank, name, content, digest in frame[["rank", "name", "text", "digest"]].itertuples(index=False):
                if best is None or (rank, name) < best[:2] or (rank, name) == best[:2] and digest != best[2]:
                    best, text = (int(rank), name, digest, 0), content
        if best is not None and (held is None or best[:3] != tuple(held)[:3]):
            version = (held[3] if held else 0) + 1
            self.best.update((*best[:3], version))
            yield pd.DataFrame({"author": [key[0]], "name": [best[1]], "text": [text], "version": [version]})
        elif held is not None:
            self.best.update(tuple(held))  # heard of, so not forgotten

    def close(self) -> None:
        pass


def chosen(arriving: DataFrame, keep_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """(author, name, text, version) of the stream `arriving` (name, text): each file that becomes its author's best."""
    ranked = arriving.select(T.author_key(F.col("name")).alias("author"), "name", "text", F.array_position(F.lit(list(files.PRIORITY)), files.extension(F.col("name"))).cast("int").alias("rank"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return ranked.where("rank > 0").groupBy("author").transformWithStateInPandas(_Best(keep_ms), CHOSEN, "Update", "ProcessingTime")


def review(spark: SparkSession, incoming: str, results: str, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame], keep_ms: int = 30 * 24 * 3600 * 1000) -> None:
    """Parquet files of (name, text) in `incoming` are evaluated where they are their author's best; results go to `results`/batch=n, which a batch that comes again overwrites."""
    before = {c: spark.conf.get(c, None) for c in CONFIG}
    for c, value in CONFIG.items():
        spark.conf.set(c, value)
    try:

        def batch(rows: DataFrame, number: int) -> None:
            found = rows.persist()  # evaluated and versioned from one reading of the state
            told = evaluate(found.select("author", "text")).join(found.select("author", "name", "version"), "author")
            told.write.mode("overwrite").parquet(f"{results}/batch={number}")
            found.unpersist()

        stream = chosen(spark.readStream.schema("name string, text string").parquet(incoming), keep_ms)
        stream.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for c, value in before.items():
            if value is None:
                spark.conf.unset(c)
            else:
                spark.conf.set(c, value)


def latest(spark: SparkSession, results: str) -> DataFrame:
    """The last result of each author."""
    return report.last_of(spark.read.parquet(results), "author", "version")
