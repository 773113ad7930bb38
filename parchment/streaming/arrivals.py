"""Extension: the incremental review as a stream of arriving files.

Each micro-batch keeps the documents without a result, evaluates them and writes the results into a
folder of the batch's own, over what an earlier attempt at that batch left; so a batch that is
run again doubles nothing. `availableNow` takes what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental


def review(spark: SparkSession, incoming: str, schema: str, results: str, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> None:
    """Parquet files of documents in `incoming` become results, once each, in `results`/batch=n."""
    path = spark._jvm.org.apache.hadoop.fs.Path(results)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batch(rows: DataFrame, number: int) -> None:
        if there.exists(path) and any(s.isDirectory() for s in there.listStatus(path)):
            done = spark.read.option("basePath", results).parquet(results).where(F.col("batch") != number)
            rows = incremental.pending(rows, done, key)
        evaluate(rows.dropDuplicates([key])).write.mode("overwrite").parquet(f"{results}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(incoming)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
