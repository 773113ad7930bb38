"""Incremental review: leave out what is done, and merge new results over cached ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import report


def pending(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The documents without a result; a failed result is a result."""
    return docs.join(done.select(key), key, "left_anti")


def merged(cached: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both, the new row where a key has two."""
    both = cached.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return report.last_of(both, key, "_new").drop("_new")
