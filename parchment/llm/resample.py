"""Operator 12, importance resampling: documents drawn as if from the distribution of a target corpus.

Features are runs of 1 to `longest` words, hashed into `buckets`. A bucket's gain tells how much more of
the target's features fall into it than of the documents'; a document's weight is the mean gain of its
features, looked up in an array. With noise of a Gumbel distribution added (by a hash of the id), the
highest scores are a draw without replacement in proportion to the exponential of the weights.

The highest are found without a sort of all: scores are whole numbers, so an exact histogram of them,
summed from above, tells how many lie above each score, and with that the cutoff. Only the documents at
or above it are numbered, within each score by doc_id.

Bounds: what leaves a task are `buckets` counts; gains are an array of that size; scores are sums of a
bounded gain and bounded noise, so the histogram has at most some hundred thousand rows at any size.
Texts are read in pieces, twice. Edge cases: null and empty texts have no feature, weight 0 and are
never drawn; a null doc_id counts as the text `null`, and first among ties; repeated rows get
consecutive ranks; an empty target or table of documents leaves gains by the other's counts; only
doc_id and text are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 10, 2024
#: Words are runs of a-z, 0-9 and everything beyond ASCII, seen as UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
UNIT = 1000
HELD = 100_000  # features whose bucket is held
BLOCK = 256  # scores whose counts are summed together
_buckets: dict[tuple[bytes, int], int] = {}


def features(text: str | None, longest: int = 1) -> Counter:
    """How often each run of 1 to `longest` words occurs in the whole text."""
    found: Counter = Counter()
    before: list[bytes] = []
    for piece in common.pieces((text or "").encode("utf-8", "surrogatepass").lower(), GAP):
        words = WORD.findall(piece)
        found.update(words)
        if longest > 1:
            words = before + words
            for n in range(2, longest + 1):
                # those that end in this piece
                found.update(b" ".join(words[i - n + 1 : i + 1]) for i in range(max(n - 1, len(before)), len(words)))
            before = words[len(words) - longest + 1 :] if len(words) >= longest else words
    return found


def bucket(feature: bytes, buckets: int) -> int:
    at = _buckets.get((feature, buckets))
    if at is None:
        if len(_buckets) >= HELD:
            _buckets.clear()
        at = _buckets[feature, buckets] = zlib.crc32(feature) % buckets
    return at


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1, text: str = "text") -> np.ndarray:
    """How many features of all `texts` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                found = features(t, longest)
                np.add.at(seen, [bucket(f, buckets) for f in found], np.fromiter(found.values(), np.int64, len(found)))
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(seen[at])], ["bucket", "n"])

    found = texts.select(F.col(text).alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """In thousandths and rounded down, the logarithm of each bucket's share of the target by its share of the source, one count added to all."""
    k, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(UNIT * math.log((t + 1.0) * (all_s + k) / ((s + 1.0) * (all_t + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight): the mean gain of each document's features, rounded down."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            n, weight = [], []
            for t in b.column(1).to_pylist():
                found = features(t, longest)
                count = np.fromiter(found.values(), np.int64, len(found))
                at = np.fromiter((bucket(f, len(gain)) for f in found), np.int64, len(found))
                n.append(int(count.sum()))
                weight.append(int(gain[at] @ count) // n[-1] if found else 0)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_features", "weight"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, by a hash of the id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.ln(-F.ln((h + 0.5) / float(1 << 32)))).cast("long")


def ranks(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """`scored` (doc_id, n_features, weight, score) with rank: 1, 2, 3 ... from the highest score for the `percent` of the eligible rows that are drawn, else null."""
    columns = scored.columns
    marked = scored.withColumn("_in", eligible)
    block = F.floor(F.col("score") / BLOCK)
    hist = common.checkpoint(marked.where("_in").groupBy("score").agg(F.count("*").alias("n")).withColumn("block", block))
    draw = percent * (hist.agg(F.sum("n")).first()[0] or 0) // 100
    upward = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = hist.groupBy("block").agg(F.sum("n").alias("n")).select("block", upward(Window.orderBy(F.desc("block"))).alias("above"))  # some hundred rows
    offsets = hist.join(F.broadcast(blocks), "block").select("score", (F.col("above") + upward(Window.partitionBy("block").orderBy(F.desc("score")))).alias("above")).where(F.col("above") < draw)
    # a row per score at most: their number is bounded by the range of scores
    placed = marked.join(F.broadcast(offsets.withColumn("_in", F.lit(True))), ["score", "_in"], "left")
    # repeated rows go as one with their number, so that none of them makes a group large
    same = placed.where("above is not null").groupBy(*columns, "above").agg(F.count("*").alias("n"))
    started = same.withColumn("before", F.col("above") + upward(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")))
    runs = started.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1024))))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("run") * 1024 + 1, F.least(F.col("n"), (F.col("run") + 1) * 1024))))
    rank = F.col("before") + F.col("i")
    drawn = each.select(*columns, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(placed.where("above is null").select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    `docs` has doc_id and text, `target` has text. `least` is the number of words of a document that may be drawn.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = common.checkpoint(weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    # of w words there are w - n + 1 runs of n
    features = least + sum(max(least - n + 1, 0) for n in range(2, longest + 1))
    return ranks(scored, F.col("n_features") >= features, percent)
