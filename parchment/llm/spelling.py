"""Operator 13, spelling variants: forward and reversed dictionaries, shared-prefix and shared-suffix blocks.

Words are maximal runs of `[A-Za-zÀ-ÿ]`, with A-Z lower-cased. Before they are counted, one run in
`noise` (by a crc32 of document and run) loses a letter; `noise` None leaves all as they are. Two words
are near if one inserted, deleted or replaced letter turns one into the other.

One edit lies either in the first or in the second half of the shorter word and leaves the other half
intact. So words of one length (a replaced letter), and words of a length and the next (an inserted one),
are blocked by their first half (the forward dictionary) and by their last half (the reversed one), sorted
by that key and scanned. A block of more than `limit` words is subdivided: the edit lies in either half of
what is left open, so the words get two longer keys each, until a block is small or only one place is
open. With one place open a block holds no more words than there are letters, 90, so nothing is ever
cut. Every pair of a block is verified.

Bounds: texts are read once, in pieces; what is shuffled is a count per word and task, and then the
vocabulary, six short keys a word. Edge cases: a null text has no words; a null doc_id counts as an empty
one; repeated rows count as often as they are there; ties go to the least word in code-point order;
an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The letters, the shortest words, how often they occur at least, how much more often a form does, one run in how many is noisy.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
SHORTEST, OFTEN, TIMES, NOISE = 6, 5, 5, 199
LIMIT = 128
HELD = 200_000  # words that a task counts before it passes them on


def runs(text: str) -> Counter:
    """How often each run of letters occurs, A-Z lower-cased."""
    found: Counter = Counter()
    for piece in common.pieces(text, GAP):
        found.update(RUN.findall(piece.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    return found


def noisy(key: str, run: str, noise: int | None) -> str:
    """`run` without the letter that its hash names, if the hash is a multiple of `noise`."""
    if not noise or (h := zlib.crc32(f"{key}:{run}".encode())) % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int | None = NOISE, shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """(word, n) of the words of at least `shortest` letters that occur at least `often` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for r, n in runs(t or "").items():
                    if len(r) >= shortest:  # a letter less makes no word longer
                        w = noisy(k or "", r, noise)
                        if len(w) >= shortest:
                            seen[w] += n
                if len(seen) > HELD:
                    yield told()
                    seen.clear()
        yield told()

    found = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _keyed(rows: DataFrame) -> DataFrame:
    """With `k`, what the edit leaves of a word if it lies in the open places [lo, hi) of the shorter word of length m.

    A replaced letter is one of the places; an inserted one stands before place lo to hi - 1, so of the
    shorter word one letter more is left.
    """
    left = F.expr("concat_ws(' ', swap, m, lo, hi, substring(word, 1, lo), substring(word, hi + if(swap or length(word) > m, 1, 0), length(word)))")
    return rows.withColumn("k", left)


def near(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): each pair of near words once, the shorter word or the one that sorts first as a."""
    kinds = F.array(
        F.struct(F.lit(True).alias("swap"), F.length("word").alias("m")),
        F.struct(F.lit(False).alias("swap"), F.length("word").alias("m")),
        F.struct(F.lit(False).alias("swap"), (F.length("word") - 1).alias("m")),
    )
    rows = words.select("word", F.explode(kinds).alias("kind")).select("word", "kind.swap", "kind.m").withColumns({"lo": F.lit(0), "hi": F.col("m") + F.when(F.col("swap"), 0).otherwise(1)})
    found: DataFrame | None = None
    while True:
        # the edit lies in one half of the open places or the other
        halves = F.expr("if(hi - lo < 2, array(struct(lo, hi)), array(struct(lo, (lo + hi) div 2 as hi), struct((lo + hi) div 2 as lo, hi)))")
        rows = _keyed(rows.withColumn("half", F.explode(halves)).select("word", "swap", "m", F.col("half.lo").cast("int").alias("lo"), F.col("half.hi").cast("int").alias("hi")))
        sizes = rows.groupBy("k").agg(F.count("*").alias("c"), F.max("hi").alias("_h"), F.max("lo").alias("_l")).where("c > 1")
        rows = common.checkpoint(rows.join(sizes.select("k", (F.col("c") > limit).alias("large") & (F.col("_h") - F.col("_l") > 1)).toDF("k", "large"), "k"))
        small = rows.where("not large").select("k", "word", "swap", "m")
        x, y = small.alias("x"), small.alias("y")
        ordered = F.expr("x.k = y.k AND if(x.swap, x.word < y.word, length(x.word) < length(y.word)) AND levenshtein(x.word, y.word, 1) = 1")
        pairs = common.checkpoint(x.join(y, ordered).select(F.col("x.word").alias("a"), F.col("y.word").alias("b")).distinct())
        found = pairs if found is None else found.unionByName(pairs)
        rows = rows.where("large").select("word", "swap", "m", "lo", "hi")
        if rows.isEmpty():
            return found.distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n).

    A word's form is its most frequent near word, if that is `times` as frequent; root is where the forms lead to.
    """
    words = common.checkpoint(words)
    pairs = near(words)
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    valued = ways.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = valued.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    found = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False)))
    formed = common.checkpoint(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best.b")).alias("form"), F.when(F.col("has"), -F.col("best.m")).alias("form_n")))
    roots = common.checkpoint(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each time twice as far; a form is always more frequent, so there is no circle
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.checkpoint(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
