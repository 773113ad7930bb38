"""Operator 1, suffix-array dedup: sparse suffix arrays.

A text is its sequence of lower-cased words. Of all its suffixes only those at minimiser
positions are retained: where the hash of the next `PREFIX` words is the least within some
stretch of `min_words` words. Equal stretches have equal minimisers, so any passage of
`min_words` words that occurs twice has a retained suffix at the same place in both.

1. The retained suffixes are sorted by their prefix over all documents and compared with their
   neighbours; those that differ from both are dropped.
2. From each remaining suffix the match is extended left and right to all stretches of
   `min_words` words that have it as minimiser. These are sorted and compared with their
   neighbours in turn, which leaves exactly the stretches that occur more than once.
3. Overlapping and adjoining stretches of a document merge into maximal repeated spans.

Both sorts are ranged by hash and then by document and place, so a passage that very many
documents share is split over tasks; only the rows at the ends of a task's range may need a
neighbour from another task, and those few rows are compared apart. A task keeps two batches. The
bounds of the ranges come from a bounded sample of texts (`SAMPLE`); they decide how even the
ranges are, never what is found.

Edge cases: null texts and texts of fewer than `min_words` words have no spans; a null doc_id is
carried; rows of equal id and text repeat each other and are reported once; rows of equal id (or none) but
other text are told apart by 23 bits of the text's hash; within a group of equal stretches the one of least
(doc_id, place) counts as first, nulls before all; an empty table gives no rows; only doc_id and
text are read. A passage may repeat within one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
PREFIX = 24
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
#: A place is the text's 23-bit hash and the word's number below it.
PLACE = 40
#: Texts, and bytes of them, from which the ranges' bounds are taken.
SAMPLE = 2000, 16 << 20


def words(text: str | None) -> np.ndarray:
    """A hash of each lower-cased word."""
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]), ">u8").astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n + 1, base, np.uint64)
    found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from differences of one prefix sum."""
    if len(x) < n:
        return x[:0]
    up = _powers(BASE, len(x))
    down = _powers(pow(BASE, -1, 1 << 64), len(x))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * down[:-1], dtype=np.uint64)))
    return _mixed((total[n:] - total[:-n]) * up[: len(x) - n + 1] ^ np.uint64(n))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def minimisers(prefix: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the retained suffixes, and the least prefix hash of each stretch."""
    least = _least(prefix, width)
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    return np.flatnonzero(~_least(~padded, width) == prefix), least


def part_of(bounds: np.ndarray, keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> pa.Array:
    """The range of each row (first key, id, place; nulls are the least); `bounds` is a sorted matrix of such rows."""
    rows = np.empty(len(keys), bounds.dtype)
    rows["k"], rows["i"], rows["p"] = keys.view(np.int64), ids, places
    first, last = (np.searchsorted(bounds["k"], rows["k"], side) for side in ("left", "right"))
    at = first.copy()
    for n in np.flatnonzero(first != last):  # keys that are a bound's: few, and hot ones
        at[n] = np.searchsorted(bounds, rows[n], "right")
    return pa.array(at.astype(np.int32))


BOUND = np.dtype([("k", np.int64), ("i", np.int64), ("p", np.int64)])


def cut(rows: list[np.ndarray], parts: int) -> np.ndarray:
    """The bounds of `parts` ranges that hold about as many of the rows each."""
    found = np.sort(np.concatenate([np.zeros(0, BOUND), *rows]))
    if len(found) < parts:
        found = np.sort(np.concatenate((found, np.array([(k, 0, 0) for k in np.linspace(-(2.0**63), 2.0**63 - 2048, parts + 1).astype(np.int64)[1:-1]], BOUND))))
    return found[np.arange(1, parts) * len(found) // parts]


def _known(doc_id: int | None) -> int:
    return -(1 << 63) if doc_id is None else doc_id


def suffixes_of(text: str | None, min_words: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's retained suffixes, and the words where they start."""
    x = words(text)
    if len(x) < min_words:
        return x[:0], np.zeros(0, np.int64)
    g = grams(x, prefix)
    at, _ = minimisers(g, min_words - prefix + 1)
    return g[at], at


def stretches_of(text: str | None, kept: np.ndarray, min_words: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the stretches whose minimiser is among `kept`: their hashes, their minimisers and the words where they start."""
    x = words(text)
    if len(x) < min_words:
        return x[:0], x[:0], np.zeros(0, np.int64)
    _, least = minimisers(grams(x, prefix), min_words - prefix + 1)
    at = np.flatnonzero(np.isin(least, kept))
    return grams(x, min_words)[at], least[at], at


def ranges(texts: DataFrame, parts: int, min_words: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds for the suffixes and for the stretches, from a bounded sample of texts.

    Which stretches will be compared the sample cannot tell; all count a little, and those that repeat within it fully.
    """
    sample = [(_known(r.doc_id), r.sig << PLACE, r.text) for r in common.bounded_rows(texts, "text", SAMPLE[0], texts.select("doc_id").count(), SAMPLE[1])]

    def rows(found: list[tuple[np.ndarray, int, np.ndarray]]) -> list[np.ndarray]:
        out = []
        for k, i, places in found:
            r = np.empty(len(k), BOUND)
            r["k"], r["i"], r["p"] = k.view(np.int64), i, places
            out.append(r)
        return out

    tails = [(*suffixes_of(t, min_words, prefix), i, sig) for i, sig, t in sample]
    first = rows([(h, i, at + sig) for h, at, i, sig in tails])
    second = []
    for (i, sig, t), (h, *_) in zip(sample, tails, strict=True):
        w, _, at = stretches_of(t, h, min_words, prefix)
        second += rows([(w, i, at + sig)])
    if second:
        joined = np.concatenate(second)
        _, back, n = np.unique(joined["k"], return_inverse=True, return_counts=True)
        again = n[back] > 1
        second = [joined[again], joined[~again][::16]]
    return cut(first, parts), cut(second, parts)


def _suffixes(batches: Iterator[pa.RecordBatch], bounds, min_words: int, prefix: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, places, hashes = [], [], []
        for doc_id, text, sig in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            h, at = suffixes_of(text, min_words, prefix)
            if len(at):
                ids += [doc_id] * len(at)
                places.append(at + (sig << PLACE))
                hashes.append(h)
        if ids:
            h, p = np.concatenate(hashes), np.concatenate(places)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(ids, pa.int64()), pa.array(p, pa.int64()), part_of(bounds.value, h, np.array([_known(i) for i in ids]), p)], ["h", "doc_id", "place", "part"])


def _stretches(batches: Iterator[pa.RecordBatch], bounds, min_words: int, prefix: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc_id, text, sig, kept in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
            w, h, at = stretches_of(text, kept.values.to_numpy().view(np.uint64), min_words, prefix)
            if len(at):
                p = at + (sig << PLACE)
                yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(h.view(np.int64)), pa.array([doc_id] * len(at), pa.int64()), pa.array(p), part_of(bounds.value, w, np.full(len(at), _known(doc_id)), p)], ["w", "h", "doc_id", "place", "part"])


def _compare(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows with `before` and `after` (does the neighbour have equal keys?) and `end` (is it a row at either end of the task's range?)."""

    def key(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(i).to_numpy() for i in range(keys)], axis=1)

    def marked(b: pa.RecordBatch, last: np.ndarray | None, following: np.ndarray | None) -> pa.RecordBatch:
        k = key(b)
        same = (k[1:] == k[:-1]).all(axis=1)
        before = np.concatenate(([last is not None and bool((last == k[0]).all())], same))
        after = np.concatenate((same, [following is not None and bool((following == k[-1]).all())]))
        end = np.zeros(len(k), bool)
        end[0] |= last is None
        end[-1] |= following is None
        keep = before | after | end
        out = pa.record_batch([*b.columns, pa.array(before), pa.array(after), pa.array(end)], [*b.schema.names, "before", "after", "end"])
        return out.filter(pa.array(keep))

    last, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield marked(held, last, key(b)[0])
            last = key(held)[-1]
        held = b
    if held is not None:
        yield marked(held, last, None)


def neighbours(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The rows of (keys..., doc_id, place, part) whose keys occur more than once, with `first` for the first of each.

    `part` numbers ranges of (first key, doc_id, place), so rows of equal keys lie in one range or in ranges that follow each other.
    """
    order = [*keys, "doc_id", "place"]
    ordered = rows.repartitionById(parts, "part").select(*order).sortWithinPartitions(*order)
    fields = ", ".join(f"{c} long" for c in order)
    marked = ordered.mapInArrow(partial(_compare, keys=len(keys)), f"{fields}, before boolean, after boolean, end boolean")
    # at most two rows of each task: their keys may go on in the next task's range
    ends = marked.where("end").groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "place")).alias("_least")).where("_n > 1")
    inner = marked.where("not end").select(*order, (~F.col("before")).alias("first"))
    outer = marked.where("end").join(ends, list(keys), "left").where("before or after or _n is not null")
    outer = outer.select(*order, (~F.col("before") & (F.col("_least").isNull() | (F.struct("doc_id", "place") == F.col("_least")))).alias("first"))
    return inner.unionByName(outer)


def _merged(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, places, later in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            at = np.unique(places.values.to_numpy()) & ((1 << PLACE) - 1)
            cut = np.flatnonzero(at[1:] > at[:-1] + min_words)
            starts, stops = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + min_words
            again = np.unique(later.values.to_numpy()) & ((1 << PLACE) - 1)
            covered = np.zeros(int(stops[-1]) + 1, np.int64)
            np.add.at(covered, again, 1)
            np.add.at(covered, again + min_words, -1)
            is_later = np.concatenate(([0], np.cumsum(np.cumsum(covered) > 0)))
            out += [(doc_id, a, z, z - a, is_later[z] - is_later[a]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)]
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start_word", "stop_word", "n_words", "n_later"])


SPANS = "doc_id long, start_word long, stop_word long, n_words long, n_later long"


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """SPANS: the maximal spans whose every stretch of `min_words` words occurs elsewhere too.

    start_word and stop_word (exclusive) number the white-space words; n_later is how many of the
    span's words lie in a stretch that occurred before, so those may go and no passage is lost.
    """
    if not 0 < prefix <= min_words:
        raise ValueError("the prefix is no longer than the passages")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").bitwiseAND((1 << 23) - 1).alias("sig"))
    first, second = map(spark.sparkContext.broadcast, ranges(texts, parts, min_words, prefix))
    suffixes = texts.mapInArrow(partial(_suffixes, bounds=first, min_words=min_words, prefix=prefix), "h long, doc_id long, place long, part int")
    # by text as well as id, so that rows without an id are no group
    kept = neighbours(suffixes, parts, "h").groupBy(F.col("doc_id").alias("_id"), F.shiftright("place", PLACE).alias("_sig")).agg(F.collect_set("h").alias("kept"))
    matched = texts.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sig") == F.col("_sig"))).select("doc_id", "text", "sig", "kept")
    stretches = matched.mapInArrow(partial(_stretches, bounds=second, min_words=min_words, prefix=prefix), "w long, h long, doc_id long, place long, part int")
    again = neighbours(stretches, parts, "w", "h").groupBy("doc_id", F.shiftright("place", PLACE).alias("text")).agg(F.collect_list("place").alias("places"), F.collect_list(F.when(~F.col("first"), F.col("place"))).alias("later"))
    return again.select("doc_id", "places", "later").mapInArrow(partial(_merged, min_words=min_words), SPANS)
