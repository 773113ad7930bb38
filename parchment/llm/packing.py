"""Operator 8, packing: lexical retrieval packing.

Each document becomes token ids and one end id. Whole windows of it are sequences of their own; its
tail, shorter than a window, is packed with others. Tails are put in an order by content: first by
the leaf of a tree of splits, fitted on a bounded sample of weighted term vectors (`sample_tails`),
then by the least hash of their 4-token runs, so that copies lie side by side. Each `shard_docs`
tails that follow each other are a shard. A shard holds an inverted index of its tails with BM25
weights, whose document frequencies and mean length are those of all tails. In turn the first
unused tail seeds a window, the index returns its unused neighbours by score, and they fill the
window greedily; the last is cut, and its rest seeds the next window. Tails without a common token
come last, in order. Only the last window of a shard can be short.

Within a shard retrieval is exact. Neighbours in other shards are not seen: that is what the order
by content is for. A hot leaf, or very many copies, are cut into as many shards as they fill.

The frequencies that go to all executors are one number per token id of the vocabulary, which
bounds them. A task reads its part of the order in shards and holds one of them at a time.

Edge cases: a null text counts as empty, and an empty text is the end id alone; a null doc_id is
carried; equal scores go by row order; repeated rows are packed each; an empty table gives an
empty table; only doc_id and text are read, so other columns never clash. A text is cut nowhere
before it is tokenised.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
END = 0
K1, B = 1.2, 0.75
#: Fixed value: the id and the text of the vocabulary's special token.
SPECIAL = {"<|endoftext|>": 50256}
IDS = 1 << 16
SPAN = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, term int, n long"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Length of the term vectors, depth of the tree, tokens in a run.
VECTOR, DEPTH, RUN = 256, 6, 4


class Encoder:
    """The byte-level BPE of a file of base64 pieces and ranks; its ids are those of the tokenizer file of the same vocabulary, four times as fast."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max([*ranks.values(), *SPECIAL.values()]) >= IDS:
            raise ValueError("ids need more than 16 bits")
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype("<u2")


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _distinct(ids: np.ndarray) -> np.ndarray:
    ids = np.sort(ids, kind="stable")
    return ids[np.concatenate(([True], ids[1:] != ids[:-1]))]


def tokenize(docs: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """Rows of SPAN: pieces of whole windows, tails with their ids, and how many tails have a token id (term, n)."""
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SPAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).ids
        seen = np.zeros(IDS, np.int64)
        end = np.array([END], "<u2")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encode(text or ""), end))
                n = len(ids)
                whole = n // window * window
                if whole:
                    wide = ids[:whole].astype("<u4").tobytes()
                    rows += [(doc_id, at, window, zlib.crc32(wide[4 * at : 4 * (at + window)]), n, None, None, None) for at in range(0, whole, window)]
                if whole < n:
                    tail = ids[whole:]
                    seen[_distinct(tail)] += 1
                    rows.append((doc_id, whole, n - whole, 0, n, tail.tobytes(), None, None))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        term = np.flatnonzero(seen)
        none = [None] * len(term)
        yield pa.record_batch([pa.array(c, k) for c, k in zip([none] * 6 + [term, seen[term]], kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPAN)


@cache
def _hashing() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.integers(0, VECTOR, IDS), rng.choice([-1.0, 1.0], IDS)


def vectors(tails: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The tails' weighted terms, hashed with signs to VECTOR places, of unit length."""
    place, sign = _hashing()
    out = np.zeros((len(tails), VECTOR), np.float32)
    for i, t in enumerate(tails):
        t = np.sort(t, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        term = t[at]
        out[i] = np.bincount(place[term], idf[term] * (1 + np.log(np.diff(np.append(at, len(t))))) * sign[term], VECTOR)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def grow(x: np.ndarray, depth: int = DEPTH, least: int = 40):
    """A tree of splits in two (direction, edge, lower, upper), each by two means that start at the widest direction."""
    if not depth or len(x) < least:
        return None
    centred = x - x.mean(axis=0)
    upper = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1] > 0
    for _ in range(12):
        if upper.all() or not upper.any():
            return None
        a, b = x[~upper].mean(axis=0), x[upper].mean(axis=0)
        direction, edge = b - a, (b @ b - a @ a) / 2
        moved = x @ direction > edge
        if (moved == upper).all():
            break
        upper = moved
    if upper.all() or not upper.any():
        return None
    return direction, edge, grow(x[~upper], depth - 1, least), grow(x[upper], depth - 1, least)


def leaves(tree, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Each vector's leaf; neighbouring numbers lie in neighbouring branches."""
    found = np.zeros(len(x), np.int64)

    def go(node, rows: np.ndarray, left: int, number: int) -> None:
        if node is None or not len(rows):
            found[rows] = number << left
            return
        upper = x[rows] @ node[0] > node[1]
        go(node[2], rows[~upper], left - 1, number << 1)
        go(node[3], rows[upper], left - 1, number << 1 | 1)

    go(tree, np.arange(len(x)), depth, 0)
    return found


def least_run(tail: np.ndarray, size: int = RUN) -> int:
    """The least hash of the tail's runs of tokens, below 2**62."""
    x = tail.astype(np.uint64)
    n = max(len(x) - size + 1, 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(size, len(x))):
        mixed = (mixed + x[i : i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return int(mixed.min() >> np.uint64(2))


class Index:
    """An inverted index of tails with BM25 weights; terms that many tails have are held as a matrix."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, common_share: float = 0.1):
        n = self.n = len(tails)
        size = np.array([len(t) for t in tails])
        both = np.sort(np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(16), size) | np.concatenate(tails).astype(np.uint64))
        at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        tf = np.diff(np.append(at, len(both)))
        term, tail = (both[at] & np.uint64(0xFFFF)).astype(np.int64), (both[at] >> np.uint64(16)).astype(np.int64)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[tail] / mean))).astype(np.float32)
        held = np.bincount(term, minlength=len(idf))
        wide = held > common_share * n
        column = np.cumsum(wide) - 1
        dense = wide[term]
        there = np.zeros((n, int(wide.sum())), np.float32)
        weights = np.zeros_like(there)
        there[tail[dense], column[term[dense]]] = 1
        weights[tail[dense], column[term[dense]]] = weight[dense]
        self.dense = there @ weights.T  # seed x tail
        term, tail, weight = term[~dense], tail[~dense], weight[~dense]
        self.own = np.searchsorted(tail, np.arange(n + 1))
        self.terms = term
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.postings, self.weights = tail[order], weight[order]
        self.edges = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(idf)))))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every tail for the seed's distinct terms."""
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        first, last = self.edges[terms], self.edges[terms + 1]
        size = last - first
        total = int(size.sum())
        if not total:
            return self.dense[seed].copy()
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(total)
        return self.dense[seed] + np.bincount(self.postings[at], self.weights[at], self.n)


def fill(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (tail, start in it, length), each full but the last."""
    index = Index(tails, idf, mean)
    n = len(tails)
    used = np.zeros(n, bool)
    windows, now, room = [], [], window
    first = 0

    def place(t: int, at: int = 0) -> int:
        """Put as much of the tail as fits; where the rest starts, or 0 if there is none."""
        nonlocal now, room
        used[t] = True
        take = min(room, len(tails[t]) - at)
        now.append((t, at, take))
        room -= take
        if not room:
            windows.append(now)
            now, room = [], window
        return at + take if at + take < len(tails[t]) else 0

    rest = (0, 0)
    while True:
        if rest[1]:
            seed = rest[0]
            left = place(*rest)
        else:
            while first < n and used[first]:
                first += 1
            if first == n:
                break
            seed = first
            left = place(seed)
        rest = (seed, left)
        if left or not now:  # the seed itself filled the window
            continue
        score = index.scores(seed)
        score[used] = -1
        while now:
            t = int(score.argmax())
            if score[t] < 0:
                break  # all are placed
            score[t] = -1
            rest = (t, place(t))
    if now:
        windows.append(now)
    return windows


def _placed(rows: list[tuple], idf: np.ndarray, mean: float, window: int, sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a shard's tails (doc_id, start, doc_tokens, ids), numbered from `sequence` on, and the next free number."""
    tails = [np.frombuffer(r[3], "<u2") for r in rows]
    windows = fill(tails, idf, mean, window)
    out = []
    for number, pieces in enumerate(windows, sequence):
        offset = 0
        for t, at, n in pieces:
            doc_id, start, total, _ = rows[t]
            out.append((doc_id, start + at, n, zlib.crc32(tails[t][at : at + n].astype("<u4").tobytes()), total, number, offset))
            offset += n
    names = [c.split()[0] for c in PIECE.split(", ")]
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names), sequence + len(windows)


def statistics(spans: DataFrame) -> tuple[np.ndarray, float, int]:
    """The idf by token id, the mean length and the number of the tails."""
    seen = np.zeros(IDS)
    for r in spans.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # as many rows as the vocabulary has
        seen[r.term] = r.n
    count = spans.where("ids is not null").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return np.log(1 + (count.n - seen + 0.5) / (seen + 0.5)).astype(np.float32), float(count.mean or 1), count.n


def ordered(spans: DataFrame, idf: np.ndarray, tails: int, sample_tails: int = 6000) -> DataFrame:
    """(leaf, least, doc_id, start, doc_tokens, ids) of the tails."""
    spark = spans.sparkSession
    loose = spans.where("ids is not null")
    sample = common.bounded_rows(loose.select("doc_id", "start", "ids"), "ids", sample_tails, tails)
    tree = spark.sparkContext.broadcast((grow(vectors([np.frombuffer(r.ids, "<u2") for r in sample], idf)) if sample else None, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, weights = tree.value
        for b in batches:
            own = [np.frombuffer(x, "<u2") for x in b.column(3).to_pylist()]
            if own:
                yield pa.record_batch([pa.array(leaves(fitted, vectors(own, weights))), pa.array([least_run(t) for t in own], pa.int64()), *b.columns], ["leaf", "least", *b.schema.names])

    return loose.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, "leaf long, least long, doc_id long, start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, shard_docs: int = 2000) -> DataFrame:
    """The pieces of all documents, as PIECE."""
    spans = common.checkpoint(tokenize(docs, path, pattern, window))
    idf, mean, count = statistics(spans)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held = TaskContext.get().partitionId() << 33, []
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(held) >= shard_docs:
                found, sequence = _placed(held[:shard_docs], shared.value, mean, window, sequence)
                yield found
                held = held[shard_docs:]
        if held:
            yield _placed(held, shared.value, mean, window, sequence)[0]

    key = ["leaf", "least", "doc_id", "start"]
    # the exchange reads its input twice, the first time for the bounds of its ranges
    dealt = common.checkpoint(ordered(spans, idf, count)).repartitionByRange(*key).sortWithinPartitions(*key)
    tails = dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(shards, PIECE)
    whole = spans.where("term is null and ids is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(tails)
