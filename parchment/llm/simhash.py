"""Operator 3, SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit i is 1 if more than half of the document's shingle hashes have
it set. Equal fingerprints collapse first. The 64 bits are cut into segments of 22, 21 and 21
bits, padded with zeros to the 24 bits of the extended Golay code. A word within 3 bits of a
codeword decodes to that one; any other lies 4 bits from exactly six, and gets all six. Two
words that differ in at most one bit thus always share a codeword.

Pigeonhole: if two fingerprints differ in at most 4 bits, either one segment is equal, or two
segments differ in just one bit each. So the keys of a fingerprint are its three segments
themselves and, for each two segments, the pairs of their codeword indices. Fingerprints that
share a key are compared exactly; the conditions let each pair through at its first kind of key
only. No pair within the limit is lost, and equal texts are never expanded into pairs.

Edge cases: null and empty texts have fingerprint zero, which links like any other; with fewer
than four words the whole sequence is the only shingle; ties (exactly half) give a 0 bit; a null
doc_id keeps its row and joins its component, whose smallest id ignores it; repeated rows stay;
an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
POLYNOMIAL = 0b101011100011
#: (lowest bit, width) of the segments
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and only the six white bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])] or [digest(joined, SEED)]), ">u8").astype(np.uint64)
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    ones = np.zeros((8, 8), np.int64)  # bit within a byte, byte
    for bit in range(8):
        # eight counters of a byte each add up to 255 hashes at once
        lanes = ((padded >> np.uint64(bit)) & np.uint64(0x0101010101010101)).reshape(-1, 255).sum(axis=1)
        ones[bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > n).T.reshape(-1)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, of: Callable[[str | None], int] = fingerprint) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([of(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Of 24-bit words: 11 bits of remainder of the upper 23 bits, and the parity of all."""
    rest = word >> 1
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ POLYNOMIAL << (bit - 11), rest)
    return rest << 1 | np.bitwise_count(word).astype(word.dtype) & 1


@cache
def leaders() -> np.ndarray:
    """For each syndrome the error patterns of least weight: one, six times over, or six of weight 4."""
    found = np.full((4096, 6), -1, np.int64)
    for weight in range(5):
        words = np.array([sum(1 << i for i in c) for c in combinations(range(24), weight)], np.int64)
        for s, e in zip(_syndrome(words).tolist(), words.tolist(), strict=True):
            if weight < 4:
                found[s] = e
            elif (free := np.flatnonzero(found[s] < 0)).size:
                found[s, free[0]] = e
    return found


def codewords(words: np.ndarray) -> np.ndarray:
    """The nearest codewords of 24-bit words as 12-bit indices, six a row; a single one is repeated."""
    return (words[:, None] ^ leaders()[_syndrome(words)]) >> 12


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, key) of each distinct key of unsigned fingerprints."""
    segments = [(fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near = [codewords(s) for s in segments]
    rows, kinds, found = [np.tile(np.arange(len(fp)), 3)], [np.repeat(np.arange(3), len(fp))], [np.concatenate(segments)]
    for kind, (a, b) in enumerate(PAIRS, 3):
        both = (near[a][:, :, None] << 12 | near[b][:, None, :]).reshape(len(fp), 36)
        both.sort(axis=1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        row, _ = np.nonzero(first)
        rows.append(row)
        kinds.append(np.full(len(row), kind))
        found.append(both[first])
    return np.concatenate(rows), np.concatenate(kinds), np.concatenate(found)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b (as signed numbers): pairs of the distinct fingerprints `fp` at most `max_bits` (up to 4) apart."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys are exact for at most 4 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                row, kind, key = keys(fp[at : at + 4096].view(np.uint64))
                yield pa.record_batch([pa.array(key << 3 | kind, pa.int64()), pa.array(fp[at : at + 4096][row], pa.int64())], ["k", "fp"])

    keyed = distinct.select("fp").mapInArrow(run, "k long, fp long")
    seg = [f"(shiftrightunsigned(x.fp ^ y.fp, {low}) & {(1 << width) - 1})" for low, width in SEGMENTS]
    one = [f"bit_count({s}) = 1" for s in seg]
    no = [f"{s} <> 0" for s in seg]
    exact = [" AND ".join([f"(x.k & 7) = {i}", f"{seg[i]} = 0", *no[:i]]) for i in range(3)]
    pairs = [f"(x.k & 7) = {i} AND {one[a]} AND {one[b]}" + "".join(f" AND NOT ({one[c]} AND {one[d]})" for c, d in PAIRS[: i - 3]) for i, (a, b) in enumerate(PAIRS, 3)]
    condition = f"x.k = y.k AND x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= {max_bits} AND (" + " OR ".join(f"({c})" for c in [*exact, *(f"{' AND '.join(no)} AND {p}" for p in pairs)]) + ")"
    # a fingerprint has dozens of keys, of which Spark's size check knows nothing: it would send what is many times its limit to all
    return keyed.alias("x").hint("merge").join(keyed.alias("y"), F.expr(condition)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _rooted(printed: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of (doc_id, fp); linked(fp, rep) gives their pairs."""
    distinct = common.checkpoint(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = graph.components(linked(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "root", "component_id")


def _within(max_bits: int) -> Callable[[DataFrame], DataFrame]:
    return lambda distinct: links(distinct, max_bits).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    printed = common.checkpoint(fingerprints(docs))
    group = _rooted(printed, _within(max_bits)).select("fp", "component_id")
    return printed.join(group, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, all columns: the one of the least doc_id, nulls last; of repeated rows any one."""
    return one_of_each(docs, fingerprint, lambda _, distinct: _within(max_bits)(distinct))


def one_of_each(docs: DataFrame, of: Callable[[str | None], int], linked: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """`representatives` for fingerprints `of` texts; linked(rows with _rank and text, distinct fp and rep) gives pairs (u, v).

    What stays is most of the table and is not shuffled: a filter of fixed size lets the rows pass that are certainly
    not to go, and only the others are joined with the exact list.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of `docs` clashes
    text, key = (own[docs.columns.index(c)] for c in ("text", "doc_id"))
    # a null id ranks after all others, by its text
    rank = F.coalesce(F.col(key).cast("long"), F.xxhash64(text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    ranked = docs.toDF(*own).withColumn("_rank", rank)
    texts = ranked.select("_rank", F.col(text).alias("text"))
    printed = common.checkpoint(fingerprints(texts.withColumnRenamed("_rank", "doc_id"), of))
    pairs = printed.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).join(_rooted(printed, lambda distinct: linked(texts, distinct)), "fp")
    chosen = pairs.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("fp", "doc_id", "n")).alias("c"))
    pairs = common.checkpoint(pairs.join(chosen, "root", "left").select(F.col("doc_id").alias("_rank"), F.col("fp").alias("_fp"), "n", (F.col("c.fp").isNotNull() & (F.col("c.fp") == F.col("fp")) & (F.col("c.doc_id") == F.col("doc_id"))).alias("stays")))
    doubtful = common.Members(pairs.where("not stays or n > 1").select("_rank"), "_rank")
    at = own.index(text)

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(~doubtful.has(b.columns[-1].to_numpy())))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = pa.record_batch(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(doubtful.has(b.columns[-1].to_numpy())))
            fp = np.array([of(t) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([*b.columns, pa.array(fp, pa.int64())], [*b.schema.names, "_fp"])

    slotted = ranked.withColumn("_slot", common.Members.slot("_rank"))
    sure = slotted.mapInArrow(certain, ranked.schema).select(*own)
    rest = slotted.mapInArrow(others, T.StructType([*ranked.schema.fields, T.StructField("_fp", T.LongType())]))
    # of equal rows that stay one is kept
    checked = rest.join(pairs.where("stays").select("_rank", "_fp"), ["_rank", "_fp"], "left_semi").dropDuplicates(["_rank", "_fp"])
    return sure.unionByName(checked.select(*own)).toDF(*docs.columns)
