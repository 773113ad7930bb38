"""Near copies by the real Jaccard similarity of 5-word shingle sets, exact for the threshold of 4/5.

Texts of equal shingle sets collapse first. Two sets of similarity 4/5 share at least 4/5 of either,
so in any fixed order of shingles they share one among the first n - ceil(4n/5) + 1 of each: those
are a set's keys. The order puts shingles of high counts last; the counts are kept in a table of
fixed size, which shared slots only overstate, so they decide what is compared, never what is found.

Operator 3 comes first: texts whose SimHash fingerprints, here of 5-word shingles, its Golay-code keys find within 4 bits are
compared by their whole sets, each with one of those. Beside them each set is compared with one that it shares bands of minima
with, as sets of similarity 4/5 nearly always do. Sets so linked share a mark, given while a set is still one row; the keys, of which a set
has many, are for what both miss.

Two alike sets of n and m shingles share not one key but many: with o = ceil(4(n + m)/9) common shingles, n - o of the first's keys at
most are none of the second's shingles, and of the set whose keys end first all others are keys of both. So each set counts how
many of its keys it shares with any sets of about a size; sizes of which that are too few are compared no more, and with
them most of what only shares a passage, or is a near copy edited too often.

Only one text of each set is read for that. Under each key one set, at first that with the largest part of its keys shared, is
compared with the others in star rounds, and sets known to be
linked are compared no more, so that a large group of copies stays linear. What is then still apart
under a key is joined mark by mark, and two marks that share enough keys become pairs of their sets, each pair once and
not under each of its keys. Rounds only mark sets by the one they were found linked with; whole
components are made once, of all links. Every link is verified on the whole sets.

Edge cases: words as in the fingerprints of operator 3; null and empty texts share the empty set;
with fewer than five words the whole sequence is the only shingle; the others as for
simhash.representatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
#: The threshold, as a fraction.
OVER, OF = 4, 5
SLOTS, BLOCKS = 1 << 20, 64
STARS, PAIRS_A_ROW = 4, 4
#: Bands of minima of a set, and the minima in one: sets of similarity 4/5 share one of eight bands in 98 of 100 cases, sets of 1/5 in one.
BANDS, MINIMA = 8, 4
#: Sets whose sizes are within such a ratio are of one class; alike sets are so many classes apart at most.
RATIO, APART = 1.016, 15
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_OF_MINIMA = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[bytes, int] = {}


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 50_000:
        _words.clear()
    for w in {w for w in words if w not in _words}:
        _words[w] = xxhash.xxh64_intdigest(w, simhash.SEED)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - size + 1, 1)
    mixed = np.full(n, min(len(words), size), np.uint64)
    for i in range(min(size, len(words))):
        x = hashes[i : i + n] * _MULTIPLIERS[i % 5] + mixed
        x = (x ^ x >> np.uint64(32)) * _MULTIPLIERS[3]
        mixed = x ^ x >> np.uint64(29)
    return np.unique(mixed)


def set_id(text: str | None) -> int:
    """An unsigned number of 64 bits for the text's shingle set."""
    return xxhash.xxh64_intdigest(shingles(text).tobytes(), simhash.SEED)


def bands(s: np.ndarray) -> np.ndarray:
    """A number for each band of a set; sets of similarity j share a band's with a chance of j ** MINIMA. The empty set has none."""
    if not len(s):
        return np.zeros(0, np.uint64)
    least = np.min([(s[at : at + 4096, None] * _OF_MINIMA).min(axis=0) for at in range(0, len(s), 4096)], axis=0)
    return (least.reshape(BANDS, MINIMA) * _MULTIPLIERS[:MINIMA]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MULTIPLIERS[4]


def keys_of(n: int) -> int:
    """How many of a set's first shingles are its keys."""
    return n - -(-OVER * n // OF) + 1 if n else 0


def _keys_of(n: str) -> Column:
    return F.expr(f"{n} - ceil({OVER} * {n} / {OF}) + 1")


def _texts(batches: Iterator[pa.RecordBatch], members: common.Members) -> Iterator[list[str | None]]:
    """The texts of (slot, text) rows that the filter lets through, some at a time."""
    for b in batches:
        texts = b.column(1).filter(pa.array(members.has(b.column(0).to_numpy()))).to_pylist()
        for at in range(0, len(texts), 200):
            yield texts[at : at + 200]


def _counts(rows: DataFrame, members: common.Members) -> np.ndarray:
    """For each slot of shingle hashes the number of sets in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for texts in _texts(batches, members):
            slots = np.concatenate([shingles(t) for t in texts]) % np.uint64(SLOTS) if texts else np.zeros(0, np.uint64)
            seen += np.bincount(slots.astype(np.int64), minlength=SLOTS)
        yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in seen.reshape(BLOCKS, -1)], pa.binary())], ["block", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in rows["counts"]], axis=0)
        return rows.iloc[:1].assign(counts=[total.tobytes()])

    found = rows.mapInArrow(run, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    out = np.zeros((BLOCKS, SLOTS // BLOCKS), np.int64)
    for r in found:
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def _keys(rows: DataFrame, members: common.Members, counts: np.ndarray) -> DataFrame:
    """(k, fp, n): the keys of each set, rarest shingles first."""
    shared = rows.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches, members):
            keys, ids, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for t in texts:
                s = shingles(t)
                k = keys_of(len(s))
                rank = shared.value[(s % np.uint64(SLOTS)).astype(np.int64)]
                keys.append(s[np.argsort(rank, kind="stable")[:k]])
                ids.append(np.full(k, xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED), np.uint64))
                sizes.append(np.full(k, len(s), np.int32))
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids).view(np.int64)), pa.array(np.concatenate(sizes))], ["k", "fp", "n"])

    return rows.mapInArrow(run, "k long, fp long, n int")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, s) of the sets whose rows have the ranks `wanted` (_rank), and of a few more."""
    members = common.Members(wanted, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches, members):
            sets = [shingles(t) for t in texts]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(fp, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "s"])

    return rows.mapInArrow(run, "fp long, s array<long>")


def _needed(n: str, m: str) -> str:
    """How many keys alike sets of n and m shingles share at least."""
    return f"(1 - ceil({OVER} * greatest({n}, {m}) / {OF}) + ceil({OVER} * ({n} + {m}) / {OVER + OF}))"


def _sized(n: str, m: str) -> str:
    """Whether sets of n and m shingles can be alike."""
    return f"{OF} * {n} >= {OVER} * {m} AND {OF} * {m} >= {OVER} * {n}"


def _bits(conditions: list[Column]) -> Column:
    return reduce(Column.bitwiseOR, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)])


def _shared_keys(rows: DataFrame, members: common.Members) -> DataFrame:
    """(k, fp, n, b, there): the keys of each set that other sets have too, its class of sizes, and a bit for each class around it of which there is another set."""
    one_key = Window.partitionBy("k")
    keyed = _keys(rows, members, _counts(rows, members)).repartition("k").dropDuplicates(["k", "fp"])
    keyed = keyed.withColumn("c", F.count("*").over(one_key)).where("c > 1").withColumn("b", F.expr(f"int(floor(ln(n) / ln({RATIO})))"))
    keyed = keyed.withColumns({"all": F.collect_set("b").over(one_key), "own": F.count("*").over(Window.partitionBy("k", "b"))})
    others = [F.array_contains("all", F.col("b") + i) if i else F.col("own") > 1 for i in range(-APART, APART + 1)]
    return keyed.select("k", "fp", "n", "b", _bits(others).alias("there"))


def _comparable(keyed: DataFrame) -> DataFrame:
    """(fp, near, w): the sets that share enough keys with some class of sizes, a bit for each such class, and the part of their keys that is shared."""
    shared = F.array(*[F.sum(F.expr(f"shiftright(there, {i}) & 1")) for i in range(2 * APART + 1)])
    counted = keyed.groupBy("fp", "n", "b").agg(F.count("*").alias("c"), shared.alias("shared"))
    low = f"greatest(floor(pow({RATIO}, b + i - {APART}) * (1 - 1e-9)), ceil({OVER} * n / {OF}))"
    high = f"least(ceil(pow({RATIO}, b + i - {APART - 1}) * (1 + 1e-9)), floor({OF} * n / {OVER}))"
    # of the sizes of a class the least or the greatest needs the fewest, as the number falls to both sides of n
    enough = f"shared[i] > 0 AND {low} <= {high} AND shared[i] >= least({_needed('n', low)}, {_needed('n', high)})"
    near = F.expr(f"aggregate(sequence(0, {2 * APART}), 0, (bits, i) -> bits | if({enough}, shiftleft(1, i), 0))")
    return counted.select("fp", near.alias("near"), (F.col("c") / _keys_of("n")).alias("w")).where("near <> 0")


def _mutual(x: str, y: str) -> str:
    """Whether either of two sets has the other's class among those that it shares enough keys with."""
    one = lambda u, v: f"shiftright({u}near, {v}b - {u}b + {APART}) & 1 = 1"
    return f"abs({x}b - {y}b) <= {APART} AND {one(x, y)} AND {one(y, x)}"


def by_fingerprint(rows: DataFrame, distinct: DataFrame, members: common.Members, banded: bool = False) -> DataFrame:
    """(u, v): sets of similarity 4/5 or more among those whose fingerprints operator 3 links, and if `banded` those that share bands.

    Of all that a fingerprint is linked with it is compared with the first in an order by hash, so that a large group stays linear.
    """
    printed = common.checkpoint(_printed(rows, members).dropDuplicates(["fp"]))
    first = printed.groupBy("f").agg(F.min("fp").alias("v"))
    same = printed.join(first, "f").where("fp <> v").select(F.col("v").alias("u"), F.col("fp").alias("v"))
    linked = simhash.links(first.select(F.col("f").alias("fp")))
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = both.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("a")).where(F.xxhash64("a") < F.xxhash64("b"))
    near = nearest.join(first.select(F.col("f").alias("a"), F.col("v").alias("u")), "a").join(first.withColumnRenamed("f", "b"), "b").select("u", "v")
    met = same.unionByName(near)
    if banded:
        met = met.unionByName(_by_bands(printed)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return _alike(rows, distinct, common.checkpoint(met))


def _by_bands(printed: DataFrame) -> DataFrame:
    """(u, v): each set with one that it shares a band with.

    Under each band one set, that with the most company in all its bands, meets the others; of those that a set
    meets so, it is paired with the one of most bands. So there is one pair a set at most, however large a group.
    """
    one_band = Window.partitionBy("g")
    shared = printed.select("fp", F.explode("bands").alias("g")).withColumn("c", F.count("*").over(one_band)).where("c > 1")
    order = F.struct((-F.col("w")).alias("w"), F.xxhash64("fp").alias("h"))
    starred = shared.withColumn("w", F.sum("c").over(Window.partitionBy("fp"))).withColumn("x", F.min_by(F.struct("fp", order.alias("order")), order).over(one_band))
    met = starred.where("fp <> x.fp").groupBy(F.col("x.fp").alias("u"), F.col("fp").alias("v")).agg(F.count("*").alias("c"), F.first("x.order").alias("order"))
    return met.groupBy("v").agg(F.min_by("u", F.struct(-F.col("c"), "order")).alias("u")).select("u", "v")


def _printed(rows: DataFrame, members: common.Members) -> DataFrame:
    """(fp, f, bands): the fingerprint of a text of each set, and the set's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches, members):
            sets = [shingles(t) for t in texts]
            columns = [[xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], [simhash.fingerprint(t, SHINGLE) for t in texts]]
            yield pa.record_batch([*[pa.array(np.array(x, np.uint64).view(np.int64)) for x in columns], pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "f", "bands"])

    return rows.mapInArrow(run, "fp long, f long, bands array<long>")


def links(ranked: DataFrame, distinct: DataFrame) -> DataFrame:
    """(u, v): pairs of sets of similarity 4/5 or more, enough to connect all that such pairs connect.

    `ranked` has _rank and text, `distinct` has fp and rep, the rank of a row of that set.
    """
    kept = common.Kept(ranked.sparkSession)
    rows = ranked.select(common.Members.slot("_rank").alias("i"), "text")
    members = common.Members(distinct.select("rep"), "rep")
    edges = by_fingerprint(rows, distinct, members, banded=True)
    keyed, keyed_path = kept.keep(_shared_keys(rows, members))
    own = ("k", "fp", "n", "b", "near", "w")
    sets = _comparable(keyed)
    marked = sets.join(_moves(distinct.select("fp", F.col("fp").alias("root")), edges, 0), "fp", "left").select("fp", "near", "w", F.coalesce("next", "fp").alias("root"))
    left, path, round_, more = keyed.join(common.checkpoint(marked), "fp"), keyed_path, 0, True
    one_key = Window.partitionBy("k")
    while True:
        # the keys under which sets are still apart; r roots, of which m sets have this row's; x is the set that the others are compared with
        order = F.struct((-F.col("w") if round_ % 2 == 0 else F.lit(0.0)).alias("w"), F.xxhash64("fp", F.lit(round_)).alias("h"))
        star = F.min_by(F.struct("fp", "n", "b", "near", "root", order.alias("order")), order).over(one_key)
        counted = left.repartition("k").withColumn("m", F.count("*").over(Window.partitionBy("k", "root"))).withColumns({"r": F.sum(1 / F.col("m")).over(one_key), "x": star}).where("r > 1.5")
        before, (left, path) = path, kept.keep(counted.select(*own, "root", ((F.col("r") - 1) / F.col("m")).alias("others"), *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("fp", "n", "b", "near", "root", "order")]))
        kept.drop(before)
        size, pairs = left.agg(F.count("*"), F.coalesce(F.sum("others"), F.lit(0)) / 2).first()  # rows, and pairs of roots under their keys
        if not size:
            return edges
        last = round_ == STARS or not more or pairs <= PAIRS_A_ROW * size
        if last:
            met = _apart(left)
        else:  # u is the set that many are compared with
            met = left.where(f"root <> x_root AND {_mutual('', 'x_')}").select(F.col("x_fp").alias("u"), F.col("fp").alias("v"), F.col("x_n").alias("n"), F.col("n").alias("m"), F.col("x_order").alias("order"))
            met = met.where(_sized("n", "m")).groupBy("u", "v").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("order").alias("order"))
            # a pair that is alike shares so many keys; a star round may see fewer, as it compares few, and loses nothing that the last does not find
            # one of the centres that a set meets, the first in the order by which they are chosen, so that a group has few
            met = met.where(f"c * 2 >= {_needed('n', 'm')}").groupBy("v").agg(F.min_by("u", "order").alias("u"))
        met, met_path = kept.keep(met.select("u", "v"))
        found = _alike(rows, distinct, met)
        edges = edges.unionByName(found)
        kept.drop(met_path)
        if last:
            return edges
        more = not found.isEmpty()
        # joined by set, as one mark may be that of many
        left = _remarked(left.select(*own, "root"), common.checkpoint(_moves(left.select("fp", "root").distinct(), found, round_)))
        round_ += 1


def _met_marks(left: DataFrame) -> DataFrame:
    """(x_root, y_root, c): marks of different sets that share c keys, enough for some of their sizes; there are as many rows under a key as pairs of marks, however many sets have one."""
    marks = left.groupBy("k", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    side = lambda s: marks.select("k", *[F.col(c).alias(f"{s}{c}") for c in ("root", "lo", "hi")])
    near = f"x_root < y_root AND {OF} * x_hi >= {OVER} * y_lo AND {OF} * y_hi >= {OVER} * x_lo"
    ends = [F.min("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"), F.min("y_lo").alias("y_lo"), F.max("y_hi").alias("y_hi")]
    # sized by compressed files of many columns, so too low
    met = side("x_").hint("merge").join(side("y_"), "k").where(near).groupBy("x_root", "y_root").agg(F.count("*").alias("c"), *ends)
    # _needed without its rounding, which is least where the sizes differ most
    least = lambda n, m: f"({OVER} * ({n} + {m}) / {OVER + OF} - {OVER} * greatest({n}, {m}) / {OF})"
    return met.where(f"c >= least({least('x_lo', 'y_hi')}, {least('x_hi', 'y_lo')}) - 1e-6").select("x_root", "y_root", "c")


def _apart(left: DataFrame) -> DataFrame:
    """(u, v): the pairs of sets of different marks that share as many keys as alike sets must."""
    sets = left.groupBy("fp", "n", "b", "near", "root").agg(F.collect_list("k").alias("keys"))
    side = lambda s: sets.select(*[F.col(c).alias(f"{s}{c}") for c in sets.columns])
    both = _met_marks(left).join(side("x_"), "x_root").join(side("y_"), "y_root")
    enough = f"size(array_intersect(x_keys, y_keys)) >= {_needed('x_n', 'y_n')}"
    return both.where(f"{_sized('x_n', 'y_n')} AND {_mutual('x_', 'y_')} AND {enough}").select(F.col("x_fp").alias("u"), F.col("y_fp").alias("v"))


def _alike(rows: DataFrame, distinct: DataFrame, met: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets are alike."""
    # as a union, whose size Spark counts in full, where it counts what an explode makes as one row each
    ids = common.checkpoint(met.select(F.col("u").alias("fp")).unionByName(met.select(F.col("v").alias("fp"))).distinct())
    kept = common.Kept(rows.sparkSession)
    sets, path = kept.keep(_sets(rows, distinct.join(ids, "fp").select(F.col("rep").alias("_rank"))).join(ids, "fp", "left_semi").dropDuplicates(["fp"]))
    first = sets.join(met.select(F.col("u").alias("fp")).distinct(), "fp", "left_semi").select(F.col("fp").alias("u"), F.col("s").alias("a"))
    both = met.join(first, "u").join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")
    counted = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("n"))
    found = common.checkpoint(counted.where(f"{OF} * i >= {OVER} * (n - i)").select("u", "v"))
    kept.drop(path)
    return found


def _moves(roots: DataFrame, found: DataFrame, round_: int) -> DataFrame:
    """(fp, next): for sets whose mark is linked with another mark the first mark, in an order by hash, within two links of theirs, so that a star gets one mark.

    All that share a mark are linked; not all that are linked need to share one.
    """
    of = lambda c: roots.select(F.col("fp").alias(c), F.col("root").alias(f"r_{c}"))
    pairs = found.join(of("u"), "u").join(of("v"), "v").where("r_u <> r_v").select("r_u", "r_v")
    both = common.checkpoint(pairs.unionByName(pairs.select(F.col("r_v").alias("r_u"), F.col("r_u").alias("r_v"))).distinct())
    order = lambda c: F.xxhash64(c, F.lit(round_))
    first = F.min_by("r_v", order("r_v"))
    near = both.groupBy("r_u").agg(first.alias("n")).select(F.col("r_u").alias("r_v"), F.when(order("n") < order("r_u"), F.col("n")).otherwise(F.col("r_u")).alias("near"))
    far = both.join(near, "r_v").groupBy(F.col("r_u").alias("root")).agg(F.min_by("near", order("near")).alias("next"))
    return roots.join(common.checkpoint(far), "root").select("fp", "next")


def _split(rows: DataFrame, members: common.Members) -> tuple[DataFrame, DataFrame]:
    """The rows whose fp the filter lets through, and the others, without a shuffle."""

    def part(passes: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.record_batch(b.columns[1:], b.schema.names[1:]).filter(pa.array(passes(b.column(0).to_numpy())))

        return rows.select(common.Members.slot("fp").alias("_slot"), *rows.columns).mapInArrow(run, rows.schema)

    return part(members.has), part(lambda slots: ~members.has(slots))


def _remarked(left: DataFrame, moves: DataFrame) -> DataFrame:
    """`left` with the next root of the sets that `moves` (fp, next) has; the rows of all others, which are most, are not joined."""
    moved, stay = _split(left, common.Members(moves, "fp"))
    joined = moved.join(moves, "fp", "left").withColumn("root", F.coalesce("next", "root"))
    return stay.unionByName(joined.select(*left.columns))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group that similarities of 4/5 connect, all columns, chosen as in simhash.representatives."""
    return simhash.one_of_each(docs, set_id, links)
