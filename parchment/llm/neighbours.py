"""Operator 11, embedding near-dedup by NN-descent: the links of cosine `least` or more, counted per vector.

Equal vectors of a label are one, with a count. Vectors within half of the threshold's angle of a pivot
are one ball: all of them are linked, so they need no edges among each other. Pivots are found by voting:
under a hash of signs of projections, fine ones first, a vector goes over to the pivot that most of its
bucket has, if that is near enough. So a group of near copies is a handful of balls, however large it is.

The balls' pivots, the nodes, get lists of `lists` neighbours from sorted hash codes (windows of each of some
orders), which then meet in rounds: the neighbours of a node, its own and those that list it, are compared
with each other, as far as one of them is new there; the better ones enter the lists. A node that many list
has them split into groups of bounded size. A list is saturated if its last entry may still hold a link;
then it is doubled and the rounds go on. They end once a round brings hardly any edge that may hold a link.
An audit compares some nodes with all and measures the recall; below `recall` more orders and rounds follow.

Edges between nodes bound the angles of their members by the balls' radii; what they leave open is
compared with the other pivot, and then with its members in blocks, in double precision. Only counts come
out of that, never all pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a
label, have no links and are their own component; vectors of unlike lengths are not compared; repeated rows count as several vectors;
a null id never names a component unless all of its ids are null, and is never kept; an empty table gives
an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common, graph

LEAST = 0.93
LISTS, ORDERS, WINDOW, GROUP = 10, 4, 24, 64
#: Pivots are voted for under hashes of so many bits more than tell the vectors apart, and then of ever so many bits fewer.
FINEST, STEP = 6, 4
AUDITED, RECALL, PASSES, STILL = 1024, 0.98, 5, 0.002
PAGE = 512
#: What rounding may change in an angle, of double and of single precision.
FINE, COARSE = 1e-7, 1e-3


def unit(values: np.ndarray) -> bytes | None:
    """The vector scaled to length one; None if it has no direction."""
    if not len(values) or not np.isfinite(values).all():
        return None
    top = np.abs(values).max()
    if top == 0:
        return None
    x = values / top
    return (x / math.sqrt(x @ x)).tobytes()


def _units(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, g, d, v): the label and length, a digest of both and the direction, and the direction; null where a vector has no links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1)
            values = at.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ends, there = at.offsets.to_numpy(), at.is_valid().to_numpy(zero_copy_only=False)
            v = [unit(values[i:j]) if ok else None for i, j, ok in zip(ends[:-1], ends[1:], there, strict=True)]
            g = [None if x is None or y is None else f"{len(x)}:{y}" for x, y in zip(v, b.column(2).to_pylist(), strict=True)]
            v = [x if y is not None else None for x, y in zip(v, g, strict=True)]
            d = [hashlib.blake2b(y.encode() + x, digest_size=16).digest() if y is not None else None for x, y in zip(v, g, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(g, pa.string()), pa.array(d, pa.binary()), pa.array(v, pa.binary())], ["vec_id", "g", "d", "v"])

    return rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"), F.col(label).cast("string").alias("l")).mapInArrow(run, "vec_id long, g string, d binary, v binary")


def _by_length(*columns: list[bytes], kind: type = np.float64) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(places, a matrix of each column) for the rows of each length."""
    lengths = np.array([len(x) for x in columns[0]])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, [np.frombuffer(b"".join([c[i] for i in at]), kind).reshape(len(at), -1) for c in columns]


def _dots(a: list[bytes], b: list[bytes]) -> np.ndarray:
    out = np.zeros(len(a))
    for at, (x, y) in _by_length(a, b):
        out[at] = np.einsum("ij,ij->i", x, y)
    return out


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def _codes(v: list[bytes], seed: int, bits: int, kind: type) -> np.ndarray:
    """On which sides of `bits` random planes each vector lies."""
    out = np.zeros(len(v), np.int64)
    for at, (x,) in _by_length(v, kind=kind):
        planes = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], bits)).astype(kind)
        out[at] = (x @ planes > 0) @ (1 << np.arange(bits - 1, -1, -1))
    return out


def _coded(rows: DataFrame, seed: int, bits: int, kind: type = np.float64) -> DataFrame:
    """`rows` with the code of their vector v."""
    at = rows.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(_codes(b.column(at).to_pylist(), seed, bits, kind))], [*b.schema.names, "code"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, ("code", "long")]))


def _balls(distinct: DataFrame, total: int, radius: float) -> DataFrame:
    """(id, pivot, r) of each of `distinct` (id, g, v): a vector at most `radius` away, and the angle."""
    state = distinct.select("id", "g", "v", F.col("id").alias("pivot"), F.lit(0.0).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, g, v, pivot, r, other, w = b.columns
            angle = _angles(_dots(v.to_pylist(), [x or y for x, y in zip(w.to_pylist(), v.to_pylist(), strict=True)]))
            moved = (angle <= radius) & w.is_valid().to_numpy(zero_copy_only=False)
            yield pa.record_batch([ids, g, v, pa.array(np.where(moved, other.to_numpy(zero_copy_only=False), pivot.to_numpy()).astype(np.int64)), pa.array(np.where(moved, angle, r.to_numpy()))], ["id", "g", "v", "pivot", "r"])

    for n, bits in enumerate(range(min(total.bit_length() + FINEST, 60), 3, -STEP)):
        coded = _coded(state, 1000 + n, bits)
        votes = coded.groupBy("g", "code", "pivot").agg(F.count("*").alias("c")).groupBy("g", "code").agg(F.max(F.struct("c", F.xxhash64("pivot"), "pivot")).alias("m")).select("g", "code", F.col("m.pivot").alias("other"))
        asked = coded.join(votes, ["g", "code"]).withColumn("other", F.when(F.col("other") != F.col("pivot"), F.col("other")))
        vectors = distinct.select(F.col("id").alias("other"), F.col("v").alias("w"))
        met = asked.where("other is not null").join(vectors, "other").select("id", "g", "v", "pivot", "r", "other", "w").mapInArrow(run, "id long, g string, v binary, pivot long, r double")
        state = common.checkpoint(asked.where("other is null").select("id", "g", "v", "pivot", "r").unionByName(met))
    return state


def _windows(nodes: DataFrame, seed: int, lists: int) -> DataFrame:
    """(id, nbr, cos): the best of each node's neighbours in the order of its code, those in other partitions left out."""

    def found(ids: np.ndarray, g: np.ndarray, v: list[bytes], start: int, end: int) -> Iterator[pa.RecordBatch]:
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
        for lo, hi in itertools.pairwise(cuts):
            n, wide = hi - lo, min(WINDOW, hi - lo - 1)
            if wide < 1 or hi <= start or lo >= end:
                continue
            x = np.frombuffer(b"".join(v[lo:hi]), np.float32).reshape(n, -1)
            cos = np.full((n, 2 * wide), -3, np.float32)
            for d in range(1, wide + 1):
                cos[: n - d, d - 1] = cos[d:, wide + d - 1] = np.einsum("ij,ij->i", x[:-d], x[d:])
            step = np.concatenate([np.arange(1, wide + 1), -np.arange(1, wide + 1)])
            rows = np.arange(max(start - lo, 0), min(end - lo, n))
            best = np.argsort(-cos[rows], axis=1)[:, :lists]
            value = np.take_along_axis(cos[rows], best, 1)
            row, col = np.nonzero(value > -2)
            at = rows[row]
            yield pa.record_batch([pa.array(ids[lo + at]), pa.array(ids[lo + at + step[best[row, col]]]), pa.array(value[row, col].astype(np.float64))], ["id", "nbr", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, g, v, done = np.zeros(0, np.int64), np.zeros(0, object), [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                ids, g = np.concatenate([ids, b.column(0).to_numpy()]), np.concatenate([g, np.array(b.column(1).to_pylist(), object)])
                v += b.column(2).to_pylist()
            end = len(ids) if b is None else len(ids) - WINDOW
            if end > done and (b is None or end - done >= 4096):
                yield from found(ids, g, v, done, end)
                keep = max(end - WINDOW, 0)
                ids, g, v, done = ids[keep:], g[keep:], v[keep:], end - keep

    coded = _coded(nodes.select("id", "g", "v"), seed, 60, np.float32)
    return coded.repartitionByRange("g", "code", "id").sortWithinPartitions("g", "code", "id").select("id", "g", "v").mapInArrow(run, "id long, nbr long, cos double")


def _merged(edges: DataFrame, lists: int) -> DataFrame:
    """The best k entries (id, nbr, cos, new, k, worst) of each list; worst is the cosine that another has to pass."""
    own = Window.partitionBy("id")
    one = edges.groupBy("id", "nbr").agg(F.max("cos").alias("cos"), F.min("new").alias("new"), F.max("k").alias("k"))
    ranked = one.withColumn("k", F.coalesce(F.max("k").over(own), F.lit(lists))).withColumn("n", F.row_number().over(own.orderBy(F.desc("cos"), "nbr"))).where("n <= k")
    return common.checkpoint(ranked.select("id", "nbr", "cos", "new", "k", F.when(F.count("*").over(own) >= F.col("k"), F.min("cos").over(own)).otherwise(-2.0).alias("worst")))


def _met(edges: DataFrame, nodes: DataFrame, lists: int, turn: int) -> DataFrame:
    """(id, nbr, cos): what the neighbours of each node find in each other."""
    both = edges.select(F.col("id").alias("u"), F.col("nbr").alias("x"), "new").unionByName(edges.select(F.col("nbr").alias("u"), F.col("id").alias("x"), "new")).groupBy("u", "x").agg(F.max("new").alias("new"))
    sizes = both.groupBy("u").agg(F.count("*").alias("n"), F.max("new").alias("any")).where("any and n > 1").select("u", F.ceil(F.col("n") / GROUP).alias("parts"))
    dealt = both.join(sizes, "u").select("u", F.pmod(F.xxhash64("x", F.lit(turn)), F.col("parts")).alias("part"), "x", "new")
    held = nodes.select(F.col("id").alias("x"), "v").join(edges.groupBy(F.col("id").alias("x")).agg(F.max("k").alias("k"), F.max("worst").alias("worst")), "x", "left").select("x", "v", F.coalesce("k", F.lit(lists)).alias("k"), F.coalesce("worst", F.lit(-2.0)).alias("worst"))

    def found(t: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table]:
        u, part, x, new, k, worst = (t.column(c).to_numpy() for c in ("u", "part", "x", "new", "k", "worst"))
        v = t.column("v").to_pylist()
        cuts = [0, *(np.flatnonzero((u[1:] != u[:-1]) | (part[1:] != part[:-1])) + 1), len(u)]
        out = []
        for lo, hi in itertools.pairwise(cuts if whole else cuts[:-1]):
            if hi - lo < 2 or not new[lo:hi].any():
                continue
            m = np.frombuffer(b"".join(v[lo:hi]), np.float32).reshape(hi - lo, -1)
            cos, fresh, most = m @ m.T, new[lo:hi].astype(bool), int(k[lo:hi].max())
            cos[~(fresh[:, None] | fresh[None, :])] = -3
            np.fill_diagonal(cos, -3)
            better = cos > worst[lo:hi, None]
            if most < hi - lo:
                better &= cos >= -np.partition(-cos, most - 1, axis=1)[:, most - 1, None]
            i, j = np.nonzero(better)
            out.append((x[lo + i], x[lo + j], cos[i, j].astype(np.float64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.record_batch([pa.array(c) for c in columns], ["id", "nbr", "cos"]), t.slice(cuts[-2] if len(u) and not whole else len(u))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            batch, rest = found(t, False)
            yield batch
        if rest is not None:
            yield found(rest, True)[0]

    wide = dealt.join(held, "x").repartition("u", "part").sortWithinPartitions("u", "part")
    return wide.select("u", "part", "x", "new", "k", "worst", "v").mapInArrow(run, "id long, nbr long, cos double")


def _fresh(edges: DataFrame) -> DataFrame:
    return edges.select("id", "nbr", "cos", F.lit(True).alias("new"), F.lit(None).cast("int").alias("k"))


def _descend(edges: DataFrame, nodes: DataFrame, lists: int) -> DataFrame:
    """Rounds from (id, nbr, cos, new, k) on until hardly a new edge may hold a link and no list is saturated."""
    edges = _merged(edges, lists)
    for turn in itertools.count():
        edges = _merged(edges.select("id", "nbr", "cos", F.lit(False).alias("new"), "k").unionByName(_fresh(_met(edges, nodes, lists, turn))), lists)
        marked = edges.join(nodes.select("id", "far"), "id")
        near, full = F.col("cos") >= F.col("far"), F.col("worst") >= F.col("far")
        fresh, known, saturated = marked.agg(F.count_if(near & F.col("new")), F.count_if(near), F.count_if(full)).first()
        if saturated:
            edges = marked.select("id", "nbr", "cos", (F.col("new") | full).alias("new"), F.when(full, 2 * F.col("k")).otherwise(F.col("k")).alias("k"), F.when(full, -2.0).otherwise(F.col("worst")).alias("worst"))
        elif fresh <= STILL * known:
            return edges


def _audit(edges: DataFrame, nodes: DataFrame, theta: float) -> tuple[float, DataFrame]:
    """The share of the edges that may hold a link which some nodes have, of all that they should have; and all those."""
    asked = nodes.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(AUDITED).select("id", "g", "v", "radius").collect()
    shared = nodes.sparkSession.sparkContext.broadcast([tuple(r) for r in asked])  # AUDITED vectors at any size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {}
        for i, g, v, r in shared.value:
            by.setdefault(g, []).append((i, v, r))
        for b in batches:
            ids, g, v, r = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), object), b.column(2).to_pylist(), b.column(3).to_numpy()
            for key in set(g.tolist()) & by.keys():
                at = np.flatnonzero(g == key)
                x = np.frombuffer(b"".join([v[i] for i in at]), np.float32).reshape(len(at), -1)
                q, w, s = (np.array(c) if n != 1 else np.frombuffer(b"".join(c), np.float32).reshape(len(c), -1) for n, c in enumerate(zip(*by[key], strict=True)))
                cos = x @ w.T
                i, j = np.nonzero((_angles(cos) <= theta + r[at][:, None] + s[None, :]) & (ids[at][:, None] != q[None, :]))
                yield pa.record_batch([pa.array(q[j]), pa.array(ids[at[i]]), pa.array(cos[i, j].astype(np.float64))], ["id", "nbr", "cos"])

    truth = common.checkpoint(nodes.select("id", "g", "v", "radius").mapInArrow(run, "id long, nbr long, cos double"))
    listed = edges.select("id", "nbr").unionByName(edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct()
    all_, hit = truth.count(), truth.join(listed, ["id", "nbr"], "left_semi").count()
    return hit / all_ if all_ else 1.0, truth


def neighbours(nodes: DataFrame, theta: float, lists: int = LISTS, recall: float = RECALL) -> DataFrame:
    """(id, nbr, cos): the neighbour lists of `nodes` (id, g, v in single precision, radius, far), audited."""
    edges: DataFrame | None = None
    for turn in range(PASSES):
        orders = [_windows(nodes, 100 * turn + i, lists) for i in range(ORDERS << turn)]
        for o in orders:
            edges = _fresh(o) if edges is None else edges.unionByName(_fresh(o))
        edges = _descend(edges, nodes, lists)
        reached, truth = _audit(edges, nodes, theta)
        found = edges.select("id", "nbr", "cos").unionByName(truth)
        if reached >= recall:
            return found
        edges = edges.select("id", "nbr", "cos", "new", "k").unionByName(_fresh(truth))
    warnings.warn(f"the neighbour lists' recall is {reached:.3f}", stacklevel=2)
    return found


def _others(members: DataFrame, balls: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(id, pivot, other, n): how many vectors of the ball `other` each member is linked with, for the ordered `pairs` (pivot, other)."""
    theta = math.acos(least)
    sides = balls.select(F.col("pivot").alias("other"), F.col("v").alias("w"), F.col("radius"), F.col("n").alias("rows"), F.col("vectors"))
    asked = members.select("id", "pivot", "v").join(pairs, "pivot").join(sides, "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = _dots(b.column(2).to_pylist(), b.column(4).to_pylist())
            angle, radius, single = _angles(cos), b.column(5).to_numpy(), b.column(7).to_numpy() == 1
            all_ = np.where(single, cos >= least, angle + radius <= theta - FINE)
            some = ~single & ~all_ & (angle - radius <= theta + FINE)
            n = np.where(all_, b.column(6).to_numpy(), 0)
            keep = pa.array(all_ | some)
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array(n), pa.array(some), b.column(2)], ["id", "pivot", "other", "n", "open", "v"]).filter(keep)

    told = common.checkpoint(asked.select("id", "pivot", "v", "other", "w", "radius", "rows", "vectors").mapInArrow(run, "id long, pivot long, other long, n long, open boolean, v binary"))
    sizes = balls.select(F.col("pivot").alias("other"), F.ceil(F.col("vectors") / PAGE).alias("pages"))
    opened = told.where("open").select("id", "pivot", "other", "v")
    chunks = opened.groupBy("other").agg(F.ceil(F.count("*") / PAGE).alias("chunks")).join(sizes, "other")
    # each chunk of those asked for meets each page of the ball's members, a block at a time
    left = opened.join(chunks, "other").select("id", "pivot", "other", "v", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"))
    right = members.select(F.col("pivot").alias("other"), "id", "v", "n").join(chunks, "other").select("other", "v", "n", F.pmod(F.xxhash64("id"), "pages").alias("page"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(a), np.int64)
        if len(a) and len(b):
            x, y = (np.frombuffer(b"".join(f["v"]), np.float64).reshape(len(f), -1) for f in (a, b))
            n = (x @ y.T >= least) @ b["n"].to_numpy()
        return a[["id", "pivot", "other"]].assign(n=n)

    counted = left.groupBy("other", "page", "chunk").cogroup(right.groupBy("other", "page", "chunk")).applyInPandas(block, "id long, pivot long, other long, n long")
    return told.where("not open").select("id", "pivot", "other", "n").unionByName(counted.where("n > 0"))


def near_duplicates(rows: DataFrame, least: float = LEAST, lists: int = LISTS, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; `least` is a cosine above 0."""
    if not 0 < least <= 1:
        raise ValueError("the least cosine lies above 0")
    theta = math.acos(least)
    read = common.checkpoint(_units(rows, key, vector, label))
    distinct = common.checkpoint(read.where("d is not null").groupBy("d").agg(F.first("g").alias("g"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("rep")).withColumn("id", F.monotonically_increasing_id()))
    state = _balls(distinct.select("id", "g", "v"), distinct.count(), theta / 2 - FINE)
    # a vector alone in its ball is its own pivot; counted by a sum, as one ball may hold a third of all
    singles = state.groupBy("pivot").agg(F.count("*").alias("c")).where("c = 1").select("pivot", F.lit(True).alias("one"))
    joined = state.join(distinct.select("id", "n", "rep"), "id").join(singles, "pivot", "left").withColumn("alone", F.coalesce("one", F.lit(False)))
    members = common.checkpoint(joined.select("id", "g", "v", "n", "rep", F.when(F.col("alone"), F.col("id")).otherwise(F.col("pivot")).alias("pivot"), F.when(F.col("alone"), 0.0).otherwise(F.col("r")).alias("r")))
    sized = members.groupBy("pivot").agg(F.max("r").alias("radius"), F.sum("n").alias("n"), F.count("*").alias("vectors"), F.min("rep").alias("rep"))
    balls = common.checkpoint(sized.join(distinct.select(F.col("id").alias("pivot"), "g", "v"), "pivot"))
    widest = balls.agg(F.max("radius")).first()[0] or 0.0

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(short, pa.binary()), b.column(3), b.column(4)], ["id", "g", "v", "radius", "far"])

    far = F.cos(F.least(F.lit(math.pi), F.col("radius") + (theta + widest + COARSE)))
    nodes = common.checkpoint(balls.select(F.col("pivot").alias("id"), "g", "v", "radius", far.alias("far")).mapInArrow(single, "id long, g string, v binary, radius double, far double"))
    lists_ = neighbours(nodes, theta, lists, recall)
    radius = lambda c: balls.select(F.col("pivot").alias(c), F.col("radius").alias(f"r_{c}"))
    may = lists_.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cos")).join(radius("a"), "a").join(radius("b"), "b")
    pairs = common.checkpoint(may.where(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cos"))) <= F.col("r_a") + F.col("r_b") + (theta + COARSE)).select("a", "b"))
    ways = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("pivot"), F.col("a").alias("other")))
    linked = common.checkpoint(_others(members, balls, ways, least))
    roots = graph.components(linked.where("pivot < other").select(F.col("pivot").alias("u"), F.col("other").alias("v")).distinct())
    rooted = balls.select("pivot", "n", "rep").join(roots.withColumnRenamed("node", "pivot"), "pivot", "left").withColumn("root", F.coalesce("component", "pivot"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("pivot", (F.col("n") - 1).alias("own"), "component_id")
    outside = linked.groupBy("id").agg(F.sum("n").alias("outside"))
    counted = members.select("id", "pivot").join(named, "pivot").join(outside, "id", "left").select("id", (F.col("own") + F.coalesce("outside", F.lit(0))).alias("n_links"), "component_id")
    result = read.select("vec_id", "d").join(distinct.select("d", "id").join(counted, "id").drop("id"), "d", "left")
    # without a direction a vector is alone, and named by itself
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
