"""Operator 6, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded from the classes of
its characters and the shape and repetition of its words; a gated attention, learnt from the
document labels alone, weighs the encodings, and their weighted mean is scored.

The fit sees a documented, bounded sample (`max_train` labelled rows, by a hash of the id);
every row of the input is scored from its whole text.

Edge cases: a null or empty text is one empty passage and is scored like any other; rows whose
label or text is null never train; without rows of both labels every score is the share of label
1 (0.5 if there are no rows); ties give equal scores; repeated rows get equal rows; an id labelled
more than once counts once, with its least label; an empty table gives an empty table; only the
named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PASSAGE = 64
PREDICT_AT = 0.7
HIDDEN, ATTENTION = 24, 16
LETTERS = 0x250  # code points below it are classed one by one
LOWER, UPPER, DIGIT, SPACE, LINE, OTHER_LETTER, OTHER, CLASSES = 0, 1, 2, 3, 4, 5, 6, 39


def _classes() -> np.ndarray:
    """The class of each code point below LETTERS; ASCII signs have one each."""
    signs = iter(range(OTHER + 1, CLASSES))
    found = np.empty(LETTERS, np.uint8)
    for i in range(LETTERS):
        c = chr(i)
        if c.isupper():
            found[i] = UPPER
        elif c.isalpha():
            found[i] = LOWER
        elif c.isdigit():
            found[i] = DIGIT
        elif c == "\n":
            found[i] = LINE
        elif c.isspace():
            found[i] = SPACE
        else:
            found[i] = next(signs) if 32 < i < 127 else OTHER
    return found


CLASS = _classes()
FEATURES = CLASSES + 9


def encode(text: str | None) -> np.ndarray:
    """Passages x FEATURES."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, FEATURES))
    n = len(words)
    passages = max(1, round(n / PASSAGE))
    edges = np.arange(passages + 1) * n // passages
    of = np.repeat(np.arange(passages), np.diff(edges))
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = 1 / np.diff(edges)

    # characters: white space belongs to the word before it
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = CLASS[np.minimum(codes, LETTERS - 1)]
    far = codes >= LETTERS
    if far.any():
        kind[far] = [OTHER_LETTER if chr(c).isalpha() else OTHER for c in codes[far].tolist()]
    blank = (kind == SPACE) | (kind == LINE)
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if len(starts) == n:
        word_at = np.cumsum(np.bincount(starts, minlength=len(codes)))
        at = of[np.maximum(word_at - 1, 0)]
    else:  # other white space than its class has; spread evenly
        at = of[np.arange(len(codes)) * n // len(codes)]
    chars = np.bincount(at * CLASSES + kind, minlength=passages * CLASSES).reshape(passages, CLASSES).astype(float)
    chars /= np.maximum(chars.sum(axis=1, keepdims=True), 1)

    # words and word pairs that came before in the document
    ids: dict[str, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    new = np.zeros(n)
    new[np.unique(number, return_index=True)[1]] = 1
    pairs = number[:-1] * len(ids) + number[1:]
    new_pair = np.zeros(n)
    if n > 1:
        new_pair[1:][np.unique(pairs, return_index=True)[1]] = 1
    same = np.zeros(n)
    same[1:] = number[1:] == number[:-1]
    upper = np.fromiter(map(str.isupper, words), bool, n)
    sums = lambda x: np.bincount(of, x, passages) * share
    mean = sums(lengths)
    distinct = np.bincount(np.unique(of * len(ids) + number) // len(ids), minlength=passages) * share
    more = [sums(new), sums(new_pair), sums(same), sums(upper), distinct, mean, np.sqrt(np.maximum(sums(lengths**2) - mean**2, 0)), np.log1p(np.full(passages, n)), np.log1p(np.diff(edges))]
    return np.column_stack([np.sqrt(chars), *more])


class Model:
    """Gated attention over encoded passages; `constant` stands in where nothing could be learnt."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.mean = self.scale = None
        self.w: dict[str, np.ndarray] = {}

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict:
        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (t * g) @ w["a"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, s)
        a = np.exp(s - top[bag])
        a /= np.bincount(bag, a, bags)[bag]
        z = np.stack([np.bincount(bag, a * h[:, j], bags) for j in range(h.shape[1])], axis=1)
        y = z @ w["c"] + w["d"]
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(y, -30, 30)))}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        found = []
        for t in texts:
            x = (encode(t) - self.mean) / self.scale
            found.append(self.forward(np.clip(x, -8, 8), np.zeros(len(x), int), 1)["p"][0])
        return np.array(found)

    def attention(self, text: str | None) -> np.ndarray:
        """The weight of each passage."""
        x = np.clip((encode(text) - self.mean) / self.scale, -8, 8)
        return self.forward(x, np.zeros(len(x), int), 1)["a"]


def gradient(model: Model, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The slope of the mean cross-entropy of bags with labels `y` in each weight."""
    w, n = model.w, len(y)
    f = model.forward(x, bag, n)
    dy = (f["p"] - y) / n
    dz = dy[:, None] * w["c"]
    through = (dz[bag] * f["h"]).sum(axis=1)
    ds = f["a"] * (through - np.bincount(bag, f["a"] * through, n)[bag])
    dt, dg = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "d": dy.sum()}


def fit(texts: list[str], targets: list[int], epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    y = np.array(targets, float)
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    xs = [encode(t) for t in texts]
    everything = np.concatenate(xs)
    model = Model()
    model.mean, model.scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    xs = [np.clip((x - model.mean) / model.scale, -8, 8) for x in xs]
    rng = np.random.default_rng(seed)
    shapes = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "d": ()}
    w = model.w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) else np.zeros(s) for k, s in shapes.items()}
    w["e"] *= 0
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(xs))
        for i in range(0, len(xs), batch):
            chosen = order[i : i + batch]
            x = np.concatenate([xs[k] for k in chosen])
            bag = np.repeat(np.arange(len(chosen)), [len(xs[k]) for k in chosen])
            grads = gradient(model, x, bag, y[chosen])
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for k, g in grads.items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `max_train` labelled rows, in a fixed order; of an id's texts, few are likely to be among them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    total = known.count()
    first, all_ = common.threshold(2 * max_train, total), 1 << 62
    share = first
    while True:
        # twice as many ids as wanted rows, as some have no text; more, where too many name no document
        few = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("label")), 2) < share)
        rows = common.bounded_rows(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few) if share == first else few, "doc_id"), "text", max_train, min(total, 2 * max_train))
        if 2 * len(rows) >= max_train or share >= all_:
            break
        share = min(all_, 16 * share)
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [r.y for r in rows]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 4000) -> Model:
    return fit(*labelled(docs, labels, label, max_train))


def score(docs: DataFrame, model, at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, score, predicted) of every row, by the model's `scores`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.asarray(shared.value.scores(b.column(1).to_pylist()), float)
            yield pa.record_batch([b.column(0), pa.array(p, pa.float64()), pa.array((p >= at).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
