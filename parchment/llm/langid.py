"""Operator 5, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased letters of the whole text, words padded by
one space, weighted by 1 + log(tf) times the idf of the training sample and scaled to unit
length. Weights are learnt by FTRL-proximal with an elastic net (many end at exactly zero);
a temperature then scales the logits, fitted on a part of the sample kept out of training.

The fit sees a documented, bounded sample (`max_train` rows, by a hash of the row, the same rows
each time, repeated ones once) of rows with a language; every row of the input is predicted from its whole text.

Edge cases: a null or letterless text is `und` with score 0; rows without lang never train; with
no training rows, or one language only, all lettered texts get `und` with score 0, or that
language with score 1; ties go to the first language by name; repeated rows get equal rows; an
empty table gives an empty table; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15
UNKNOWN = "und"
PIECE = 1 << 20  # code points counted at once, so that a very long text needs little memory


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters than letters is one space."""
    low = text.lower()
    if low.isascii():
        codes = np.frombuffer(low.encode("ascii"), np.uint8).astype(np.uint32)
        is_letter = (codes >= 97) & (codes <= 122)
    else:
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = (codes >= 97) & (codes <= 122)
        other = codes >= 128
        distinct, back = np.unique(codes[other], return_inverse=True)
        is_letter[other] = np.array([chr(c).isalpha() for c in distinct.tolist()], bool)[back]
    if not is_letter.any():
        return codes[:0]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first character after a run of letters stands for the gap
    return np.concatenate(([32], np.where(is_letter, codes, 32)[keep], [32])).astype(np.uint32)


def counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 1 to 3 code points, and how often each occurs."""
    total = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(codes), PIECE):
        x = codes[at : at + PIECE + 2]
        end = min(PIECE, len(codes) - at)
        a = (x + np.uint32(1)) * np.uint32(0x9E3779B1)
        for n in (1, 2, 3):
            if n > 1:
                if len(x) < n:
                    break
                a = (a[: len(x) - n + 1] ^ x[n - 1 :] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
            total += np.bincount((a[:end] ^ np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    index = np.flatnonzero(total)
    return index, total[index]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by feature
    weights: np.ndarray  # feature x language
    bias: np.ndarray
    temperature: float

    def logits(self, index: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[index]
        return x @ self.weights[index] / max(np.sqrt(x @ x), 1e-9) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = letters(text or "")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(*counts(codes)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fit(texts: list[str], langs: list[str], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-5, seed: int = 7) -> Model:
    """FTRL-proximal over single rows; every fifth row is kept for the temperature."""
    # only the counts of n-grams are held, in few bytes each; what follows from them is made anew where it is used
    bags, known = [], []
    for t, lang in zip(texts, langs, strict=True):
        codes = letters(t)
        if len(codes):
            index, n = counts(codes)
            bags.append((index.astype(np.int32), n.astype(np.int32)))
            known.append(lang)
    languages = sorted(set(known))
    size = 1 << BITS
    if len(languages) < 2:
        return Model(languages, np.ones(size), np.zeros((size, len(languages))), np.zeros(len(languages)), 1.0)
    target = np.array([languages.index(lang) for lang in known])
    seen = np.zeros(size)
    for index, _ in bags:
        seen[index] += 1
    idf = np.log((1 + len(bags)) / (1 + seen)) + 1
    k = len(languages)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias

    def solve(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    kept = np.arange(len(bags)) % 5 == 4
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(np.flatnonzero(~kept)):
            index, c = bags[r]
            x = (1 + np.log(c)) * idf[index]
            index, x = np.append(index, size), np.append(x / np.sqrt(x @ x), 1.0)
            w = solve(z[index], n[index])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[target[r]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    w = solve(z, n)
    model = Model(languages, idf, w[:-1], w[-1], 1.0)
    logits = np.array([model.logits(*bags[r]) for r in np.flatnonzero(kept)])
    if len(logits):
        model.temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: nll(logits / t, target[kept]))
    return model


def nll(logits: np.ndarray, target: np.ndarray) -> float:
    z = logits - logits.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target]).mean())


def train(docs: DataFrame, max_train: int = 4000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most `max_train` rows of `docs` that have text and language."""
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    total = known.select("k", "l").count()
    rows = sorted(common.bounded_rows(known, "t", max_train, total), key=lambda r: (str(r.k), r.t))
    return fit([r.t for r in rows], [r.l for r in rows])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(common.id_bucket(F.col("doc_id"), 3) == 1, F.lit(False)))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str | None]) -> list[bool]:
        return [lang != UNKNOWN and score >= least for lang, score in map(shared.value.predict, texts)]

    return common.filtered(docs, keep)
