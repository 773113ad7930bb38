"""Operator 7, toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Two words are as alike as the gapped subsequences of three characters they share, that span `SPAN`
characters at most; each character that a subsequence spans costs a factor, so inserted, changed
and left-out characters lower the kernel but do not break it. Words carry start and end marks.
Letters spelt out one by one are joined first, and where a beginning of a landmark and an end of
one follow each other as words, they are also read as one word. A sentence's kernel with a landmark
is the sum over its distinct words of the normalised word kernel to the power `POWER`, without values below `TINY`.

The landmarks are words of the training rows: those whose rates tell the labels apart, and the
frequent words of rows with label 0 that resemble them, so that the machine can tell the two
apart. Sentences are mapped by the landmarks' kernel to the power -1/2 (Nyström), and a linear
support vector machine is trained on the sentences of labelled documents; a document with label 1
vouches only for its most suspect sentences, which are chosen anew in each round. A document's score
is a logistic function of the sum, the mean by words, and the maximum of its sentences' positive margins.

The kernel is an explicit sum over subsequences, so one pass over a word's triples gives its kernel
with all landmarks. The exact norm is computed only for words that a lower bound of the norm
(their unbroken triples alone) lets reach `TINY`; the others would count as zero anyway.

The fit sees a documented, bounded sample (`max_train` labelled rows, by a hash of the row);
every row of the input is scored from its whole text.

Edge cases: a null, empty or wordless text has no margins and gets the score of that; rows whose
label or text is null never train; without rows of both labels every score is the share of label
1 (0.5 without rows); an id labelled more than once counts once, with its least label; ties give
equal scores; repeated rows get equal rows; an empty table gives an empty table; only the named
columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from . import quality

PREDICT_AT = 0.3
DECAY, POWER, SPAN, TINY = 0.4, 2.5, 8, 0.03
LEAST_GAIN, LEAST_SHARE = 15.0, 0.01  # of a landmark: G-squared (halved), and share of the documents with label 1
ALIKE = 0.5  # a word this close to a landmark is none
WIDE = 24  # characters of a word that are compared at once; longer words go in overlapping parts
CACHED = 400_000
CHUNK = 32_768  # sentences that are widened at once
SIGNS = re.compile(r"[^\w\s]|_")
SPELT = re.compile(r"(?<!\w)[^\W\d_]([ .*_-])(?:[^\W\d_]\1){2,}[^\W\d_](?!\w)")
MARK = "^"
VIRTUAL = 0.1  # weight of the virtual examples, against one half of either label's sentences
#: The second and third place of a triple, after the first.
STEPS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]


def plain(text: str | None) -> str:
    """Lower case, letters spelt out one by one joined."""
    return SPELT.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), (text or "").lower())


def parts(word: str) -> list[str]:
    """The word with its marks, in parts of at most WIDE characters."""
    word = f"{MARK}{MARK}{word}$"
    return [word] if len(word) <= WIDE else [word[i : i + WIDE] for i in range(0, len(word) - WIDE // 2, WIDE // 2)]


def matrix(strings: list[str]) -> np.ndarray:
    """The strings' code points, zeros after their ends."""
    width = max(map(len, strings), default=1)
    return np.array(strings or [""], f"U{width}").view(np.uint32).reshape(-1, width)[: len(strings)].astype(np.int64)


def triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers of its triples (characters below 2**20 each), -1 for none, and the weight of each column."""
    columns, weights = [], []
    for a, b in STEPS:
        width = codes.shape[1] - b
        if width > 0:
            key = (codes[:, :width] << 40) | (codes[:, a : a + width] << 20) | codes[:, b : b + width]
            key[codes[:, b : b + width] == 0] = -1
            columns.append(key)
            weights.append(np.full(width, DECAY ** (b + 1)))
    if not columns:
        return np.full((len(codes), 1), -1), np.zeros(1)
    return np.concatenate(columns, axis=1), np.concatenate(weights)


def norms(strings: list[str]) -> np.ndarray:
    """The kernel of each string with itself."""
    found = np.zeros(len(strings))
    for at in range(0, len(strings), 2000):
        key, weight = triples(matrix(strings[at : at + 2000]))
        order = np.argsort(key, axis=1)
        key, weight = np.take_along_axis(key, order, 1).reshape(-1), np.where(np.take_along_axis(key, order, 1) < 0, 0.0, weight[order]).reshape(-1)
        row = np.repeat(np.arange(len(order)), order.shape[1])
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
        found[at : at + 2000] = np.bincount(row[first], np.add.reduceat(weight, first) ** 2, len(order))
    return found


class Kernel:
    """Word kernels with fixed landmarks, normalised and to the power POWER."""

    def __init__(self, landmarks: list[str], marked: int | None = None):
        self.landmarks = landmarks
        strings = [f"{MARK}{MARK}{x}$"[:WIDE] for x in landmarks]
        self.own = norms(strings)
        # characters of landmarks are numbered from 1, all others are 0
        self.letters = np.unique(np.concatenate([np.unique(r[r > 0]) for r in matrix(strings)]))
        self.base = len(self.letters) + 1
        codes = self._numbered(matrix(strings))
        table: dict[int, int] = {}
        features = []
        for a, b in STEPS:
            width = codes.shape[1] - b
            for j, i in zip(*np.nonzero(codes[:, b:]), strict=True) if width > 0 else ():
                key = (codes[j, i] * self.base + codes[j, i + a]) * self.base + codes[j, i + b]
                features.append((table.setdefault(int(key), len(table) + 1), j, DECAY ** (b + 1)))
        self.row = np.zeros(self.base**3, np.int32)
        self.row[list(table)] = list(table.values())
        self.map = np.zeros((len(table) + 1, len(landmarks)), np.float32)
        for r, j, x in features:
            self.map[r, j] += x
        # of the first `marked` landmarks, which tell the labels apart
        self.starts = {x[:n] for x in landmarks[:marked] for n in range(1, len(x))}
        self.ends = {x[n:] for x in landmarks[:marked] for n in range(1, len(x))}

    def _numbered(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0)

    def raw(self, strings: list[str]) -> np.ndarray:
        """The plain kernel of each string with each landmark."""
        n, size = len(strings), len(self.map)
        codes = self._numbered(matrix(strings)).astype(np.int32)
        cells, weights = [], []
        for a, b in STEPS:
            width = codes.shape[1] - b
            if width <= 0:
                continue
            x, y, z = codes[:, :width], codes[:, a : a + width], codes[:, b : b + width]
            row = self.row[(x * self.base + y) * self.base + z]
            row[(x == 0) | (y == 0) | (z == 0)] = 0
            i, c = np.nonzero(row)
            cells.append(i * size + row[i, c])
            weights.append(np.full(len(i), DECAY ** (b + 1), np.float32))
        if not cells:
            return np.zeros((n, len(self.landmarks)))
        held = np.bincount(np.concatenate(cells), np.concatenate(weights), n * size).astype(np.float32)
        return (held.reshape(n, size) @ self.map).astype(float)

    def rows(self, words: list[str]) -> dict[str, np.ndarray]:
        """The kernels of those words that have any of TINY or more; of a long word the greatest of its parts."""
        pairs = sorted(((p, w) for w in words for p in parts(w)), key=lambda x: len(x[0]))
        found: dict[str, np.ndarray] = {}
        least = TINY ** (1 / POWER)
        for at in range(0, len(pairs), 2000):
            strings = [p for p, _ in pairs[at : at + 2000]]
            raw = self.raw(strings) / np.sqrt(self.own)
            # the unbroken triples alone give a norm of so much at least
            bound = np.sqrt(np.maximum(np.array([len(p) - 2 for p in strings]), 1) * DECAY**6)
            near = np.flatnonzero(raw.max(axis=1) >= least * bound)
            if not len(near):
                continue
            value = (raw[near] / np.sqrt(norms([strings[i] for i in near]))[:, None]) ** POWER
            value[value < TINY] = 0
            for i, x in zip(near.tolist(), value, strict=True):
                if x.any():
                    w = pairs[at + i][1]
                    found[w] = np.maximum(found[w], x) if w in found else x
        return found

    def tokens(self, sentence: str) -> list[str]:
        """The distinct words of a sentence, and what two of them make that are a start and an end of landmarks."""
        words = SIGNS.sub("", sentence).split()
        return list(dict.fromkeys(words + self.joined(words)))

    def joined(self, words: list[str]) -> list[str]:
        return [] if self.starts.isdisjoint(words) else [a + b for a, b in zip(words, words[1:]) if a in self.starts and b in self.ends]


class Model:
    def __init__(self, constant: float | None = None):
        self.constant = constant

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "none")}

    def margins(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """The margins of each text's sentences that have a word with a kernel, and its number of words."""
        if not hasattr(self, "known") or len(self.none) > CACHED:
            self.known, self.none = {}, set()
        # a repeated line counts once, but for the number of words
        cut = [Counter(parts_of(plain(t))) for t in texts]
        words = [{one: SIGNS.sub("", one).split() for one in x} for x in cut]
        tokens = [[dict.fromkeys(w + self.kernel.joined(w)) for w in x.values()] for x in words]
        fresh = set().union(*(t for x in tokens for t in x))
        fresh -= self.known.keys()
        fresh -= self.none
        rows = self.kernel.rows(list(fresh))
        self.known |= {w: float(r @ self.direction) for w, r in rows.items()}
        self.none |= fresh - rows.keys()
        get, out = self.known.get, []
        for x, w, ts in zip(cut, words, tokens, strict=True):
            sums = [sum(hits) for t in ts if (hits := [v for v in map(get, t) if v is not None])]
            out.append((np.array(sums, float) - self.bias, sum(len(w[one]) * n for one, n in x.items())))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        parts = (self.margins(texts[i : i + 256]) for i in range(0, len(texts), 256))  # the words of some texts at a time
        x = np.array([summary(m, n) for part in parts for m, n in part]).reshape(len(texts), 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.top, -30, 30)))


def parts_of(text: str) -> list[str]:
    """The sentences of a text, lines apart."""
    return re.split(r"(?<=[.!?])\s+|\n+", text)


def sentences(text: str) -> list[str]:
    """The distinct sentences, so that a repeated line counts once."""
    return list(dict.fromkeys(parts_of(text)))


def summary(margins: np.ndarray, words: int) -> list[float]:
    """One, and measures that grow with the positive margins ever more slowly: of their sum, of their share of the words, and the greatest."""
    positive = np.maximum(margins, 0)
    return [1.0, np.log1p(positive.sum()), np.log1p(30 * positive.sum() / (words + 10)), np.log1p(positive.max(initial=0))]


def split(text: str) -> list[str]:
    return SIGNS.sub("", plain(text)).split()


def choose(texts: list[str], targets: list[int], count: int) -> list[str]:
    """Words of three letters or more whose rates tell the labels apart most (G-squared), none close to another."""
    docs: Counter[str] = Counter()
    for t, y in zip(texts, targets, strict=True):
        if y:
            docs.update({w for w in split(t) if 3 <= len(w) <= WIDE - 3})
    # only words that can qualify are counted over all rows
    least = max(3, LEAST_SHARE * sum(targets))
    docs = Counter({w: n for w, n in docs.items() if n >= least})
    by, total = [Counter(), Counter()], [0, 0]
    for t, y in zip(texts, targets, strict=True):
        by[y].update(docs.keys() & set(split(t)))
        total[y] += 1
    share = total[1] / max(sum(total), 1)
    ranked = []
    for w in docs:
        a, b = by[1][w], by[0][w]
        if a * total[0] <= 3 * b * total[1]:  # three times the other rate, whatever the shares of the labels
            continue
        g = a * np.log(a / (share * (a + b))) + (b * np.log(b / ((1 - share) * (a + b))) if b else 0)
        if g >= LEAST_GAIN:
            ranked.append((-g, len(w), w))
    kept: list[str] = []
    kernel = None
    for _, _, w in sorted(ranked):
        if len(kept) == count:
            break
        if kernel is None or (found := kernel.rows([w]).get(w)) is None or found.max() < ALIKE:
            kept.append(w)
            kernel = Kernel(kept)
    return kept


def contrast(texts: list[str], targets: list[int], landmarks: list[str], count: int) -> list[str]:
    """Frequent words of rows with label 0 that resemble the landmarks."""
    kernel, near = Kernel(landmarks), Counter()
    clean = [t for t, y in zip(texts, targets, strict=True) if not y]
    for at in range(0, len(clean), 200):
        words = [set(split(t)) for t in clean[at : at + 200]]
        known = {w for w, x in kernel.rows(list(set().union(*words))).items() if x.max() < ALIKE and 3 <= len(w) <= WIDE - 3}
        for x in words:
            near.update(x & known)
    return [w for w, n in sorted(near.items(), key=lambda x: (-x[1], x[0]))[:count] if n >= 3]


def separate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine of squared hinge loss, by Newton steps; rows are widened some at a time."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        curve, slope = ridge.copy(), ridge @ w
        for at in range(0, len(x), CHUNK):
            z = np.column_stack([x[at : at + CHUNK].astype(float), np.ones(len(x[at : at + CHUNK]))])
            slack = 1 - y[at : at + CHUNK] * (z @ w)
            on = slack > 0
            zo, wo = z[on], c * weight[at : at + CHUNK][on]
            curve += (zo * wo[:, None]).T @ zo
            slope -= zo.T @ (wo * y[at : at + CHUNK][on] * slack[on])
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(-w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def variants(word: str) -> list[str]:
    """The word with one character put in, taken out or overwritten, not at its ends."""
    inner = range(1, len(word) - 1)
    return [*(word[:i] + "0" + word[i:] for i in range(1, len(word))), *(word[:i] + word[i + 1 :] for i in inner), *(word[:i] + "0" + word[i + 1 :] for i in inner)]


def fit(texts: list[str], targets: list[int], landmarks: int = 48, contrasts: int = 24, rounds: int = 4) -> Model:
    y = np.array(targets, int)
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    chosen = choose(texts, targets, landmarks)
    if not chosen:
        return Model(float(y.mean()))
    marked = len(chosen)
    chosen += contrast(texts, targets, chosen, contrasts)
    model = Model()
    kernel = model.kernel = Kernel(chosen, marked)
    rows = kernel.rows(chosen)
    gram = np.array([rows[w] for w in chosen])
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    nystrom = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    blocks, owner = [], []
    for at in range(0, len(texts), 200):  # the words of some rows at a time
        cut = [[kernel.tokens(one) for one in sentences(plain(t))] for t in texts[at : at + 200]]
        known = kernel.rows(list({w for x in cut for one in x for w in one}))
        rows = []
        for i, x in enumerate(cut, at):
            for one in x:
                hit = [known[w] for w in one if w in known]
                if hit:
                    rows.append(sum(hit))
                    owner.append(i)
        blocks.append((np.array(rows).reshape(len(rows), len(chosen)) @ nystrom).astype(np.float32))
    x, owner = np.concatenate(blocks), np.array(owner)
    del blocks, known, cut
    # virtual examples: what the machine is to tolerate, as sentences of one word each
    bent = kernel.rows([v for w in chosen[:marked] for v in variants(w) if v not in chosen])
    virtual = (np.array(list(bent.values())).reshape(len(bent), len(chosen)) @ nystrom).astype(np.float32)
    vouched = y[owner] == 1
    positive = vouched.copy()
    for _ in range(rounds):
        used = positive | ~vouched
        sign = np.where(positive, 1.0, -1.0)[used]
        weight = np.where(sign > 0, 0.5 / max(positive.sum(), 1), 0.5 / max((~vouched).sum(), 1)) * 200
        direction, bias = separate(np.concatenate((x[used], virtual)), np.append(sign, np.ones(len(virtual))), np.append(weight, np.full(len(virtual), VIRTUAL * 200 / max(len(virtual), 1))))
        margin = x @ direction - bias
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, margin)
        positive = vouched & ((margin > 0) | (margin == best[owner]))
    model.direction, model.bias = nystrom @ direction, bias
    del x, owner, vouched, positive, used, margin
    summaries = np.array([summary(s, n) for i in range(0, len(texts), 256) for s, n in model.margins(texts[i : i + 256])])
    model.top = logistic(summaries, y)
    del model.known, model.none
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = 6000) -> Model:
    return fit(*quality.labelled(docs, labels, label, max_train))


def score(docs: DataFrame, model: Model, at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    return quality.score(docs, model, at)
