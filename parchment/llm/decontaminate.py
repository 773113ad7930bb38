"""Operator 10, benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with every run of other characters than letters and digits as
one space. An item of n characters may differ from a stretch of a document by n // 16 edits at
most (its error budget). It is split into budget + 1 pieces; wherever it occurs within budget at
least one piece occurs exactly. All pieces of a block of items are searched at once, and the
surroundings of each hit are verified by Myers' bit-parallel edit distance. Every document is
read whole, and no hit is dropped.

The items are the query set: they go to the executors in blocks of at most `block_chars`
characters, each block a pass of its own, so memory stays bounded however many items there are.

An item of under `min_chars` normalised characters counts where it stands exactly, between word
boundaries; scripts written without spaces have one at every character.

Edge cases: null texts, and items without letters or digits, match nothing; a null doc_id or item_id is carried; equal items each get rows; repeated documents each get rows;
of several stretches the one of least distance, then the first, is reported; no documents or no
items give no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHARS_AN_EDIT = 16
OTHER = re.compile(r"[\W_]+")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def budget(n: int, chars_an_edit: int = CHARS_AN_EDIT) -> int:
    return n // chars_an_edit


def bounded(text: str, a: int, b: int) -> bool:
    """Whether words end at both sides of text[a:b]."""
    return all(at in (0, len(text)) or " " in text[at - 1 : at + 1] or UNSPACED.search(text[at - 1 : at + 1]) for at in (a, b))


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def distance(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of `text`, and where the first such stretch ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        x = get(c, 0) | vn
        d = ((vp + (x & vp)) ^ vp | x) & full
        hn = vp & d
        hp = vn | full & ~(vp | d)
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = hp << 1 & full
        vn = hp & d
        vp = (hn << 1 | ~(hp | d)) & full
        if score < best:
            best, end = score, j
    return best, end


def _join(spans: list[tuple[int, int]], a: int, b: int) -> None:
    """Add [a, b] to the sorted `spans`; those that it touches become one, so no more are held than lie apart in the text."""
    if spans and spans[-1][0] <= a <= spans[-1][1] >= b:
        return
    i = bisect_left(spans, (a, b))
    if i and spans[i - 1][1] >= a:
        i -= 1
        a = spans[i][0]
    j = i
    while j < len(spans) and spans[j][0] <= b:
        b = max(b, spans[j][1])
        j += 1
    spans[i:j] = [(a, b)]


class Index:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str, bool]], chars_an_edit: int):
        # a budget of -1 marks a short item
        self.items = [(item_id, text, masks(text), -1 if short else budget(len(text), chars_an_edit)) for item_id, text, short in items]
        # of equal pieces of an item the first and the last place: the surroundings between them overlap anyway
        pieces: dict[str, dict[int, tuple[int, int]]] = {}
        for n, (_, text, _, k) in enumerate(self.items):
            k = max(k, 0)
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                own = pieces.setdefault(text[a:b], {})
                own[n] = (own.get(n, (a, a))[0], a)
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), [(n, *ends) for n, ends in places.items()]))
        self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the normalised text) of each item within its budget."""
        text = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        exact: dict[int, int] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, first, final in places:
                start = last - size + 1
                k = self.items[n][3]
                if k < 0:
                    if n not in exact and bounded(text, start - first, last + 1):
                        exact[n] = last + 1
                    continue
                _join(windows.setdefault(n, []), max(0, start - final - k), start - first + len(self.items[n][1]) + k)
        found = [(self.items[n][0], 0, end) for n, end in exact.items()]
        for n, spans in windows.items():
            item_id, pattern, peq, k = self.items[n]
            best: tuple[int, int] | None = None
            for a, b in spans:
                d, end = distance(peq, len(pattern), text[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = d, a + end
            if best:
                found.append((item_id, *best))
        return found


_built: dict = {}


def _index(shared, chars_an_edit: int) -> Index:
    """This worker's index of the block at hand, built once."""
    key = (id(shared.value), len(shared.value), chars_an_edit)
    if _built.get("key") != key:
        _built.update(key=key, block=shared.value, index=Index(shared.value, chars_an_edit))
    return _built["index"]


def _blocks(items: DataFrame, item_id: str, text: str, min_chars: int, block_chars: int) -> Iterator[list[tuple[int | None, str, bool]]]:
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("long"), F.col(text)).toLocalIterator():
        pattern = normal(row[1])
        if not pattern:
            continue
        if block and size + len(pattern) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], pattern, len(pattern) < min_chars))
        size += len(pattern)
    if block:
        yield block


def _search(batches: Iterator[pa.RecordBatch], shared, chars_an_edit: int) -> Iterator[pa.RecordBatch]:
    index = _index(shared, chars_an_edit)
    for b in batches:
        rows = [(doc_id, *hit) for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in index.search(t)]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], ["doc_id", "item_id", "distance", "stop"])


def hits(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", min_chars: int = 20, chars_an_edit: int = CHARS_AN_EDIT, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance, stop): every item that a document holds within budget."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, distance long, stop long"
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for block in _blocks(items, item_id, item_text, min_chars, block_chars):
        part = narrow.mapInArrow(partial(_search, shared=spark.sparkContext.broadcast(block), chars_an_edit=chars_an_edit), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", min_chars: int = 20, chars_an_edit: int = CHARS_AN_EDIT, block_chars: int = 4_000_000) -> DataFrame:
    """The documents that hold no item, with their columns."""
    for block in _blocks(items, item_id, item_text, min_chars, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = common.filtered(docs, partial(_free, shared=shared, chars_an_edit=chars_an_edit))
    return docs


def _free(texts: list[str | None], shared, chars_an_edit: int) -> list[bool]:
    index = _index(shared, chars_an_edit)
    return [not index.search(t) for t in texts]
