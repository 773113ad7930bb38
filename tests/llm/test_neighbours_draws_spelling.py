"""Operators 11 to 13: brute force, SQL and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from parchment.llm import neighbours, queries, resample, spelling

DOCS = "doc_id long, text string, lang string, key string"
VECTORS = "vec_id long, embedding array<float>, label int, id long, pivot string"


def rows(frame):
    plain = lambda x: None if pd.isna(x) else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["op11_embedding_near_dedup", "op12_importance_resampling", "op13_spelling_variants"])
def test_against_sql(spark, tables, small, name):
    ours = queries.queries()[name](spark, small).toPandas()
    theirs = tables.execute(queries.oracle_sql()[name]).fetchdf()
    assert rows(ours) == rows(theirs)
    assert set(ours.columns) == set(theirs.columns)


# 11


def links_by_force(vectors, least=0.93):
    """(n_links, component) by place, of (vec_id, vector, label)."""
    unit = [None if v is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, y in vectors]
    n, group = [0] * len(vectors), list(range(len(vectors)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(vectors)), 2):
        if unit[i] is not None and unit[j] is not None and vectors[i][2] == vectors[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
            n[i] += 1
            n[j] += 1
            group[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for i in range(len(vectors)):
        ids.setdefault(top(i), []).append(vectors[i][0])
    return [(vectors[i][0], n[i], min((x for x in ids[top(i)] if x is not None), default=None)) for i in range(len(vectors))]


def found_by(spark, vectors, **more):
    df = spark.createDataFrame([(i, v, y, 7, "clash") for i, v, y in vectors], VECTORS).repartition(3)
    return neighbours.near_duplicates(df, **more).collect()


def key(r):
    return tuple((x is not None, x) for x in r)


def test_neighbours_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    odd = [(1, a, 0), (1, a, 0), (2, b, 0), (3, b, 1), (4, b, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 0.0], 0), (9, [float("nan"), 1.0, 0.0], 0), (10, [float("inf"), 1.0, 0.0], 0), (11, [2.0, 0.0], 0), (None, a, 0), (None, [0.0, 0.0, 1.0], 3), (12, [3e38, 0.0, 0.0], 0), (13, [1e-40, 0.0, 0.0], 0), (14, [-1.0, 0.0, 0.0], 0)]
    found = found_by(spark, odd)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in found], key=key) == sorted(links_by_force(odd), key=key)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    assert neighbours.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        neighbours.near_duplicates(spark.createDataFrame([], VECTORS), least=0.0)


def test_neighbours_chains_and_dense_groups(spark):
    """A long chain, a group wider than a ball, near copies and noise; lists of three entries have to grow."""
    rng = np.random.default_rng(3)
    chain = [[math.cos(t), math.sin(t), 0.0, 0.0, 0.0, 0.0] for t in np.arange(0, 1.5, 0.01)]
    wide = rng.standard_normal((150, 6)) * 0.16 + np.eye(6)[3]
    tight = rng.standard_normal((100, 6)) * 0.02 + np.eye(6)[5]
    noise = rng.standard_normal((200, 6))
    vectors = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate([*chain, *wide, *tight, *noise])]
    found = found_by(spark, vectors, lists=3, recall=1.0)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(links_by_force(vectors))


def test_a_group_of_copies_is_few_nodes(spark):
    """A third of the rows near one another: the graph has a few nodes for them, and the counts are whole."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    near = centre + rng.standard_normal((600, 32)) * 0.1
    far = rng.standard_normal((1200, 32))
    vectors = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate([*near, *far])]
    distinct = spark.createDataFrame([(i, "32:0", neighbours.unit(np.array(v))) for i, v, _ in vectors], "id long, g string, v binary")
    balls = neighbours._balls(distinct, 1800, math.acos(0.93) / 2 - 1e-7).collect()
    assert len({r.pivot for r in balls if r.id < 600}) < 60
    found = {r.vec_id: r.n_links for r in found_by(spark, vectors)}
    assert [found[i] for i, _, _ in vectors] == [n for _, n, _ in links_by_force(vectors)]


# 12


def drawn_by_force(docs, target, percent=10, longest=1, least=20):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(at(f) for _, t in docs for f in features(t)[1])
    t = Counter(at(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, found = features(text)
        gain = [math.floor(1000 * math.log((t[at(f)] + 1) * (all_s + 10_000) / ((s[at(f)] + 1) * (all_t + 10_000)))) for f in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least))
    in_ = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    cut = percent * len(in_) // 100
    return sorted([(*r[:4], None) for r in out if not r[4]] + [(*r[:4], n if n <= cut else None) for n, r in enumerate(in_, 1)], key=key)


def draw(spark, docs, target, **more):
    d = spark.createDataFrame([(i, t, None, "clash") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted(map(tuple, resample.resample(d, b, **more).collect()), key=key)


def texts(n, seed=1):
    r = random.Random(seed)
    vocabulary = [*(f"w{i}" for i in range(50)), "Straße", "ÄB", "漢字", "x-y", "İi"]
    return [" ".join(r.choices(vocabulary, k=r.randrange(5, 60))) for _ in range(n)]


@pytest.mark.parametrize("percent", [0, 10, 37, 100])
def test_draw_against_brute_force(spark, percent):
    docs = [*enumerate(texts(300)), (7, texts(300)[7]), (None, "a " * 25), (None, None), (400, ""), (401, "!?"), (402, "x" * 3_000_000), (403, "lang " * 300_000)]
    assert draw(spark, docs, texts(20, 2), percent=percent) == drawn_by_force(docs, texts(20, 2), percent)


def test_draw_of_longer_features_and_hot_rows(spark):
    docs = [*enumerate(texts(120)), *[(5, texts(1, 9)[0] + " a" * 20)] * 3000]
    plain = draw(spark, docs, texts(5, 2), percent=50)
    assert plain == drawn_by_force(docs, texts(5, 2), 50)
    assert sorted(r[4] for r in plain if r[4]) == list(range(1, max(r[4] or 0 for r in plain) + 1))


def test_features_of_several_words_go_on_over_pieces(monkeypatch):
    from parchment.llm import common

    text = " ".join(f"w{i % 13}" for i in range(500))
    whole = resample.features(text, 3)
    cut = common.pieces
    monkeypatch.setattr(common, "pieces", lambda data, gap, size=1 << 20: cut(data, gap, 17))
    assert resample.features(text, 3) == whole
    assert sum(whole.values()) == 500 + 499 + 498


def test_draw_from_nothing(spark):
    assert draw(spark, [], ["a b"]) == []
    docs = [*enumerate(texts(30))]
    assert draw(spark, docs, []) == drawn_by_force(docs, [])


# 13


def variants_by_force(docs, noise=199, shortest=6, often=5):
    n = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % noise == 0 else r] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= often}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        found = [x for x in n if x != w and near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        count[w], form[w] = len(found), best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n)


def vary(spark, docs):
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in docs], DOCS).repartition(3)
    found = spelling.variants(spelling.counts(df)).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(map(tuple, found.collect()), key=lambda r: r[0])


def edited(r, word):
    i, c = r.randrange(len(word)), r.choice("abcdefgäöü×")
    return r.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


def test_variants_against_brute_force(spark):
    r = random.Random(4)
    words = ["garden", "Gardens", "straßen", "Überfall", "international", "internationale", "aaaaaaa", "ñandúes"]
    pool = [w for w in words for _ in range(40)] + [edited(r, w) for w in words for _ in range(60)] * 6
    docs = [(i, " ".join(r.choices(pool, k=40)) + ("-" if i % 2 else "\n1")) for i in range(150)]
    docs += [(None, "garden " * 9), (7, docs[7][1]), (900, None), (901, ""), (902, "xy" * 40_000), (903, "GARDEN" + "'" * 50_000)]
    assert vary(spark, docs) == variants_by_force(docs)
    assert vary(spark, []) == []


def test_large_blocks_are_divided(spark):
    """Hundreds of words with the same first half, and as many with the same last one."""
    r = random.Random(6)
    letters = "abcdefgh"
    words = {"prefix" + "".join(r.choices(letters, k=4)) for _ in range(700)} | {"".join(r.choices(letters, k=4)) + "suffix" for _ in range(400)}
    words |= {w[:8] + w[9:] for w in list(words)[:200]} | {"z" * 7 + c for c in letters}
    df = spark.createDataFrame([(w, 10) for w in words], "word string, n long")
    got = {tuple(sorted((x.a, x.b))) for x in spelling.near(df, limit=8).collect()}
    all_ = {tuple(sorted((x.a, x.b))) for x in spelling.near(df).collect()}
    listed = [(1, " ".join(list(words) * 5))]
    force = {r[0]: r[4] for r in variants_by_force(listed, noise=10**10)}
    count = Counter(w for p in got for w in p)
    assert got == all_
    assert {w: count[w] for w in words} == force


def test_form_chains_lead_to_the_root(spark):
    df = spark.createDataFrame([("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("abbbbb", 15625)], "word string, n long")
    found = {r.word: (r.form, r.root, r.form_n) for r in spelling.variants(df).collect()}
    assert found["aaaaaa"] == ("aaaaab", "abbbbb", 25)
    assert found["abbbbb"] == (None, "abbbbb", None)
