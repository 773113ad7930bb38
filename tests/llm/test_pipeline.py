"""The corpus pipeline, stage by stage, against the operators' own brute force."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    passage = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    more = [(9001, "12 34 !!", None, "s", 8), (9002, None, None, "s", 0), (9003, "The house and the garden. " + passage + " And the dog was there.", "en", "s", 1), (9004, "Write to me at the old address a.b@c.example.com and the other one.", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        path = str(tmp_path / name)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == before["language_id"].columns
    ids = {n: {r.doc_id for r in d.collect()} for n, d in before.items()}
    assert {9001, 9002} == ids["language_id"] - ids["near_dedup"]
    gone = ids["decontamination"] - ids["pii"]
    assert 9003 in gone and 9004 not in gone
    redacted = {r.doc_id: r.text for r in before["packing"].collect()}
    assert redacted[9004].startswith("Write to me at the old address [EMAIL] and")
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in redacted.values())
    assert {r.doc_id for r in docs.collect()} == set(redacted)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).where("offset = 0").count() > 0


def groups_by_force(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in ids}


def test_near_dedup_against_brute_force_jaccard(spark, small):
    rng = random.Random(5)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 12, 60, 150)))] for _ in range(40)]
    hot = [f"h{i}" for i in range(60)]
    for n, words in enumerate([*base * 4, *[hot] * 150]):
        words = list(words)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[10_000 + n] = " ".join(words)
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.repartition(5), small).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == groups_by_force(texts)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(4, len(words) - 4), edits):
        words[at] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_near_dedup_of_a_large_group_compares_few_pairs(spark, small, monkeypatch):
    from parchment.llm import copies

    rng, pairs, alike = random.Random(7), [], copies._alike
    base = [f"b{i}" for i in range(150)]
    texts = {n: edited(rng, base, n % 7) for n in range(350)}
    monkeypatch.setattr(copies, "_alike", lambda rows, distinct, met: pairs.append(met.count()) or alike(rows, distinct, met))
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.repartition(5), small).collect()}
    assert kept == groups_by_force(texts)
    assert sum(pairs) < 6 * len(texts)


def test_near_dedup_takes_the_links_of_fingerprints_first(spark):
    from parchment.llm import common, copies, simhash

    rng = random.Random(8)
    texts = [t for _ in range(30) for base in [[f"w{rng.randrange(10**6)}" for _ in range(400)]] for t in (" ".join(base), edited(rng, base, 1), edited(rng, base, 60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "_rank long, text string")
    distinct = common.checkpoint(simhash.fingerprints(docs.withColumnRenamed("_rank", "doc_id"), copies.set_id).withColumnRenamed("doc_id", "rep"))
    rows = docs.select(common.Members.slot("_rank").alias("i"), "text")
    found = {frozenset((r.u, r.v)) for r in copies.by_fingerprint(rows, distinct, common.Members(distinct.select("rep"), "rep")).collect()}
    ids = {t: copies.set_id(t) - (copies.set_id(t) >> 63 << 64) for t in texts}
    near = {frozenset((ids[s], ids[t])) for s, t in zip(texts[::3], texts[1::3], strict=True) if (simhash.fingerprint(s, 5) ^ simhash.fingerprint(t, 5)).bit_count() <= 4}
    assert found == near and len(near) > 5


def test_near_dedup_joins_rows_of_moved_sets_only(spark):
    from parchment.llm import common, copies

    left = common.checkpoint(spark.range(20_000).selectExpr("id k", "id % 400 fp", "id % 7 n", "id % 400 root"))
    moves = common.checkpoint(spark.range(20).selectExpr("id * 20 fp", "-id next"))
    moved, stay = copies._split(left, common.Members(moves, "fp"))
    assert 1000 <= moved.count() < 1200 and moved.count() + stay.count() == 20_000
    found = sorted(tuple(r) for r in copies._remarked(left, moves).collect())
    assert found == [(i, i % 400, i % 7, -(i % 400 // 20) if i % 20 == 0 else i % 400) for i in range(20_000)]


def test_near_dedup_marks_sets_that_share_bands_before_their_keys_are_looked_at(spark):
    from parchment.llm import common, copies, simhash

    rng = random.Random(9)
    texts = [t for _ in range(40) for base in [[f"w{rng.randrange(10**6)}" for _ in range(300)]] for t in (" ".join(base), edited(rng, base, 5), edited(rng, base, 30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "_rank long, text string")
    distinct = common.checkpoint(simhash.fingerprints(docs.withColumnRenamed("_rank", "doc_id"), copies.set_id).withColumnRenamed("doc_id", "rep"))
    rows = docs.select(common.Members.slot("_rank").alias("i"), "text")
    members = common.Members(distinct.select("rep"), "rep")
    found = {frozenset((r.u, r.v)) for r in copies.by_fingerprint(rows, distinct, members, banded=True).collect()}
    ids = {t: copies.set_id(t) - (copies.set_id(t) >> 63 << 64) for t in texts}
    alike = {frozenset((ids[s], ids[t])) for s, t in zip(texts[::3], texts[1::3], strict=True)}
    assert found <= alike and len(found) >= 38
    assert copies.bands(copies.shingles("")).size == 0 and copies.bands(copies.shingles("one two")).size == copies.BANDS


def test_near_dedup_meets_a_large_group_once_under_a_key(spark):
    """Forty sets apart from a group of 300 with 30 keys in common: marks meet, and each pair of sets comes once."""
    from parchment.llm import copies

    sets = [(fp, -1 if fp < 300 else fp) for fp in range(340)]
    near = (1 << 2 * copies.APART + 1) - 1
    left = spark.createDataFrame([(k, fp, 100, 290, near, root) for fp, root in sets for k in range(30)], "k long, fp long, n int, b int, near int, root long")
    marks = copies._met_marks(left)
    assert marks.count() == 41 * 40 // 2 and marks.agg({"c": "sum"}).first()[0] == 30 * 41 * 40 // 2
    pairs = [tuple(r) for r in copies._apart(left).collect()]
    assert len(pairs) == len(set(pairs)) and {frozenset(p) for p in pairs} == {frozenset((a, b)) for a, r in sets for b, t in sets if r != t}
    # ten keys are shared by sets of 100 at least
    assert copies._apart(left.where("k < 9")).isEmpty() and not copies._apart(left.where("k < 10")).isEmpty()
