"""Grading that goes on where it stopped, and the whole job from a folder to its report."""

import difflib
import json
import os
import random
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parchment.operators import evaluate, report, scorer, similarity
from parchment.plans import job, review
from parchment.plans.rubric import Dimension, Similarity
from parchment.sources import answers, store
from tests.test_semantics import package

# the workers do not find this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Stub:
    """Notes each call in a folder; dies or fails at the prompts it is told to."""

    def __init__(self, folder, dies=(), fails=(), says="{}"):
        self.folder, self.dies, self.fails, self.says = str(folder), dies, fails, says
        os.makedirs(self.folder, exist_ok=True)

    def answer(self, prompt):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.write(prompt)
        if prompt in self.dies:
            os._exit(1)
        if prompt in self.fails:
            raise TimeoutError("too slow")
        return self.says

    def calls(self):
        return sorted(open(f"{self.folder}/{n}", encoding="utf-8").read() for n in os.listdir(self.folder))


def test_a_lost_task_asks_nothing_twice(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"prompt {i % 30}") for i in range(40)] + [(99, None)], "doc_id long, prompt string")
    log = str(tmp_path / "log")
    with pytest.raises(Exception, match="."):
        answers.ask(prompts, Stub(tmp_path / "calls", dies=("prompt 17",)), log, parallel=2)
    before = Stub(tmp_path / "calls").calls()
    assert "prompt 17" in before and len(before) == len(set(before))
    found = {r.doc_id: r for r in answers.ask(prompts, Stub(tmp_path / "calls", fails=("prompt 3",)), log, parallel=2).collect()}
    calls = Stub(tmp_path / "calls").calls()
    # only the prompt that was being asked when the worker died came twice; equal prompts were asked once
    assert [c for c in set(calls) if calls.count(c) > 1] == ["prompt 17"] or calls.count("prompt 3") == 2
    assert calls.count("prompt 17") == 2 and all(calls.count(c) == 1 for c in set(calls) - {"prompt 17", "prompt 3"})
    assert len(found) == 41 and found[99].response is None and found[5].response == "{}" and found[35].response == "{}"
    if "prompt 3" not in before:
        assert found[3].error == "TimeoutError: too slow" and found[3].response is None
        again = {r.doc_id: r for r in answers.ask(prompts, Stub(tmp_path / "calls"), log).collect()}
        assert again[3].response == "{}" and again[3].error is None
    known = len(Stub(tmp_path / "calls").calls())
    answers.ask(prompts, Stub(tmp_path / "calls"), log)
    assert len(Stub(tmp_path / "calls").calls()) == known


def test_bucket_lets_through_its_rate():
    now = [0.0]
    bucket = answers.Bucket(2.0, burst=3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    at = []
    for _ in range(9):
        bucket.take()
        at.append(now[0])
    assert at[:3] == [0, 0, 0] and at[3:] == [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]


def test_names_with_signs_of_their_own(spark):
    dims = (Dimension("it's", 0.5), Dimension("a.b (c)", 0.5))
    said = [(1, json.dumps({"dimension_scores": {"it's": 80, "a.b (c)": 60}})), (2, "it's: 70\na.b (c)：50"), (3, "axb (c): 9")]
    found = {r.id: r for r in evaluate.parse_evaluation(spark.createDataFrame(said, "id long, response string"), dims).collect()}
    assert found[1].scores == {"it's": 80.0, "a.b (c)": 60.0} and found[1].total == 70
    assert found[2].scores == {"it's": 70.0, "a.b (c)": 50.0} and found[3].scores == {}


class Cleared:
    def __call__(self, a, b):
        return "非抄袭"


TEXT = "\n".join(f"这是第{i}段，讲述系统的设计与实现 part {i} of the report" for i in range(40))


def test_from_a_folder_to_the_report(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name, text in (("20210001_张三", TEXT), ("20210002_李四", TEXT + "\nmore"), ("20210003_王五", "quite another text\n" * 30)):
        (folder / f"{name}.docx").write_bytes(package(text.split("\n")))
    config = {"dimensions": [{"name": "it's", "weight": 0.5}, {"name": "文档", "weight": 0.5}], "completeness": {"word_count": {"min": 50}}}
    said = '```json\n{"dimension_scores": {"it\'s": 80, "文档": 90}, "short_comment": "well, \\"done\\"", "core_problems": {"P0": ["x"]}}\n```'
    stub = Stub(tmp_path / "calls", says=said)
    alike = Similarity(hashes=16)
    rows = {r.author: r for r in job.run(spark, str(folder), out, config, grader=stub, alike=alike).collect()}
    assert len(rows) == 3 and len(stub.calls()) == 3
    one = rows["20210001-张三"]
    assert one["it's"] == 80 and one["文档"] == 90 and one.evaluation == 85 and one.comment == 'well, "done"' and one.problems == ["[P0]x"]
    assert one.links == 1 and one.highest > 0.6 and rows["20210003-王五"].links == 0
    text = [r.value for r in spark.read.text(f"{out}/reports/markdown").collect()]
    assert any("it's" in x and "50%" in x for x in text) and any("20210001-张三" in x and "20210002-李四" in x and "相似度" in x for x in text)
    assert any(x == "- problems: [P0]x" for x in text)
    # nobody is graded twice: neither from what is kept, nor from the report alone
    job.run(spark, str(folder), out, config, grader=stub, alike=alike)
    restored = {r.author: r for r in job.run(spark, str(folder), str(tmp_path / "new"), config, grader=stub, alike=alike, reports=f"{out}/reports").collect()}
    assert len(stub.calls()) == 3 and restored["20210001-张三"].evaluation == 85 and restored["20210001-张三"]["it's"] == 80 and restored["20210001-张三"].comment == 'well, "done"'
    # a judge that clears the pair takes the penalty away
    free = {r.author: r for r in job.run(spark, str(folder), out, config, judge=Cleared(), alike=alike).collect()}
    assert free["20210001-张三"].links == 0 and free["20210001-张三"].final > one.final


def test_text_keys_copies_and_the_last_of_a_name(spark):
    docs = spark.createDataFrame([("b", TEXT, 1), ("a", TEXT, 1), ("c", "short", 2), ("c", TEXT + " x", 1), ("d", None, 1)], "author string, text string, version int")
    rows = {r.author: r for r in review.review(docs, alike=Similarity(hashes=16), grader=scorer.LengthScorer(), key="author", order="version").collect()}
    assert len(rows) == 4 and rows["a"].links == 1 and rows["c"].links == 0 and rows["d"].success is False
    assert [rows[k].ordinal for k in "abcd"] == [1, 2, 3, 4]
    sets, members = similarity.classes(docs.where("version = 1"), Similarity(hashes=16), "author")
    pairs = similarity.compared(sets, Similarity(hashes=16))
    found = {r.author: r for r in similarity.rollup(members, pairs, Similarity(hashes=16), "author").collect()}
    assert found["a"].partner == "b" and found["b"].partner == "a" and found["c"].partner == "a" and found["d"].partner is None and found["c"].links == 2
    # a judge that clears all leaves copies and near copies alone
    left, none = similarity.cleared(members, pairs.withColumn("severity", F.lit("")), docs.where("version = 1"), Cleared(), Similarity(hashes=16), "author")
    assert {r.links for r in similarity.rollup(left, none, Similarity(hashes=16), "author").collect()} == {0}


def blocks_by_force(a, b, least):
    found = [m for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= least]
    return [(m.size, a[m.a : m.a + m.size]) for m in sorted(found, key=lambda m: (-m.size, m.a))[:10]]


def test_segments_against_brute_force(spark):
    r = random.Random(8)
    texts = {}
    for i in range(12):
        parts = [("".join(r.choices("abcdeé漢 ", k=r.randrange(5, 90))), r.randrange(4)) for _ in range(12)]
        shared = [texts[i - 1][x : x + r.randrange(20, 120)] if i and n else p for (p, n), x in zip(parts, r.choices(range(300), k=12), strict=True)]
        texts[i] = "".join(shared) + "ab" * r.randrange(40)
    texts |= {12: None, 13: "", 14: "x" * 29, 15: "x" * 200, 16: "y" + "x" * 150 + "z"}
    docs = spark.createDataFrame([*texts.items(), (None, "x" * 50)], "doc_id long, text string")
    pairs = [(i, i + 1) for i in range(16)] + [(0, 5)]
    for least in (30, 7, 4):
        found = {}
        for s in similarity.common_segments(spark.createDataFrame(pairs, "a long, b long"), docs, Similarity(min_match=least)).collect():
            found.setdefault((s.a, s.b), []).append((s.segment_no, s.length, s.segment))
        for a, b in pairs:
            force = blocks_by_force(texts[a] or "", texts[b] or "", least)
            assert sorted(found.get((a, b), [])) == [(n, k, t[:100] + "..." if k > 100 else t) for n, (k, t) in enumerate(force, 1)], (a, b, least)


def similar_by_force(docs, rules):
    import hashlib
    import re

    def grams(t):
        kept = re.sub(r"[^a-zA-Z0-9一-鿿]", "", t)
        w = re.findall(r"[a-zA-Z0-9]+|[一-鿿]", t)
        c = {kept[i : i + 8] for i in range(len(kept) - 7)}
        return c, {":".join(w[i : i + 3]) for i in range(len(w) - 2)}, [min((hashlib.md5(f"{s}{g}".encode()).hexdigest()[:16] for g in c), default="f" * 16) for s in range(rules.hashes)]

    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    sets = {i: grams(t) for i, t in docs}
    out = {}
    for i in sets:
        for j in sets:
            if i < j:
                (a, b, c), (d, e, f) = sets[i], sets[j]
                total = (jaccard(a, d) + jaccard(b, e) + sum(x == y for x, y in zip(c, f, strict=True)) / rules.hashes) / 3
                out[i, j] = round(total, 4)
    return out


def test_no_pair_is_lost_by_the_index(spark):
    """Pairs around the threshold, texts too short for a character gram among them, and a line that all share."""
    r = random.Random(2)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    docs = [(i, " ".join("z" + str(r.randrange(9999)) if r.random() < i / 90 else w for w in base) + " all of us share this line of words") for i in range(60)]
    docs += [(100 + i, " ".join(r.choices("abc", k=6))) for i in range(25)]
    rules = Similarity(hashes=16)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(x.a, x.b): x.similarity for x in similarity.similar_pairs(df, rules).collect()}
    classes = {x.doc_id: x["class"] for x in similarity.classes(df, rules)[1].collect()}
    force = {k: s for k, s in similar_by_force(docs, rules).items() if s >= rules.suspect and classes[k[0]] == k[0] and classes[k[1]] == k[1]}
    assert len(force) > 100 and found.keys() == force.keys()
    assert all(abs(found[k] - force[k]) < 1.1e-4 for k in force)


def test_the_index_lists_few_pairs_of_a_shared_line(spark):
    """A line that every text has is no entry that pairs meet by."""
    r = random.Random(3)
    docs = [(i, " ".join(f"u{r.randrange(10**9)}" for _ in range(30)) + " licensed under the terms of the public licence of us all") for i in range(400)]
    rules = Similarity(hashes=16)
    sets, _ = similarity.classes(spark.createDataFrame(docs, "doc_id long, text string"), rules)
    listed = similarity.index(sets, rules)
    assert similarity.candidates(listed, listed, rules).count() < 400


def test_a_snapshot_that_fails_midway_leaves_the_one_before(spark, tmp_path):
    folder, schemas = str(tmp_path / "kept"), {"a": "id long", "b": "id long", "c": "id long"}
    assert store.load(spark, folder, schemas)["a"].count() == 0
    assert store.save({"a": spark.range(3), "b": spark.range(5)}, folder) == 1
    with pytest.raises(Exception, match="on purpose"):
        store.save({"a": spark.range(30), "b": spark.range(50).select(F.raise_error(F.lit("on purpose")).cast("long").alias("id"))}, folder)
    found = store.load(spark, folder, schemas)
    assert [found[n].count() for n in "abc"] == [3, 5, 0]
    # what is read may be replaced, and older snapshots go
    assert store.save({"a": found["a"].union(spark.range(10, 11)), "b": found["b"]}, folder) == 2
    assert store.load(spark, folder, schemas)["a"].count() == 4 and store.load(spark, folder, schemas, 1)["a"].count() == 3
    assert store.save({"a": spark.range(1)}, folder) == 3
    assert sorted(os.listdir(folder)) == ["00000002", "00000003", "manifests"]


def test_new_documents_meet_a_kept_index(spark, small, tmp_path):
    """Pairs found part by part, each part against the index of those before, are those of the whole."""
    rules = Similarity(hashes=16)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    whole = {(r.a, r.b, r.similarity) for r in similarity.compared(similarity.classes(docs, rules)[0], rules).select("a", "b", "similarity").collect()}
    kept, found = str(tmp_path / "index"), set()
    reps = similarity.classes(docs, rules)[0].select(F.col("class").alias("doc_id"))
    for part in range(3):
        new = docs.join(reps, "doc_id", "left_semi").where(F.col("doc_id") % 3 == part)
        found |= {(min(r.a, r.b), max(r.a, r.b), r.similarity) for r in similarity.against_kept(new, rules, kept).collect()}
    assert found == whole and len(whole) > 5
