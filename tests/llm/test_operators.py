"""Brute force, round trips, held-out accuracy and edge cases of the training-data operators."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parchment.llm import common, decontaminate, graph, langid, media, packing, pii, quality, queries, simhash, suffixes, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def middle():
    return "/root/testdata/sf0.01"


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an extra column with a clashing name."""
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "some text of no id"), (4, long), (4, long), (5, "!!!"), (6, long), (7, "x" * 100_000), (None, None), (8, "tiny")]
    return spark.createDataFrame([(i, t, None, "s", 0, "clash") for i, t in rows], DOCS + ", key string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def repeats_by_force(texts, n=50):
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    seen, first = collections.Counter(), {}
    for i in sorted(words):
        for at in range(len(words[i]) - n + 1):
            w = tuple(words[i][at : at + n])
            seen[w] += 1
            first.setdefault(w, (i, at))
    out = set()
    for i, ws in words.items():
        spans, later = [], set()
        for at in range(len(ws) - n + 1):
            w = tuple(ws[at : at + n])
            if seen[w] > 1:
                if first[w] != (i, at):
                    later |= set(range(at, at + n))
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + n
                else:
                    spans.append([at, at + n])
        out |= {(i, a, b, b - a, sum(x in later for x in range(a, b))) for a, b in spans}
    return out


def test_op1_against_brute_force(spark, small, docs):
    assert {tuple(r) for r in queries.op1_suffix_array_dedup(spark, small).collect()} == repeats_by_force(docs)


def test_op1_short_passages(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(8)]
    texts = {}
    for i in range(60):
        ws = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]
        if i % 3 == 0:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = passage
        texts[i] = " ".join(ws)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in suffixes.repeats(rows, min_words=8, prefix=4).collect()} == repeats_by_force(texts, 8)


def test_op1_rows_without_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = spark.createDataFrame([(None, one), (None, two), (5, "x " + one), (None, "y y " + two)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.start_word, r.stop_word) for r in suffixes.repeats(rows).collect())
    assert found == [(0, 0, 60), (0, 0, 60), (0, 2, 62), (5, 1, 61)]


def test_op1_ranges_decide_nothing(spark, small, docs, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLE", (3, 1000))
    found = {tuple(r) for r in suffixes.repeats(spark.read.parquet(f"{small}/documents.parquet").repartition(5)).collect()}
    assert found == repeats_by_force(docs)


def test_op1_edges(spark, odd):
    found = {(r.doc_id, r.n_words) for r in suffixes.repeats(odd).collect()}
    assert found == {(4, 20_000), (6, 20_000)}
    assert suffixes.repeats(empty(spark)).count() == 0


# 2


def test_op2_round_trip(spark, small, docs):
    for r in queries.op2_media_columns(spark, small).collect():
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op2_edges(spark, odd):
    rows = media.digest(media.store_texts(odd)).collect()
    assert len(rows) == 11 and all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in rows)
    assert len({r.media_sha256 for r in rows if r.doc_id == 4}) == 1
    assert media.digest(media.store_texts(empty(spark))).count() == 0


def test_op2_containers(spark):
    good = media.encode(media.payload_of("x" * 5000)[0])
    rows = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, good[:200]), (5, b"\0\0\0\x04moov")], "id long, media binary")
    found = {r.id: r for r in media.media_columns(rows).collect()}
    assert found[1].codec == "raw " and found[1].frames == 79 and found[1].duration_s == 79 / 25 and len(found[1].keyframes) == 5 and found[1].error is None
    assert all(found[i].codec is None and found[i].error for i in (2, 3, 4, 5))
    first = found[1].keyframes[0]
    assert good[first.offset : first.offset + first.length] == b"x" * 64


def track(kind, entry, chunk, size, number, wide=False, table=True):
    """A track of two samples that lie one after the other."""
    import struct as st

    offsets = media.full(b"co64", st.pack(">IQ", 1, chunk)) if wide else media.full(b"stco", st.pack(">II", 1, chunk))
    rows = (media.full(b"stts", st.pack(">III", 1, 2, 10)), media.full(b"stsc", st.pack(">IIII", 1, 1, 2, 1)), media.full(b"stsz", st.pack(">II", size, 2)), offsets)
    none = (media.full(b"stts", bytes(4)), media.full(b"stsc", bytes(4)), media.full(b"stsz", bytes(8)), media.full(b"stco", bytes(4)))
    body = media.box(b"stbl", media.full(b"stsd", st.pack(">I", 1), media.box(entry, bytes(24), st.pack(">HH", 6, 4), bytes(50))), *(rows if table else none))
    head = media.full(b"tkhd", st.pack(">IIIII", 0, 0, number, 0, 20), bytes(60))
    return media.box(b"trak", head, media.box(b"mdia", media.full(b"mdhd", st.pack(">IIIII", 0, 0, 10, 20, 0)), media.full(b"hdlr", bytes(4), kind, bytes(13)), media.box(b"minf", body)))


def test_op2_tracks_are_kept_apart():
    audio, video = track(b"soun", b"mp4a", 0, 3, 1), track(b"vide", b"avc1", 100, 5, 2, wide=True)
    file = media.box(b"moov", audio, video) + bytes(2000)
    x = media.parse(file)
    assert (x["codec"], x["width"], x["height"]) == ("avc1", 6, 4) and x["start"].tolist() == [100, 105] and x["size"].tolist() == [5, 5]
    x = media.parse(media.box(b"moov", audio) + bytes(2000))
    assert x["codec"] == "mp4a" and x["start"].tolist() == [0, 3] and x["width"] == 0


def test_op2_fragments():
    import struct as st

    moov = media.box(b"moov", track(b"vide", b"avc1", 0, 0, 7, table=False), media.box(b"mvex", media.full(b"trex", st.pack(">IIIII", 7, 1, 10, 4, 0x10000))))
    def moof(offset):
        return media.box(b"moof", media.full(b"mfhd", bytes(4)), media.box(b"traf", media.full(b"tfhd", st.pack(">I", 7), flags=0x20000), media.full(b"trun", st.pack(">Iii", 3, offset, 0), st.pack(">III", 4, 6, 8), flags=0x205)), media.box(b"traf", media.full(b"tfhd", st.pack(">I", 8)), media.full(b"trun", st.pack(">I", 5))))
    size = len(moof(0)) + 8
    file = moov + moof(size) + media.box(b"mdat", b"aaaabbbbbbcccccccc")
    x = media.parse(file)
    assert media.samples(file, x) == b"aaaabbbbbbcccccccc" and x["keys"].tolist() == [0] and x["ticks"] == 30 and x["frames"] == 3


def test_op2_damaged_files_are_told(spark):
    rng = random.Random(2)
    good = media.encode(media.payload_of("y" * 3000)[0])
    for _ in range(6000):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(good) - 3100)
            bad[at : at + 4] = rng.choice((bytes(rng.randrange(256) for _ in range(4)), b"\xff" * 4, bytes(4)))
        try:
            media.samples(bytes(bad), media.parse(bytes(bad[: rng.choice((len(bad), rng.randrange(len(bad))))])))
        except media.Malformed:
            pass
    rows = media.media_columns(spark.createDataFrame([(good, "mine", "x", 1)], "media binary, codec string, _media string, error int"))
    assert rows.columns == ["media", "_media", "codec", "width", "height", "frames", "duration_s", "keyframes", "error"] and rows.first().codec == "raw "


# 3


def fingerprint_by_force(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_op3_against_brute_force(spark, small, docs):
    prints = {i: fingerprint_by_force(t) for i, t in docs.items()}
    roots = components_by_force(prints.values())
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    expected = {(i, f"{f:016x}", least[roots[f]]) for i, f in prints.items()}
    assert {tuple(r) for r in queries.op3_simhash_near_dedup(spark, small).collect()} == expected


def test_op3_keys_are_not_broadcast(spark):
    """A fingerprint has dozens of keys, which Spark's size check counts as one row."""
    distinct = spark.range(2000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    found = simhash.links(distinct)
    found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_op3_keys_find_every_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(200)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for f in base for _ in range(3)]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    fs = sorted({signed(f) for f in base + near})
    expected = {(a, b) for i, a in enumerate(fs) for b in fs[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fs], "fp long")).collect()} == expected


def test_op3_edges(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    kept = simhash.representatives(odd).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 4, 5, 7, 8] and kept[0].key == "clash"
    assert simhash.near_duplicates(empty(spark)).count() == simhash.representatives(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(found[i] == 0 for i in range(201)) and found[501] == 500


# 4


def test_op4_against_sql(spark, tables, small):
    ours = queries.op4_url_filters(spark, small).toPandas().sort_values(["page_id"]).reset_index(drop=True)
    theirs = tables.execute(queries.oracle_sql()["op4_url_filters"]).fetchdf().sort_values(["page_id"]).reset_index(drop=True)
    assert ours.astype(object).where(ours.notna(), None).values.tolist() == theirs[list(ours.columns)].astype(object).where(theirs[list(ours.columns)].notna(), None).values.tolist()


def test_op4_edges(spark):
    captures = spark.createDataFrame([(1, "http://A.b.com/x", "2024-01-05", "k"), (1, "http://A.b.com/x", "2024-01-05", "k"), (2, None, "2024-01-05", None), (3, "http://b.com:80", None, None), (4, "nonsense", "2024-01-05", None), (5, "https://u@www.b.com./", "2024-02-01", None)], "id long, url string, fetched string, pattern string")
    entries = spark.createDataFrame([("b.com", "l", "block", "2024-01-01", "add"), ("B.com", "l", "block", "2024-02-01", "remove"), ("b.com", "l", "block", "2024-02-01", "add"), ("a.b.com", "ok", "allow", "2024-01-05", "add"), (None, "l", "block", "2024-01-01", "add")], "pattern string, list_name string, kind string, day string, action string")
    rows = urls.evaluate(captures, entries).collect()
    by = {r.id: r for r in rows}
    assert len(rows) == 6 and by[1].active_lists == "l,ok" and not by[1].blocked and by[1].pattern == "k"
    assert by[2].host is None and by[4].host is None and not by[3].blocked and by[5].n_active == 0
    clash = spark.createDataFrame([(1, "http://[::1]:8/x", "2024-01-05", "mine", "salt", "h")], "id long, url string, fetched string, host string, _salt string, _host string")
    assert urls.evaluate(clash, entries).first().asDict() == {"id": 1, "url": "http://[::1]:8/x", "fetched": "2024-01-05", "_salt": "salt", "_host": "h", "host": "[::1]", "n_active": 0, "active_lists": "", "blocked": False}
    assert urls.evaluate(captures, entries.limit(0)).where("blocked").count() == 0
    assert urls.evaluate(captures.limit(0), entries).count() == 0


# 5, 6, 7


def held_out(spark, small, name, modulus, rest):
    found = {r.doc_id: r for r in queries.queries()[name](spark, small).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest) and 0 <= r.score <= 1 for i, r in found.items())
    return found


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def test_op5_held_out_accuracy(spark, small):
    found = held_out(spark, small, "op5_language_id", 3, 1)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    right = [found[i].lang_pred == lang for i, lang in langs.items() if found[i].held_out]
    assert np.mean(right) > 0.97


def test_op5_edges(spark, odd):
    model = langid.fit(["the cat and the dog", "der Hund und die Katze"] * 20, ["en", "de"] * 20)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == 11 and sum(r.lang_pred == "und" for r in rows) == 5 and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert model.predict("Die Katze!")[0] == "de" and (model.weights == 0).mean() > 0.5
    assert langid.train(odd).predict("some text") == ("und", 0.0)
    assert langid.fit(["a"], ["x"]).predict("b") == ("x", 1.0)
    assert langid.identify(empty(spark), model).count() == 0


def told_apart(spark, folder, name, label, cut):
    """AUC, precision and recall over the rows that were never learnt from."""
    found = held_out(spark, folder, name, 4, 2)
    assert all(r.predicted == (r.score >= cut) for r in found.values())
    rows = [(found[r.doc_id].score, found[r.doc_id].predicted, r[label]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if found[r.doc_id].held_out]
    hits = sum(p and y for _, p, y in rows)
    return auc([(s, y) for s, _, y in rows]), hits / max(sum(p for _, p, _ in rows), 1), hits / sum(y for *_, y in rows)


def test_op6_held_out(spark, middle):
    area, precision, recall = told_apart(spark, middle, "op6_quality_classifier", "quality", 0.7)
    assert area > 0.97 and precision > 0.95 and recall > 0.95


def test_op6_gradient_is_the_slope():
    """One step of the training's gradient against differences of its loss."""
    rng = np.random.default_rng(6)
    texts = ["some words here and there. " * 20, "BAD!! 123 ### " * 30, "more of the other words " * 25]
    model = quality.fit(texts, [1, 0, 1], epochs=2)
    xs = [np.clip((quality.encode(t) - model.mean) / model.scale, -8, 8) for t in texts]
    x, bag, y = np.concatenate(xs), np.repeat(np.arange(3), [len(v) for v in xs]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(model.forward(x, bag, 3)["p"]) + (1 - y) * np.log(1 - model.forward(x, bag, 3)["p"]))
    grads = quality.gradient(model, x, bag, y)
    for name in ("E", "V", "U", "a", "c"):
        at = tuple(rng.integers(0, n) for n in model.w[name].shape)
        kept, step = model.w[name][at], 1e-5
        model.w[name][at] = kept + step
        up = loss()
        model.w[name][at] = kept - step
        slope = (up - loss()) / (2 * step)
        model.w[name][at] = kept
        assert np.isclose(grads[name][at], slope, atol=1e-6), name


@pytest.fixture(scope="module")
def abuse(spark):
    """A model learnt from the larger table, and its scores and labels of the rows held out."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    apart = common.id_bucket(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, labels.where(~apart))
    rows = docs.join(labels.where(apart), "doc_id").select("text", "toxic").collect()
    return model, list(zip(model.scores([r.text for r in rows]), [r.toxic for r in rows], strict=True))


def test_op7_held_out(spark, small, abuse):
    assert all(r.predicted == (r.score >= 0.3) for r in held_out(spark, small, "op7_toxicity", 4, 2).values())
    rows = abuse[1]
    hits = sum(p >= 0.3 and y for p, y in rows)
    assert auc(rows) > 0.95 and hits / sum(p >= 0.3 for p, _ in rows) > 0.9 and hits / sum(y for _, y in rows) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, odd, module):
    texts = ["you idiot and moron. bad", "A clean sentence of words. Another one."] * 30
    model = module.fit(texts, [1, 0] * 30)
    rows = module.score(odd, model).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert module.score(empty(spark), model).count() == 0
    assert module.fit([], []).scores(["x", None]).tolist() == [0.5, 0.5] and module.fit(["x"], [1]).scores(["y"]).tolist() == [1.0]


def test_op6_attention_weighs_the_passages():
    model = quality.fit(["good words here. " * 40, "BAD!! ### $$$ " * 40] * 20, [1, 0] * 20)
    weights = model.attention("good words here. " * 100)
    assert len(weights) > 1 and np.isclose(weights.sum(), 1)


def test_op7_kernel_is_the_subsequence_kernel():
    from itertools import combinations

    def features(x):
        found = collections.Counter()
        for c in combinations(range(len(x)), 3):
            if c[-1] - c[0] < toxicity.SPAN:
                found["".join(x[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return found

    def force(s, t):
        a, b = features(f"^^{s}$"), features(f"^^{t}$")
        dot = lambda x, y: sum(v * y[k] for k, v in x.items())
        return (dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))) ** toxicity.POWER

    rng = random.Random(7)
    landmarks = ["idiot", "scum", "trashy", "réeux"]
    words = [*landmarks, "id1ot", "idxiot", "friend", "a", "scumbag", "xyz", *("".join(rng.choice("idotscumr") for _ in range(rng.randrange(1, 14))) for _ in range(200))]
    found = toxicity.Kernel(landmarks).rows(words)
    for w in words:
        expected = np.array([force(w, x) for x in landmarks])
        assert np.allclose(found.get(w, np.zeros(4)), np.where(expected < toxicity.TINY, 0, expected), atol=1e-4), w


def test_op7_nystrom_gives_back_the_landmarks_kernel():
    chosen = ["idiot", "scum", "trash", "friend"]
    rows = toxicity.Kernel(chosen).rows(chosen)
    gram = np.array([rows[w] for w in chosen])
    values, vectors = np.linalg.eigh(gram)
    mapped = gram @ (vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T)
    assert np.allclose(mapped @ mapped.T, gram, atol=1e-6)


def test_op7_machine_separates():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(2, 0.3, (50, 3)), rng.normal(-2, 0.3, (50, 3))))
    y = np.repeat([1.0, -1.0], 50)
    direction, bias = toxicity.separate(x, y, np.ones(100))
    assert ((x @ direction - bias) * y > 0.9).all()


def test_op7_tolerates_gaps(abuse):
    """Insults that were split, gapped, spelt out or changed in one place, against the same sentence without any."""
    model = abuse[0]
    words = [w for w in ("idiot", "moron", "trash", "scum", "loser", "stupid", "pathetic", "worthless", "clown", "disgusting") if w in model.kernel.landmarks]
    said = lambda w: f"you are a {w} and the rest of this is a plain sentence of words"
    share = lambda change: np.mean(model.scores([said(change(w)) for w in words]) >= toxicity.PREDICT_AT)
    assert len(words) >= 5 and model.scores([said("friend")])[0] < 0.1 and share(str) == 1
    assert share(lambda w: "-".join(w)) == share(lambda w: f"{w[:2]} {w[2:]}") == share(lambda w: f"{w[:2]}*{w[2:]}") == 1
    assert share(lambda w: f"{w[:3]}x{w[3:]}") >= 0.6 and share(lambda w: w[:2] + w[3:]) >= 0.3


# 8


def test_op8_pieces_and_ids(spark, small, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in docs.items()}
    rows = queries.op8_packing(spark, small).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, x in ids.items():
        assert sum(r.length for r in by[i]) == len(x) and sorted(r.start for r in by[i]) == np.cumsum([0] + [r.length for r in sorted(by[i], key=lambda r: r.start)]).tolist()[:-1]
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    used = sum(r.length for r in rows)
    assert used / (1024 * len(sequences)) > 0.99


def test_op8_special_and_odd_texts_have_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(*queries.tokenizer())
    rng = random.Random(8)
    texts = ["<|endoftext|>", " a<|endoftext|> b", "a \n  b", "a   b \n", "\x1c a \x1d b", "a\u3000 b \u3000c", " ", "  ", "", "\x00\x1f", "　é́", "\U0001f600 x", "it's I'LL  \n\n\t x", "a" * 5000]
    texts += ["".join(rng.choice("ab '\n\t1é中<|>_-.  s") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert own.encode(t, add_special_tokens=False).ids == ours.ids(t).tolist(), t


def test_op8_neighbours_share_words():
    tails = [np.array(x, "<u2") for x in ([1, 2, 3, 4] * 3, [9, 8, 7, 6] * 3, [1, 2, 3, 5] * 3, [9, 8, 7, 5] * 3)]
    windows = packing.fill(tails, np.ones(16, np.float32), 12.0, 24)
    assert [[t for t, _, _ in w] for w in windows] == [[0, 2], [1, 3]]


def bm25_by_force(tails, seed, seen, mean):
    n, counts = len(tails), [collections.Counter(t.tolist()) for t in tails]
    idf = {t: np.log(1 + (n - seen[t] + 0.5) / (seen[t] + 0.5)) for t in counts[seed]}
    return [sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t in idf if t in c) for c, own in zip(counts, tails)]


def tails_of(texts):
    encode = packing.encoder(*queries.tokenizer()).ids
    found = [np.append(encode(t or ""), 0).astype("<u2") for t in texts]
    return [x[len(x) // 1024 * 1024 :] for x in found if len(x) % 1024]


def test_op8_scores_are_bm25(docs):
    tails = tails_of(docs.values())[:120]
    seen = collections.Counter(t for x in tails for t in set(x.tolist()))
    mean = float(np.mean([len(t) for t in tails]))
    idf = np.log(1 + (len(tails) - np.array([seen[t] for t in range(1 << 16)]) + 0.5) / (np.array([seen[t] for t in range(1 << 16)]) + 0.5)).astype(np.float32)
    index = packing.Index(tails, idf, mean)
    for seed in range(0, len(tails), 17):
        assert np.allclose(index.scores(seed), bm25_by_force(tails, seed, seen, mean), rtol=1e-4, atol=1e-3)


def test_op8_neighbours_over_several_shards(spark, middle):
    """Near copies (resemblance 0.8 or more) share a shard in nine of ten cases, and the best tail of a seed's shard scores nearly what the best of all does."""
    rows = spark.read.parquet(f"{middle}/documents.parquet").repartition(4)
    spans = packing.tokenize(rows, *queries.tokenizer()).persist()
    idf, mean, n = packing.statistics(spans)
    placed = packing.ordered(spans, idf, n).orderBy("leaf", "least", "doc_id", "start").collect()
    spans.unpersist()
    tails = [np.frombuffer(r.ids, "<u2") for r in placed]
    runs = [{bytes(t[i : i + 4]) for i in range(len(t) - 3)} for t in tails]
    index, shard = packing.Index(tails, idf, mean), 100
    near, best, share = [], [], []
    for seed in range(n):
        score = index.scores(seed)
        score[seed] = -1
        top = int(score.argmax())
        best.append(seed // shard == top // shard)
        share.append(score[seed // shard * shard : (seed // shard + 1) * shard].max() / score[top])
        near += [seed // shard == t // shard for t in np.argsort(-score)[:5] if len(runs[seed]) > 50 and len(runs[seed] & runs[t]) >= 0.8 * len(runs[seed] | runs[t])]
    print(n, len(near), np.mean(near), np.mean(best), np.mean(share))
    assert n > 900 and len(near) > 30 and np.mean(near) >= 0.9
    assert np.mean(best) > 3 * shard / n and np.mean(share) > 0.9  # of random shards: 1 in 10


def test_bounded_rows_are_bounded_at_any_size(spark):
    total = 5 * 10**10
    assert 0.99 < common.threshold(4000, total) / 2**62 * total / 4000 < 1.01 and common.threshold(5, 3) == 2**62
    rows = spark.createDataFrame([(i, "x" * 10) for i in range(500)] + [(7, "y")] * 500, "k long, t string")
    found = common.bounded_rows(rows, "t", 100, 1000)
    assert 60 < len(found) <= 100 and len(set(found)) == len(found) and found == common.bounded_rows(rows, "t", 100, 1000)
    assert len(common.bounded_rows(rows, "t", 100, 1000, most_bytes=205)) <= 21 and len(common.bounded_rows(rows, "t", 10_000, 1000)) == 501


def test_op8_edges(spark, odd):
    rows = packing.pack(odd, *queries.tokenizer()).collect()
    by = collections.Counter(r.doc_id for r in rows if r.start == 0)
    assert by == {None: 2, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1} and [r.doc_tokens for r in rows if r.doc_id == 1] == [1]
    assert packing.pack(empty(spark), *queries.tokenizer()).count() == 0


# 9

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_by_force(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_op9_against_brute_force(spark, small, docs):
    for r in queries.op9_pii(spark, small).collect():
        base = spans_by_force(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(filter(None, r.spans.split(",")))
        assert r.n_email == sum(x.startswith("email") for x in base)


def test_op9_random_texts(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("0123456789 .-+()@aB%é\U0001f600_,"[: rng.choice((12, 18, 27))]) for _ in range(rng.choice((5, 40, 300)))) for _ in range(800)]
    texts += ["a@b.co " * 3000, "1.2.3.4 4111 1111 1111 1111 +1 (243) 555-5526", "x@" + "a." * 2000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.digest(pii.find(rows)).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(spans_by_force(texts[r.doc_id])).encode()).hexdigest(), texts[r.doc_id][:90]


def test_op9_discovers_by_context(spark):
    rows = [(i, f"please call my number +1 555 010 {1000 + i} today or write to email box user{i}@mail.example.com thanks") for i in range(40)]
    rows += [(100, "please call my number 555-0100-99 today"), (101, "please write to email box someone@localhost thanks"), (102, "a serial 555-0100-98 elsewhere")]
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[100] == "phone:22:33" and found[101] == "email:26:43" and found[102] == ""


def test_op9_discovers_spaced_numbers(spark):
    rows = [(i, f"please call my number +1 555 010 {1000 + i} today or pay with my card 4{i + 100} 1111 1111 11{d:02d} for now") for i in range(60) for d in range(100)]
    rows = [r for r in rows if any(x.startswith("card") for x in spans_by_force(r[1]))]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    more = ["please call my number (030) 123 4567 today", "please pay with my card 4111 1111 1111 1112 for now", "a serial (030) 123 4568 elsewhere"]
    rows += [(10_000 + n, t) for n, t in enumerate(more)]
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [found[10_000 + n] for n in range(3)] == ["phone:22:36", "card:24:43", ""]


def test_op9_contexts_run_on_through_other_numbers(spark):
    [row] = pii.spot(spark.createDataFrame([(1, "code a1b2c3 12345678 z9 end")], "doc_id long, text string")).collect()
    assert [(s.left, s.right) for s in row.tokens if s.value == "12345678"] == [("code a1b2c3 ", " z9 end")]


def test_op9_follows_long_chains(spark):
    at = lambda step, value: f"{'abcdef'[step]}first {'abcdef'[step]}second {value} {'abcdef'[step]}after"
    texts = [at(0, f"+1 555 010 {1000 + i}") for i in range(40)]
    for step in range(5):  # each value stands where known ones stand, and once where the next do
        texts += [at(s, f"555-0{step}00-{i}") for i in range(10, 50) for s in (step, step + 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.spans.startswith("phone:") for r in pii.digest(pii.find(rows)).collect())


def test_op9_edges(spark, odd):
    rows = pii.digest(pii.find(odd)).collect()
    assert len(rows) == 11 and all(r.spans == "" for r in rows if r.doc_id != 4)
    some = spark.createDataFrame([(None, "x a@b.co y"), (1, "1.2.3.4"), (1, "1.2.3.4"), (2, None)], "doc_id long, text string")
    assert sorted(r.text or "" for r in pii.redact(some, pii.find(some)).collect()) == ["", "[IP]", "[IP]", "x [EMAIL] y"]
    clash = spark.createDataFrame([(1, "k", "s", "a 1.2.3.4", 7)], "doc_id long, _key string, spans string, text string, id long")
    assert pii.redact(clash, pii.find(clash)).first().asDict() == {"doc_id": 1, "_key": "k", "spans": "s", "text": "a [IP]", "id": 7}
    same = spark.createDataFrame([(1, "k", "f", "text", "r")], "doc_id long, _rank string, _fp string, text string, c0 string")
    assert simhash.representatives(same).first().asDict() == {"doc_id": 1, "_rank": "k", "_fp": "f", "text": "text", "c0": "r"}
    assert pii.digest(pii.find(empty(spark))).count() == 0


# 10


def edit_by_force(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_op10_distance():
    rng = random.Random(10)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 80))) for _ in range(2))
        assert decontaminate.distance(decontaminate.masks(p), len(p), t)[0] == edit_by_force(p, t)


def test_op10_against_brute_force(spark, small, docs):
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {i: decontaminate.normal(t) for i, t in docs.items() if len(t) < 2500}
    expected = {}
    for i, t in texts.items():
        for n, p in items:
            d = decontaminate.distance(decontaminate.masks(p), len(p), t)[0]
            if d <= len(p) // 16:
                expected[i, n] = d
    found = {(r.doc_id, r.item_id): r.distance for r in queries.op10_decontamination(spark, small).collect()}
    assert {k: d for k, d in found.items() if k[0] in texts} == expected


def test_op10_edits_and_edges(spark, odd):
    item = "the quick brown fox jumps over the lazy dog and runs far away from the busy old town today"
    edited = "xx " + item.replace("brown", "brwn").replace("lazy", "lazzy").upper() + " yy"
    rows = spark.createDataFrame([(1, edited), (2, item), (3, item[:40]), (None, item)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "short")], "item_id long, text string")
    found = decontaminate.hits(rows, items, block_chars=50).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in found) == sorted([(1, 7, 2), (2, 7, 0), (0, 7, 0)] * 2)
    assert decontaminate.clean(odd, items).count() == 11 and decontaminate.hits(rows, items.limit(0)).count() == 0


def test_op10_short_items_match_exactly_between_words(spark):
    rows = spark.createDataFrame([(1, "So: who is Ada? asked"), (2, "who is adam"), (3, "who iss ada"), (4, "他说中国的首都是哪里呢"), (5, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Who is Ada?"), (2, "首都是哪里"), (3, "?!")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.hits(rows, items).collect()) == [(1, 1, 0), (4, 2, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(rows, items).collect()) == [2, 3, 5]


def test_sample_of_repeated_and_of_oversized_rows(spark):
    from pyspark.sql.functions import expr

    repeated = spark.range(1_000_000).select(expr("id % 100").alias("k"), expr("concat('text number ', id % 100)").alias("t"))
    assert {r.k for r in common.bounded_rows(repeated, "t", 4000, 1_000_000)} == set(range(100))
    lang = "element_at(array('en', 'de', 'fr', 'es'), cast(id % 4 + 1 as int))"
    docs = spark.range(1_000_000).select(expr("id % 100 as doc_id"), expr(f"concat(repeat(substring('the of und der les aux los del', cast(8 * (id % 4) + 1 as int), 8), 5), cast(id % 100 as string)) as text"), expr(f"{lang} as lang"))
    assert langid.train(docs).languages == ["de", "en", "es", "fr"]
    uneven = spark.createDataFrame([(i, "x" * (3900 if i < 3 else 10)) for i in range(23)], "k long, t string")
    assert {r.k for r in common.bounded_rows(uneven, "t", 100, 23, most_bytes=4000)} == set(range(3, 23))


def test_labels_of_absent_documents_leave_the_sample_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.range(50_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert len(quality.labelled(docs, labels, "quality", 100)[0]) >= 50


def test_op10_surroundings_of_hits_are_joined_as_they_come():
    import tracemalloc

    rng = random.Random(1)
    for _ in range(300):
        spans, expected = [], []
        for _ in range(rng.randrange(1, 30)):
            a = rng.randrange(200)
            b = a + rng.randrange(1, 20)
            decontaminate._join(spans, a, b)
            expected.append((a, b))
        expected.sort()
        merged = []
        for a, b in expected:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        assert spans == merged
    index = decontaminate.Index([(1, "0 " * 499 + "0", False), (2, "abcd efgh " * 9 + "abcd", False)], 16)
    tracemalloc.start()
    found = index.search("0 " * 200_000)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000 and [f[:2] for f in found] == [(1, 0)]
    tracemalloc.stop()
    assert [f[:2] for f in index.search("x" * 500 + " " + "abcd efgh " * 4 + "abcX efgh " + "abcd efgh " * 4 + "abcd")] == [(2, 1)]
