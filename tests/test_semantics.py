"""Where Python's semantics differ from Java's or SQL's, and what the twins cannot cover."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import completeness, detect, evaluate, report, scorer, scoring, segment, similarity
from parchment.plans import review
from parchment.plans.rubric import Completeness, Detection, Dimension, Scale, Section, Similarity, rubric_from
from parchment.sources import files, settings, store
from parchment.streaming import arrivals


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("value", ["　a b　", "\x1c\x85x ", "", "  ", "a\n"])
def test_strip_is_pythons(spark, value):
    assert one(spark, T.strip, value) == value.strip()


def test_words_count_han_and_ascii_runs(spark):
    assert one(spark, T.word_count, "中文 abc déf 12") == 2 + 1 + 2


def test_title_skips_labels_and_long_lines(spark):
    text = "题目：x\n" + "y" * 100 + "\n\n  the one \nlast"
    assert one(spark, lambda c: T.title(T.filled_lines(c)), text) == "  the one "
    assert one(spark, lambda c: T.title(T.filled_lines(c)), "") == T.NO_TITLE


def test_last_run_with_content_counts(spark):
    text = "head\nAbstract\none\n摘要\ntwo\nConclusion\nend\n摘 要\n参考文献\n[1] a"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {r.cls: r.content for r in segment.sections(docs).collect()}
    assert found == {"header": "head", "abstract": "two", "conclusion": "end", "references": "[1] a"}


def test_zero_weights_do_not_divide_by_zero(spark):
    rules = Completeness(sections=(Section("a", ("zzz",), 0), Section("b", ("x",), 0)))
    rows = spark.createDataFrame([("x", 1, 1, 0, 0)], "text string, words long, paragraphs long, references long, figures long")
    assert completeness.check(rows, rules).first().s_sections == 20.0


def test_detector_cases(spark):
    p = lambda hits, fmt, img, seg, w=0.25: spark.range(1).select(detect.probability(F.lit(hits), F.lit(fmt), F.lit(img), F.lit(seg), Detection(image_weight=w))).first()[0]
    assert p(16, 0, 0, 0) == 0.5 and p(11, 0, 0, 0) == 0.4 and p(6, 0, 0, 0) == 0.25 and p(3, 0, 0, 0) == 0.15 and p(2, 0, 0, 0) == 0
    assert p(0, 0, 5, 0, 0.5) == 1.0 and p(0, 0, 5, 0, 0.1) == 0.5
    assert p(0, 0, 0, 99) == 0.4


def test_context_is_of_the_first_occurrence(spark):
    docs = spark.createDataFrame([(1, "x" * 30 + "abc\n" + "y" * 30 + "abc")], "doc_id long, text string")
    found = detect.contexts(docs, ("abc",)).collect()
    assert [r.context for r in found] == ["x" * 20 + "abc " + "y" * 19] * 2


def test_similarity_properties(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "the quick brown fox jumps over it"), (4, "the quick brown fox jumps over it"), (5, "the quick brown fox jumps over me"), (6, None), (7, "a b c"), (8, "a b c"), (9, "слово другое"), (10, "совсем иное")], "doc_id long, text string")
    rules = Similarity(hashes=16)
    sets, members = similarity.classes(docs, rules)
    classes = dict((r.doc_id, r["class"]) for r in members.collect())
    assert classes == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}  # without any gram texts are not alike
    pairs = similarity.similar_pairs(docs, rules).collect()
    assert [(r.a, r.b) for r in pairs] == [(3, 5)] and 0 < pairs[0].similarity < 1
    rolled = {r.doc_id: (r.highest, r.partner, r.links) for r in similarity.rollup(members, similarity.compared(sets, rules), rules).collect()}
    assert rolled[3] == (1.0, 4, 2) and rolled[4] == (1.0, 3, 2) and rolled[5] == (pairs[0].similarity, 3, 2)
    assert rolled[7] == (0.6667, 8, 1) and rolled[1] == rolled[6] == rolled[9] == (0.0, -1, 0)
    segments = similarity.common_segments(spark.createDataFrame([(3, 5)], "a long, b long"), docs, Similarity(min_match=10)).collect()
    assert segments[0].segment == "the quick brown fox jumps over "
    with pytest.raises(ValueError):
        similarity.compared(sets, Similarity(suspect=0.3))


def test_a_judge_sees_high_pairs_only(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(("x a", "x b", "y", "broken"))], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1, 0.9, "g"), (1, 2, 0.7, "g"), (0, 2, 0.5, "g"), (0, 3, 0.8, "g")], "a long, b long, similarity double, severity string")

    def judge(a, b):
        if "broken" in b:
            raise TimeoutError("late")
        return "非抄袭" if b == "y" else "抄袭"

    found = {(r.a, r.b): (r.verdict, r.plagiarism) for r in similarity.judged(pairs, docs, judge, Similarity()).collect()}
    assert found == {(0, 1): ("抄袭", True), (1, 2): ("非抄袭", False), (0, 2): (None, True), (0, 3): ("AI 判断失败: late", True)}


def test_copies_lose_the_penaltys_share(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from town"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "a wholly different essay about nothing in particular, of its own")], "doc_id long, text string")
    cached = spark.createDataFrame([(i, True, 90.0) for i in (1, 2, 3)], "doc_id long, success boolean, total double")
    found = {r.doc_id: r for r in review.review(docs, alike=Similarity(hashes=16), cached=cached).collect()}
    assert found[1].highest == found[2].highest == 1.0 and found[1].links == 1 and found[3].links == 0
    assert found[1].final == found[2].final == round((found[1].completeness * 0.2 + 72) * 0.7) < found[3].final


def test_images_count_as_signs(spark):
    docs = spark.createDataFrame([(1, "text"), (2, "text")], "doc_id long, text string")
    images = spark.createDataFrame([(1, n, True, 0.9, []) for n in range(4)], "doc_id long, image_index int, is_likely_aigc boolean, aigc_confidence double, quality_issues array<string>")
    found = {r.doc_id: r for r in review.review(docs, alike=Similarity(hashes=16), images=images).collect()}
    assert found[1].probability == 1.0 and found[1].suspicious and found[2].probability == 0.0


def test_the_last_row_of_a_key_counts(spark):
    docs = spark.createDataFrame([(1, 50.0, 0.0, False, "x")], "doc_id long, completeness double, probability double, suspicious boolean, risk string")
    graded = spark.createDataFrame([(1, True, 90.0, 1), (1, True, 40.0, 2)], "doc_id long, success boolean, total double, seq int")
    alike = spark.createDataFrame([(1, 0.0, 0), (1, 0.0, 0)], "doc_id long, highest double, links long")
    rows = report.joined(docs, graded, alike, order="seq").collect()
    assert len(rows) == 1 and rows[0].evaluation == 40.0


def test_index_loses_no_pair(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    rules = Similarity(hashes=16)
    named = similarity.classes(docs, rules)[1].select(F.col("class").alias("doc_id")).distinct()
    clean = similarity.without_template(F.coalesce("text", F.lit("")))
    chars = similarity.char_grams(clean, rules.char_size)
    sets = docs.join(named, "doc_id", "left_semi").select("doc_id", chars.alias("chars"), similarity.word_grams(clean, rules.word_size).alias("words"), similarity.signature(chars, rules.hashes).alias("signature"))
    held = [(r.doc_id, set(r.chars), set(r.words), r.signature) for r in sets.collect()]
    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    expected = set()
    for i, a in enumerate(held):
        for b in held[i + 1 :]:
            s = (jaccard(a[1], b[1]) + jaccard(a[2], b[2]) + sum(x == y for x, y in zip(a[3], b[3])) / 16) / 3
            if s >= 0.4 + 1e-9:
                expected.add(tuple(sorted((a[0], b[0]))))
    assert {(r.a, r.b) for r in similarity.similar_pairs(docs, rules).collect()} == expected


def test_normalise_is_monotone_and_half_even(spark):
    rows = spark.range(0, 101).select(F.col("id"), scoring.normalise(F.col("id").cast("double"), Scale(out_low=60, out_high=90, exponent=1.5)).alias("n")).orderBy("id").collect()
    assert [r.n for r in rows] == sorted(r.n for r in rows) and rows[0].n == 60 and rows[-1].n == 90
    assert spark.range(1).select(scoring.normalise(F.lit(2.5), Scale())).first()[0] == 2


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbering_over_ranges(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        wide = spark.range(0, 300_000).selectExpr("(id * 7919) % 300000 * 3 as k", *[f"repeat(cast(id as string), 5) as c{i}" for i in range(6)], "id as _at")
        found = report.numbered(wide, "k").selectExpr("count(*)", "count(distinct ordinal)", "min(ordinal)", "max(ordinal)", "sum(cast(ordinal <> k div 3 + 1 as int))", "count(_at)").first()
        assert tuple(found) == (300_000, 300_000, 1, 300_000, 0, 300_000)
        assert report.numbered(wide.limit(0), "k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_failover_asks_the_next():
    class Broken:
        def score(self, text):
            raise TimeoutError

    assert scorer.Failover(Broken(), scorer.LengthScorer()).score("x") == 40
    with pytest.raises(RuntimeError):
        scorer.Failover(Broken()).score("x")


def test_a_service_that_fails_is_followed_by_the_next():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from parchment.plans.rubric import Dimension

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if asked["model"] == "down":
                self.send_error(429)
                return
            content = "抄袭" if asked["max_tokens"] == 128 else '```json\n{"dimension_scores": {"a": 80, "b": 61}}\n```'
            body = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, dims = f"http://127.0.0.1:{server.server_port}/chat", (Dimension("a", 0.5), Dimension("b", 0.5))
    graders = scorer.Failover(*(scorer.ChatScorer(url, "k", m, dimensions=dims, timeout=5) for m in ("down", "up")))
    assert graders.score("text") == 70.0 and graders.at == 1 and scorer.ChatScorer(url, "k", "up").judge("x", "y") == "抄袭"
    server.shutdown()


def test_requirements(tmp_path):
    (tmp_path / "r.docx").write_bytes(package([" one ", "", "two"]))
    (tmp_path / "r.txt").write_text(" a \n\n b", encoding="utf-8")
    assert files.requirements(tmp_path / "r.docx") == "one\ntwo" and files.requirements(tmp_path / "r.txt") == "a\nb"
    with pytest.raises(FileNotFoundError):
        files.requirements(tmp_path / "none.docx")
    assert files.compressed(b"no image") == b"no image"


def package(paragraphs, image=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    if image:
        body += '<w:p><a:blip r:embed="rId1"/></w:p><w:p><w:r><w:t>Figure 1</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}<w:tbl/></w:body></w:document>")
        if image:
            z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="x/image" Target="media/a.png"/></Relationships>')
            z.writestr("word/media/a.png", image)
    return out.getvalue()


def test_directory_of_files(spark, tmp_path):
    (tmp_path / "20210001_张三.docx").write_bytes(package(["标题", " ", "body"], b"png"))
    (tmp_path / "20210001_张三.pdf").write_bytes(b"%PDF")
    (tmp_path / "李四.doc").write_bytes("很长的一段可以读出来的文字，足够超过二十个字符的限制，并且总共不少于五十个字符，所以会被保留下来，结束了吧。".encode("utf-16-le"))
    (tmp_path / "bad.docx").write_bytes(b"PK broken")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x/any.docx", package(["zipped"]))
    (tmp_path / "王五.zip").write_bytes(inner.getvalue())
    found = {r.author: r for r in files.directory(spark, str(tmp_path)).collect()}
    assert found["20210001-张三"].text == "标题\nbody\nFigure 1" and found["20210001-张三"].figures == 1 and found["20210001-张三"].tables == 1
    assert found["20210001-张三"].images[0].caption == "Figure 1" and bytes(found["20210001-张三"].images[0].data) == b"png"
    assert "五十个字符" in found["李四"].text and found["王五"].text == "zipped"
    assert found["bad"].text is None and found["bad"].error
    assert (tmp_path / "王五.zip").exists()


def test_html(spark, small):
    assert files.html(b"<p>a<script>x</script></p><p>b</p>") == "a\nb"
    pages = spark.read.parquet(f"{small}/pages.parquet").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "utf-8").alias("content"))
    assert files.parsed(pages).where("text is null").count() == 0


def test_settings(tmp_path):
    path = tmp_path / "r.yaml"
    assert not settings.save_rubric({}, path) and settings.load(path) == {}
    assert settings.save_rubric({"dimensions": [{"name": "d", "weight": 1}], "completeness": {"sections": [{"name": "s"}], "word_count": {"min": 5, "weight": 9}}}, path)
    r = settings.rubric(path)
    assert r == rubric_from(settings.load(path)) and r.completeness.min_words == 5 and r.completeness.sections[0].patterns == ("s",)
    assert settings.scale({"score_min": 0}, {"SCORE_MIN": "5", "SCORE_MAX": "50"}, {}) == Scale(low=0, high=50)
    assert settings.prompt(tmp_path, "p", "default") == "default"
    assert settings.filled("{a} {b}", {"a": "1"}) == "1 {b}"
    assert len(settings.providers({"LLM_API_URL": "u", "LLM_API_KEY": "k", "LLM_MODEL": "m", "LLM_API_URL_2": "u"})) == 1


def test_evaluation_keeps_nulls_and_recomputes(spark):
    from parchment import queries

    rows = {r.id: r for r in queries._parsed(spark).collect()}
    assert rows[1].total == round(80 * 0.35 + 72 * 0.25 + 100 * 0.4) and rows[2].basis == evaluate.NO_BASIS
    assert rows[3].scores == {"功能": 85.0, "代码": 70.0} and rows[4].scores == {} and not rows[6].parsed


def test_review_store_and_stream(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    cached = docs.where("doc_id < 5").selectExpr("doc_id", "false as success", "0D as total")
    rows = review.review(docs, alike=Similarity(hashes=16), grader=scorer.LengthScorer(), cached=cached)
    found = {r.doc_id: r for r in rows.collect()}
    assert len(found) == 40 and found[3].final == 0 and found[20].final > 0 and found[39].ordinal == 40
    store.save({"review": rows}, str(tmp_path / "kept"))
    loaded = store.load(spark, str(tmp_path / "kept"), {"review": rows.schema.simpleString()[7:-1].replace(":", " "), "none": "a long"})
    assert loaded["review"].count() == 40 and loaded["none"].count() == 0
    dims = (Dimension("功能", 0.5, "what it does"),)
    pairs = spark.createDataFrame([(1, 2, 0.9)], "a long, b long, similarity double")
    stats = report.statistics(rows)
    store.markdown(rows, stats, str(tmp_path / "md"), dims, pairs)
    text = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert text[0] == "# 论文评审报告" and sum(x.startswith("| ") for x in text) >= 42 and "| 功能 | 50% | what it does |" in text
    assert "- **1** 与 **2** 相似度 90%" in text and sum(x.startswith("### ") for x in text) == 41 and store.NO_COPIES not in text
    store.word(rows, stats, str(tmp_path / "r.docx"), dims, pairs)
    assert files.docx((tmp_path / "r.docx").read_bytes())["text"].startswith("# 论文评审报告")
    assert "schema" in store.restored_or_cached(spark, str(tmp_path / "nothing"), {"schema": "a long"}, str(tmp_path))
    store.summary(rows, str(tmp_path / "summary-1"), stats, dims)
    done = spark.read.option("header", True).csv(store.post_normalised(spark, str(tmp_path)) + "/rows")
    assert done.count() == 40 and done.where("cast(final as double) between 60 and 90").count() == 40
    with pytest.raises(FileNotFoundError):
        store.post_normalised(spark, str(tmp_path / "md"))
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        arrivals.review(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "results"), str(tmp_path / "cp"), lambda d: scorer.evaluate(d, scorer.LengthScorer()))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 40


def test_a_batch_run_again_doubles_nothing(spark, tmp_path):
    import shutil

    spark.range(0, 5).selectExpr("id as doc_id", "'t' as text").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has lost its checkpoint, so the first batch comes again
        arrivals.review(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: scorer.evaluate(d, scorer.LengthScorer()))
        shutil.rmtree(tmp_path / "cp")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
