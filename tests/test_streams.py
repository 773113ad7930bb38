"""The stream of arriving files with a state per author."""

from parchment.operators import scorer
from parchment.streaming import authors


def test_a_better_file_replaces_the_result_once(spark, tmp_path):
    graded = []

    def evaluate(rows):
        graded.extend(r.author for r in rows.select("author").collect())
        return scorer.evaluate(rows, scorer.LengthScorer(), "author")

    def arrive(*rows):
        spark.createDataFrame(list(rows), "name string, text string").write.mode("append").parquet(str(tmp_path / "in"))
        authors.review(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), evaluate)
        return {r.author: (r.name, r.total, r.version) for r in authors.latest(spark, str(tmp_path / "out")).collect()}

    first = arrive(("20210001_张三.pdf", "x" * 1000), ("20210002_李四.docx", "y" * 500), ("20210002_李四.pdf", "y"), ("notes.txt", "no document"))
    assert first == {"20210001-张三": ("20210001_张三.pdf", 50.0, 1), "20210002-李四": ("20210002_李四.docx", 45.0, 1)}
    better = arrive(("20210001_张三.docx", "x" * 2000), ("20210002_李四.doc", "z" * 9000))
    assert better == {"20210001-张三": ("20210001_张三.docx", 60.0, 2), "20210002-李四": ("20210002_李四.docx", 45.0, 1)}
    # the same once more, and worse ones, change nothing and are not graded
    assert arrive(("20210001_张三.docx", "x" * 2000), ("20210001_张三.pdf", "x" * 1000), ("20210002_李四.docx", "y" * 500)) == better
    assert sorted(graded) == ["20210001-张三", "20210001-张三", "20210002-李四"]
    # a revised file is a new one
    assert arrive(("20210002_李四.docx", "y" * 700))["20210002-李四"] == ("20210002_李四.docx", 47.0, 2)
