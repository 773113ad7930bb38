"""The data source of documents reads what is asked for and no more."""

import io
import os
import zipfile

from parchment.sources import documents, files


def test_only_chosen_bytes_are_read(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"2021000{i}_name.docx").write_bytes(os.urandom(50_000))
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a/paper.docx", os.urandom(80_000))
        z.writestr("b/paper.pdf", os.urandom(3_000))
        z.writestr("b/~$paper.doc", b"lock")
    (tmp_path / "20210009_zip.zip").write_bytes(inner.getvalue())
    (tmp_path / "20210000_name.zip").write_bytes(inner.getvalue())  # its docx is there already
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    documents.register(spark)
    read = spark.read.format("documents").load(str(tmp_path))
    rows = {r.name: r for r in read.collect()}
    assert rows.keys() == {*(f"2021000{i}_name.docx" for i in range(6)), "20210009_zip.docx", "20210009_zip.pdf", "20210000_name.pdf"}
    assert rows["20210000_name.docx"].member is None and len(rows["20210009_zip.docx"].content) == 80_000
    # of the files as the other reader gives them
    assert {r.name: bytes(r.content) for r in files.files(spark, str(tmp_path)).collect()} == {n: bytes(r.content) for n, r in rows.items()}
    one = read.where("name = '20210003_name.docx'").collect()
    assert [(r.name, r.bytes_read) for r in one] == [("20210003_name.docx", 50_000)]
    some = read.where("name in ('20210009_zip.pdf', '20210001_name.docx', 'none')").collect()
    assert {r.name for r in some} == {"20210009_zip.pdf", "20210001_name.docx"} and sum(r.bytes_read for r in some) < 60_000
    names = spark.read.format("documents").option("content", "false").load(str(tmp_path))
    assert names.count() == 9 and names.selectExpr("sum(bytes_read)").first()[0] == 0
