import json
import zipfile

import pyspark.sql.functions as F
import pytest

from spanveil import cli
from spanveil.config import PROFILES, bundle
from spanveil.functions import sql
from spanveil.sources.files import discover, docx_paragraphs, mirrored, pdf_text, read_documents
from spanveil.streaming.redact import read_files, redact_available, redact_stream, write_files

DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>ИНН </w:t></w:r><w:r><w:t>7707083893</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>'


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "deep" / "er").mkdir(parents=True)
    (root / "a.txt").write_bytes("ИНН 7707083893\r\nдва\rтри ".encode() + b"\xff\xfe!")
    (root / "B.TXT").write_text("нет", encoding="utf-8")
    (root / "c.md").write_text("нет", encoding="utf-8")
    (root / "broken.pdf").write_bytes(b"no pdf")
    with zipfile.ZipFile(root / "deep" / "d.docx", "w") as file:
        file.writestr("word/document.xml", DOCX)
    (root / "deep" / "er" / "e f.txt").write_text("u@x.example.com", encoding="utf-8")
    return root


def test_discovery(spark, folder):
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(discover(spark, str(folder))) == ["B.TXT", "a.txt", "broken.pdf"]
    assert len(names(discover(spark, str(folder), recursive=True))) == 5
    assert names(discover(spark, str(folder / "c.md"))) == ["c.md"]


def test_reading(spark, folder):
    got = {r["doc_id"].rsplit("/", 1)[1]: r["text"] for r in read_documents(spark, str(folder), recursive=True).collect()}
    assert got["a.txt"] == "ИНН 7707083893\nдва\nтри !" and got["d.docx"] == "ИНН 7707083893\nb" and got["broken.pdf"] is None
    off = {r["doc_id"].rsplit("/", 1)[1]: r["text"] for r in read_documents(spark, str(folder), recursive=True, enable_office=False).collect()}
    assert off["d.docx"] is None and off["B.TXT"] == "нет"
    assert docx_paragraphs(b"x") is None and docx_paragraphs(None) is None and pdf_text(b"x") is None


def test_mirrored_paths(spark):
    df = spark.createDataFrame([("file:/r/a/b.c.pdf",), ("file:/r/x",), ("file:/r/d.e/f",)], "p string")
    assert [r[0] for r in df.select(mirrored(F.col("p"), "file:/r")).collect()] == ["a/b.c.txt", "x.txt", "d.e/f.txt"]


def test_command_line(spark, folder, tmp_path):
    out = tmp_path / "out"
    done = cli.main(["--input", str(folder), "--output", str(out), "--recursive", "--workers", "2"], spark)
    assert done["files"] == 5 and done["ok"] == 4 and done["by_label"] == {"INN": 2, "EMAIL": 1}
    assert (out / "a.txt").read_text(encoding="utf-8").startswith("ИНН [[ENTITY:INN]]") and (out / "deep" / "er" / "e f.txt").read_text(encoding="utf-8") == "[[ENTITY:EMAIL]]"
    lines = [json.loads(x) for f in (out / "redaction_log").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 3 and all("substr" not in x and x["file"] for x in lines)
    cli.main(["--input", str(folder / "a.txt"), "--output", str(out), "--log-text"], spark)
    lines = [json.loads(x) for f in (out / "redaction_log").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 4 and any(x.get("substr") == "7707083893" for x in lines)
    assert cli.main(["--input", str(folder), "--output", str(tmp_path / "none"), "--dry-run", "--mask-style", "hash", "--keep-length", "--include"], spark)["files"] == 3
    assert not (tmp_path / "none").exists()
    (tmp_path / "void").mkdir()
    assert cli.main(["--input", str(tmp_path / "void"), "--output", str(out)], spark)["files"] == 0


def test_sql_surface(spark):
    sql.register(spark, bundle(PROFILES["shipped"]))
    text = "ИНН 7707083893, u@x.example.com"
    spark.createDataFrame([(1, text), (2, None)], "id int, t string").createOrReplaceTempView("sql_texts")
    assert [r[0] for r in spark.sql("SELECT redact(t) FROM sql_texts ORDER BY id").collect()] == ["ИНН [[ENTITY:INN]], [[ENTITY:EMAIL]]", None]
    assert spark.sql("SELECT redact_as(t, 'asterisks') FROM sql_texts WHERE id = 1").first()[0] == "ИНН **********, ***************"
    rows = spark.sql("SELECT id, s.* FROM sql_texts, LATERAL detect_spans(t) AS s ORDER BY start").collect()
    assert [tuple(r) for r in rows] == [(1, 4, 14, "INN", 0.98, "7707083893"), (1, 16, 31, "EMAIL", 0.95, "u@x.example.com")]
    assert spark.sql("SELECT validate_inn('7707083893') AND NOT validate_ogrn('1')").first()[0]


def test_streams(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, f"ИНН 7707083893 u{k}@x.example.com")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    stream = read_files(spark, str(tmp_path / "docs"), "doc_id long, text string", most_files=1)
    out = redact_stream(stream, bundle(PROFILES["shipped"])).select("doc_id", "redacted")
    for _ in range(2):  # a second run finds nothing new
        write_files(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["redacted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ИНН [[ENTITY:INN]] [[ENTITY:EMAIL]]"] * 2
    assert redact_available(spark, str(tmp_path / "docs"), bundle(PROFILES["shipped"])).count() == 2
