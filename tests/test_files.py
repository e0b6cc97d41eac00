"""Broken and hostile files stay rows; files that arrive are read once."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from test_marketplace import RESUME, docx, make_pdf, parsed

from talentloom.sources import marketplace
from talentloom.sources.pdf import Pdf
from talentloom.streaming import resume_files


def wrong_sum(data):
    """The archive with a byte of its stored document changed, so its check sum is wrong."""
    at = data.index(b"<w:t>") + 5
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def stream_pdf(raw):
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R >> endobj 4 0 obj << /Filter /FlateDecode >> stream\n" + raw + b"\nendstream endobj"


BROKEN = {
    "crc.docx": (wrong_sum(docx(["Name"])), "unreadable"),
    "cut.docx": (docx(["Name"])[:-30], "not a DOCX"),
    "xml.docx": (docx(["<broken"]), "unreadable"),
    "bomb.pdf": (stream_pdf(zlib.compress(b"BT (x) Tj ET " * (2 << 20), 9)), "unreadable: its streams unpack to too much"),
    "odd.pdf": (b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R >> endobj 4 0 obj << >> stream\nBT (a) Tj 1 x Td ET\nendstream endobj", ""),
    "a.txt": (b"text", "unsupported type"),
}


def test_broken_files_are_rows(spark):
    rows = [(k, v) for k, (v, _) in BROKEN.items()] + [("good.docx", docx(["Name"])), (None, b"x"), ("null.pdf", None)]
    got = {r.path: r for r in marketplace.resume_file_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(got) == len(rows) and got["good.docx"].extracted_text == "Name"
    for name, (_, error) in BROKEN.items():
        assert (got[name].error or "").startswith(error), (name, got[name].error)
    assert got[None].error == "unsupported type" and got["null.pdf"].error == "empty"


def test_unpacking_is_bounded():
    packed = stream_pdf(zlib.compress(b"BT (x) Tj ET " * 10_000, 9))
    assert Pdf(packed).text().startswith("x")
    with pytest.raises(ValueError):
        Pdf(packed, most=1000)


def test_all_members_count_before_unpacking():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", "x" * (21 << 20))
    assert marketplace.file_problem("a.docx", out.getvalue()) == "unsafe archive"


def test_other_spellings_of_a_technology_are_told_as_well(spark):
    rows = parsed(spark, "PROJECTS", "Shop Portal", "- Took orders of customers.", "Postgres • NodeJS • Python").projects
    assert [(p.name, p.technologies, p.description) for p in rows] == [("Shop Portal", ["PostgreSQL", "Node.js", "Python"], ["Took orders of customers.", "Postgres", "NodeJS"])]


def test_a_second_run_reads_new_files_only(spark, tmp_path):
    files, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in" / "more").mkdir(parents=True)
    lines = [x for x in RESUME.split("\n") if x.strip()]
    plain = [x.replace("&", "and").replace("<", "").replace(">", "") for x in lines]
    (tmp_path / "in" / "a.docx").write_bytes(docx(plain))
    (tmp_path / "in" / "more" / "b.docx").write_bytes(wrong_sum(docx(["Name"])))
    (tmp_path / "in" / "c.pdf").write_bytes(make_pdf("BT (short) Tj ET"))

    def run():
        resume_files.parse_arriving(spark, files, results, checkpoint).awaitTermination()
        rows = resume_files.parsed_results(spark, results).withColumn("name", F.substring_index("path", "/", -1)).collect()
        return {r["name"]: r for r in rows}, len(rows)

    got, n = run()
    assert n == 3 and {k: r.status for k, r in got.items()} == {"a.docx": "Completed", "b.docx": "Refused", "c.pdf": "Failed"}
    assert "anita.r@example.com" in got["a.docx"].parsed_data and got["b.docx"].error.startswith("unreadable") and got["c.pdf"].error
    (tmp_path / "in" / "d.txt").write_bytes(b"text")
    got, n = run()
    assert n == 4 and got["d.txt"].status == "Refused" and got["d.txt"].batch == 1 and got["a.docx"].batch == 0
    assert run()[1] == 4
