from __future__ import annotations

from siltwork.pipeline import Pipeline
from siltwork.sources import readers


def test_quoted_line_breaks_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('text,domain\r\n"первая строка\nвторая, ""в кавычках""\r\nтретья",okc\r\nпросто текст,house\r\n'.encode())
    want = [("первая строка\nвторая, \"в кавычках\"\nтретья", "okc"), ("просто текст", "house")]
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "a.csv")).collect()] == want
    out = Pipeline(spark, str(tmp_path / "out")).ingest(str(tmp_path / "a.csv"))
    assert {r["text"] for r in out.collect()} == {"первая строка вторая, \"в кавычках\" третья", "просто текст"}
    (tmp_path / "b.csv").write_text("text,domain\nодин,okc\n", encoding="utf-8")
    assert Pipeline(spark, str(tmp_path / "out")).ingest(str(tmp_path / "b.csv"), multi_line=False).count() == 1


def test_encoding_is_judged_by_all_bytes_of_each_file(spark, tmp_path):
    plain = "".join(f"{i},plain text\n" for i in range(6000))
    assert len(plain) > readers.SNIFF_BYTES
    folder = tmp_path / "данные 1.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes(("id,text\n" + plain + "6000,привет\n").encode("cp1251"))
    (folder / "b.csv").write_bytes(("﻿id,text\n" + plain + "6001,Ещё\n").encode())
    (folder / "c.csv").write_bytes(b"text;id\n" + b"caf\xe9 \x98;6002\n")
    (folder / "d.csv").write_bytes(b"")
    rows = {r["id"]: r["text"] for r in readers.read_any(spark, str(folder)).where("id >= 6000").collect()}
    assert rows == {"6000": "привет", "6001": "Ещё", "6002": "café \x98"}
    assert readers.read_any(spark, str(folder)).count() == 12003
