"""Readers: archives and messages are made here, in memory."""

from __future__ import annotations

import io
import zipfile

import pytest

from lodestone.sources import files
from lodestone.sources import office as O

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_docx():
    p = lambda t, extra="": f"<w:p><w:pPr>{extra}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", '<w:pStyle w:val="Heading2"/>') + p("item", "<w:numPr/>") + p("plain") + f"<w:tbl><w:tr>{cell('a')}{cell('b|c')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    got = O.docx(archive(word__document_dot_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>"))
    assert got == "## Title\n\n- item\n\nplain\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"
    with pytest.raises(O.ReadError):
        O.docx(b"no archive")


def test_xlsx():
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c></row><row><c r="A2"><v>0.1</v></c><c r="B2" s="1"><v>45000</v></c><c r="D2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    data = archive(
        xl__workbook_dot_xml='<workbook><sheets><sheet name="Data"/></sheets></workbook>', xl__sharedStrings_dot_xml="<sst><si><t>name</t></si></sst>",
        xl__styles_dot_xml='<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>', xl__worksheets__sheet1_dot_xml=sheet,
    )
    assert O.xlsx(data) == "## Sheet: Data\n\n| name | when |  |  |\n| --- | --- | --- | --- |\n| 0.1 | 2023-03-15 |  | TRUE |"
    assert O.column_index("AB12") == 27 and O.excel_number(0.1 + 0.2) == "0.3" and O.excel_number(-0.0) == "0"
    assert O.excel_date(60) == "1900-02-29" or O.excel_date(60) == "1900-03-01" and O.excel_date(61) == "1900-03-01"
    assert O.excel_date(0.5) == "12:00" and O.excel_date(45000.25) == "2023-03-15 06:00" and O.is_date_format("yyyy-mm-dd") and not O.is_date_format('0.00"days"')


def test_pptx_and_odf():
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:txBody></p:sld>'
    assert O.pptx(archive(ppt__slides__slide1_dot_xml=slide)) == "## Slide 1\n\nHello"
    content = '<d xmlns:t="t" xmlns:x="x"><t:body><x:h t:outline-level="2">Head</x:h><x:list><x:list-item><x:p>one</x:p></x:list-item></x:list><t:table><t:table-row><t:table-cell><x:p>a</x:p></t:table-cell><t:table-cell t:number-columns-repeated="9999"/></t:table-row></t:table></t:body></d>'
    assert O.odf_archive(archive(content_dot_xml=content)) == O.odf_flat(content.encode()) == "## Head\n\n- one\n\n| a |\n| --- |"


def test_rtf():
    escape = b"\\" + b"u8212?"
    assert O.rtf(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}Caf\'e9 " + escape + rb"dash\par{\*\generator x;}next\tab end}") == "Café —dash\nnext\tend"
    with pytest.raises(O.ReadError):
        O.rtf(b"text")


def test_delimited():
    assert O.delimited(b'a;b\n"x;y";"q""z"\n') == '| a | b |\n| --- | --- |\n| x;y | q"z |'
    assert O.delimited("﻿a\tb\n1\t2".encode(), "tsv") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert O.sniff("a,b;c") == "," and O.sniff('"a;;;;",b') == "," and O.delimited(b"") == ""
    assert O.delimited(b"x" * 300_000).endswith("[table cut]")


def test_eml():
    raw = b"From: a@x.org\r\nTo: b@x.org\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>Rich</p>\r\n--B\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nna=C3=AFve\r\n--B\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=f.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--B--\r\n"
    assert O.eml(raw) == "From: a@x.org\nTo: b@x.org\nSubject: Café\n\nnaïve\n\nAttachments:\n- f.pdf (application/pdf, 3 bytes)"


def test_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-")
    (tmp_path / "d.txt").write_bytes("x\r\n\r\n\r\n\r\ny \n".encode())
    got = {r.extension: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["csv"] == ("| a | b |\n| --- | --- |\n| 1 | 2 |", None) and got["txt"] == ("x\n\ny", None)
    assert got["docx"] == (None, "not-an-archive") and got["pdf"] == (None, "unsupported-format")


def test_stores(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"id": "a", "title": "t", "timestamp": 1, "messages": [{"role": "user", "content": "hi"}]}, {"id": "b"}]')
    rows = files.read_history(spark, str(tmp_path / "h.json")).orderBy("id").collect()
    assert [(r.id, r.role, r.content, r.archived) for r in rows] == [("a", "user", "hi", False), ("b", None, None, False)]
    (tmp_path / "bad.json").write_text("{not json")
    assert files.read_history(spark, str(tmp_path / "bad.json")).count() == 0
    chunks = spark.createDataFrame([("x", "1", "text"), ("y", "2", "more")], "collection string, id string, content string")
    files.write_collection(chunks, str(tmp_path / "c"))
    assert files.read_collection(spark, str(tmp_path / "c"), "x").count() == 1 and files.rewrite_collection(spark, str(tmp_path / "c"), str(tmp_path / "d")) == 2
