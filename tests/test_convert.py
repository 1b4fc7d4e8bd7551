"""Converters on documents made here."""

import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.operators import convert as CV
from foliant.operators.registry import Registry, Rule
from foliant.sources import binary, html, lexical, office, web

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*rows):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"


def docx():
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Abstract", "Heading1") + p("plain") + '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath></w:p>'
    body += f"<w:tbl><w:tr><w:tc>{p('h1')}</w:tc><w:tc>{p('h2')}</w:tc></w:tr><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>"
    return pack({"_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")), "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'})


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {s}><sheetViews><sheetView showZeroes="1"/></sheetViews><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>B</t></is></c></row><row r="2"><c r="A2"><v>10</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    return pack({"_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml")), "xl/workbook.xml": f'<workbook {s} xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "sharedStrings", "sharedStrings.xml")), "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {s}><si><t>A|x</t></si></sst>"})


def pptx():
    n = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="' + REL + '"'
    sp = lambda t, y, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="n"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld {n}><p:cSld><p:spTree>{sp("below", 900)}{sp("Top", 5, "<p:ph type=" + chr(34) + "title" + chr(34) + "/>")}</p:spTree></p:cSld></p:sld>'
    return pack({"_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")), "ppt/presentation.xml": f'<p:presentation {n}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml")), "ppt/slides/slide1.xml": slide})


def epub():
    opf = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator></metadata><manifest><item id="c2" href="b.xhtml"/><item id="c1" href="a%20a.xhtml"/></manifest><spine><itemref idref="c1"/><itemref idref="c2"/></spine></package>'
    return pack({"META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>', "O/p.opf": opf, "O/a a.xhtml": "<html><body><h1>First</h1></body></html>", "O/b.xhtml": "<html><body><blockquote>q</blockquote></body></html>"})


def png(text="Hello"):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"Title\0" + text.encode()) + chunk(b"IEND", b"")


CASES = [
    ("a.html", b"<title>T</title><body><h1>H</h1><script>x</p></script><p>a <b>b</b></p></body>", "html", "# H\n\na **b**"),
    ("a.csv", "﻿name,age\n\nAl|ice,30\n".encode(), "csv", "| name | age |\n| --- | --- |\n| Al\\|ice | 30 |"),
    ("a.json", b'{"a": 1}', "text", '{"a": 1}'),
    ("a.ipynb", json.dumps({"nbformat": 4, "nbformat_minor": 5, "cells": [{"cell_type": "markdown", "source": ["# N\n", "x"]}, {"cell_type": "code", "source": "1+1"}]}).encode(), "ipynb", "# N\nx\n\n```python\n1+1\n```"),
    ("a.rss", b"<rss><channel><title>R</title><item><title>I</title></item></channel></rss>", "rss", "# R\n\n## I\n"),
    ("a.docx", docx(), "docx", "# Abstract\n\nplain\n\n**bold**$\\frac{a}{b}$\n\n| h1 | h2 |\n| --- | --- |\n| x | y |"),
    ("a.xlsx", xlsx(), "xlsx", "## One\n| A\\|x | B |\n| --- | --- |\n| 10 | TRUE |"),
    ("a.pptx", pptx(), "pptx", "<!-- Slide number: 1 -->\n# Top\nbelow"),
    ("a.epub", epub(), "epub", "**Title:** Book\n**Authors:** A, B\n\n# First\n\n> q"),
    ("a.png", png(), "image", "ImageSize: 3x2\nTitle: Hello"),
    ("a.txt", "café  \r\n\r\n\r\n\r\nx".encode("cp1252"), "text", "café\n\nx"),
]


def test_convert(spark):
    rows = [(name, bytearray(data), "." + name.split(".")[1], "cp1252" if name == "a.txt" else None) for name, data, *_ in CASES]
    rows += [("z.zip", bytearray(pack({"in.csv": "a,b\n1,2\n", "no.bin": "x"})), ".zip", None), ("bad.docx", bytearray(b"nonsense"), ".docx", None), ("broken.docx", bytearray(b"PK\x03\x04\xff\xfe"), ".docx", None), ("none.bin", bytearray(b"\xff\xfe\x00\x01"), ".bin", None)]
    df = spark.createDataFrame(rows, "document_id string, content binary, extension string, charset string")
    got = {r.document_id: r for r in CV.convert(df).collect()}
    for name, _, converter, want in CASES:
        assert (got[name].status, got[name].converter, got[name].markdown) == ("ok", converter, want), name
    assert "## File: in.csv" in got["z.zip"].markdown and "no.bin" not in got["z.zip"].markdown
    assert (got["bad.docx"].converter, got["bad.docx"].attempts[0].converter) == ("text", "docx")  # it looks like text
    assert got["broken.docx"].status == "failed" and {a.converter for a in got["broken.docx"].attempts} == {"docx", "zip"}
    assert got["none.bin"].status == "unsupported" and got["none.bin"].attempts == []


def test_registry_takes_new_converters(spark):
    registry = Registry()
    registry.register(Rule("upper", (".txt",), priority=-1.0), lambda data, info: (data.decode().upper(), "t"))
    df = spark.createDataFrame([(1, bytearray(b"abc"), ".txt")], "document_id long, content binary, extension string")
    row = CV.convert(df, registry=registry).first()
    assert (row.converter, row.markdown, row.title) == ("upper", "ABC", "t")


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<p>First<u> word </u>Last</p>", "First <u>word</u> Last"),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "* a\n  + b\n* c"),
        ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
        ("<a href='javascript:x'>t</a>", "t"),
        ("<a href='https://x.y'>https://x.y</a>", "<https://x.y>"),
        ("<a href='/p' title='q\"r'>t</a>", '[t](/p "q\\"r")'),
        ("<img src='' data-src='/l.png' alt='a\nb'>", "![a b](/l.png)"),
        ("<input type=checkbox checked>done", "[x] done"),
        ("<pre>a\n  b</pre>", "```\na\n  b\n```"),
        ("a*b_c", "a\\*b\\_c"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_html(given, want):
    assert html.to_markdown(given) == want


def test_sites():
    page = "<title>Fallback</title><nav>menu</nav><span class='mw-page-title-main'>Name</span><div id='mw-content-text'><p>Body</p></div>"
    assert web.wikipedia(page) == ("# Name\n\nBody", "Name")
    hit = "<li class='b_algo'><h2><a href='https://www.bing.com/ck/a?u=a1aHR0cHM6Ly94Lnkv'>X</a></h2><p>text</p></li>"
    assert "[X](https://x.y/)" in web.bing(hit, "https://www.bing.com/search?q=me")[0]
    video = "<title>V</title><meta name='keywords' content='k'><script>var ytInitialData = {\"a\":{\"attributedDescriptionBodyText\":{\"content\":\"D\"}}};</script>"
    assert web.youtube(video, "said")[0] == "# YouTube\n\n## V\n\n### Video Metadata\n- **Keywords:** k\n\n\n### Description\nD\n\n### Transcript\nsaid\n"
    assert web.youtube("<p>nothing</p>") is None
    with pytest.raises(ValueError, match="refused"):
        web.feed(b"<!DOCTYPE x><rss/>")


def test_equations():
    m = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    run = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    eq = lambda body: office.omml_to_latex(f"<m:oMath {m}>{body}</m:oMath>")
    assert eq(f"<m:rad><m:deg/><m:e>{run('x')}</m:e></m:rad>") == "\\sqrt{x}"
    assert eq(f"<m:sSubSup><m:e>{run('x')}</m:e><m:sub>{run('1')}</m:sub><m:sup>{run('2')}</m:sup></m:sSubSup>") == "x_{1}^{2}"
    assert eq(f'<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{run("i")}</m:sub><m:sup>{run("n")}</m:sup><m:e>{run("i")}</m:e></m:nary>') == "\\sum_{i}^{n}i"
    assert eq(f"<m:d><m:e>{run('α')}</m:e></m:d>") == "\\left(\\alpha \\right)"
    assert eq(f"<m:m><m:mr><m:e>{run('a')}</m:e><m:e>{run('b')}</m:e></m:mr></m:m>") == "\\begin{matrix}a&b\\end{matrix}"


def test_lexers():
    text = 'a,"b\n""c",d\n\n1,,\n'
    fields = lexical.csv_fields(text)
    assert all(text[f["start"] : f["end"]] == f["raw"] for f in fields) and lexical.csv_parity(text, fields)
    assert lexical.csv_dialect("a;b\n1;2\n")[:2] == (";", True) and lexical.csv_dialect("a;b,c\n")[2] == "csv.dialect.ambiguous"
    doc = '{"a": [1, 2.50], "x/y": {"~": null}}'
    values = {v["pointer"]: v for v in lexical.json_values(doc)}
    assert values["/a/1"]["raw"] == "2.50" and values["/x~1y/~0"]["kind"] == "null" and all(doc[v["start"] : v["end"]] == v["raw"] for v in values.values())
    for bad in ('{"a":1,"a":2}', "[1,]", "{", "01", '{"a" 1}', "[1] x", "NaN"):
        with pytest.raises(ValueError):
            lexical.json_values(bad)
    deep = "[" * 5000 + "]" * 5000
    assert len(lexical.json_values(deep)) == 5000
    owners = list(lexical.xml_owners('<r xmlns="u" a="x&amp;y"><b>t</b><![CDATA[c]]></r>'))
    assert [(o["kind"], o["value"]) for o in owners] == [("element", None), ("namespace", "u"), ("attribute", "x&y"), ("element", None), ("text", "t"), ("cdata", "c")]
    for bad in ("<!DOCTYPE r><r/>", "<r><b></r>", "<r>&x;</r>", "<r>"):
        with pytest.raises(ValueError):
            list(lexical.xml_owners(bad))
    assert lexical.rtf(r"{\rtf1{\fonttbl x}Hello\par w\'e9}") == "Hello\nwé"


def test_media_edits_keep_other_bytes():
    data = png()
    new = binary.png_replace(data, "Title", "Other title")
    assert binary.png_text(new)[0]["text"] == "Other title" and new.endswith(data[-12:]) and new.startswith(data[:33])
    with pytest.raises(ValueError, match="checksum"):
        binary.png_chunks(data[:40] + b"?" + data[41:])
    tag = b"\xff\xfb" * 20 + b"TAG" + b"Old".ljust(30, b"\0") + bytes(95)
    assert binary.audio(binary.id3v1_replace(tag, "title", "New"))[0] == "Title: New"
    exif = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHII", 0x13B, 2, 6, 26) + bytes(4) + b"Alice\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif + b"\xff\xd9"
    assert binary.jpeg_exif(jpeg)[0]["text"] == "Alice" and binary.jpeg_exif(binary.jpeg_replace(jpeg, "Artist", "Bob"))[0]["text"] == "Bob"
    with pytest.raises(ValueError, match="allocation"):
        binary.jpeg_replace(jpeg, "Artist", "Too long a name")


def test_rewrite_keeps_members():
    data = pack({"a": "1", "b": "2"})
    new = office.rewrite(data, {"b": b"3"})
    assert office.members(new) == {"a": b"1", "b": b"3"} and [r["name"] for r in office.member_rows(new)] == ["a", "b"]


def test_exploded_rows(spark):
    df = spark.createDataFrame([("x", bytearray(xlsx())), ("bad", bytearray(b"no"))], "document_id string, content binary")
    rows = CV.xlsx_cells(df).collect()
    assert {(r.row, r.column, r.type, r.value) for r in rows if r.document_id == "x"} == {(0, 0, "string", "A|x"), (0, 1, "string", "B"), (1, 0, "int", "10"), (1, 1, "bool", "TRUE")}
    assert [r.error is not None for r in rows if r.document_id == "bad"] == [True]
    assert CV.zip_members(df).where("error is null").count() == 5


def test_stream(spark, tmp_path):
    from foliant.streaming import convert_stream, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>Hi</h1>")
    q = convert_stream(watch(spark, f"file://{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    q.awaitTermination(120)
    assert [r.markdown for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["# Hi"]


def test_readers(spark, tmp_path):
    from foliant.sources import readers

    (tmp_path / "a.csv").write_text("x,y\n")
    row = readers.files(spark, str(tmp_path)).select("filename", "extension").first()
    assert tuple(row) == ("a.csv", ".csv")
    got = readers.data_uris(spark.createDataFrame([("data:text/csv;base64,eCx5",)], "uri string")).first()
    assert bytes(got.content) == b"x,y" and got.mimetype == "text/csv"
    assert CV.convert(readers.files(spark, str(tmp_path))).first().converter == "csv"
    snap = CV.derived_snapshot(spark.createDataFrame([(1, "u", bytearray(b"b"), "# m\n")], "document_id int, uri string, content binary, markdown string"), "wikipedia")
    assert snap.select(F.col("state")).first().state == "derived"
