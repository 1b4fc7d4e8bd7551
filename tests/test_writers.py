"""Patched bytes: what was asked changes, all else stays, what can't be done is refused."""

import io
import json
import zipfile
import zlib

import pytest

from foliant.operators.writers import write, write_one
from foliant.sources import html, pdf

from .test_convert import epub, png

XML = '<r a="1"><b>x &amp; y</b></r>'


@pytest.mark.parametrize(
    ("family", "data", "edits", "want"),
    [
        ("csv", 'a,"b"\r\n1,2\r\n', [{"target": [0, 1], "new": 'q"r', "old": "b"}, {"target": [1, 0], "new": "x,y"}], 'a,"q""r"\r\n"x,y",2\r\n'),
        ("json", '{"a": [1, 2.50],\n "b": "é"}', [{"target": "/a/0", "new": -3}, {"target": "/b", "new": "ü\n"}], '{"a": [-3, 2.50],\n "b": "ü\\n"}'),
        ("xml", XML, [{"target": "/r[1]/@a", "new": '<"'}, {"target": "/r[1]/b[1]/text()[1]", "new": "z<"}], '<r a="&lt;&quot;"><b>z&lt;</b></r>'),
        ("text", "a\r\nb\r\n", [{"target": "", "new": "c\nd"}], "c\r\nd"),
        ("ipynb", json.dumps({"nbformat": 4, "cells": [{"source": ["a\n", "b"]}]}), [{"target": 0, "new": "1\n2\n3"}], json.dumps({"nbformat": 4, "cells": [{"source": ["1\n", "2\n3"]}]})),
        ("csv", "a,b\n", [], "a,b\n"),
    ],
)
def test_write(family, data, edits, want):
    got = write_one(family, data.encode(), edits)
    assert (got["status"], got["reason"]) == ("ok", None) and got["candidate"].decode() == want


@pytest.mark.parametrize(
    ("family", "data", "edits", "reason"),
    [
        ("csv", "a,b\n", [{"target": [0, 5], "new": "x"}], "target_missing"),
        ("csv", "a,b\n", [{"target": [0, 0], "new": "a"}], "no_op_update"),
        ("csv", "a,b\n", [{"target": [0, 0], "new": "x\ny"}], "newline_in_replacement"),
        ("csv", "a,b\n", [{"target": [0, 0], "new": "x", "old": "z"}], "old_value_mismatch"),
        ("json", '{"a": {}}', [{"target": "/a", "new": 1}], "json.container.structural_edit_unsupported"),
        ("xml", XML, [{"target": "/r[1]", "new": "x"}], "xml.element.structural_edit_unsupported"),
        ("text", "a\nb\r\n", [{"target": "", "new": "c"}], "text.newlines_mixed"),
        ("gif", "", [], "unsupported_format"),
    ],
)
def test_refused(family, data, edits, reason):
    got = write_one(family, data.encode(), edits)
    assert (got["status"], got["reason"], got["candidate"]) == ("refused", reason, None)


def test_one_bad_edit_refuses_all():
    assert write_one("csv", b"a,b\n", [{"target": [0, 0], "new": "x"}, {"target": [9, 9], "new": "y"}])["status"] == "refused"
    assert write_one("csv", b"a,b\n", [], sha256="0" * 64)["reason"] == "source_digest_mismatch"


def test_containers():
    got = write_one("epub", epub(), [{"member": "O/a a.xhtml", "target": "/html[1]/body[1]/h1[1]/text()[1]", "new": "Second"}])
    with zipfile.ZipFile(io.BytesIO(got["candidate"])) as z:
        assert b"<h1>Second</h1>" in z.read("O/a a.xhtml") and len(z.namelist()) == 4
    assert write_one("png", png(), [{"target": "Title", "new": "New"}])["status"] == "ok"
    assert write_one("png", png(), [{"target": "Nothing", "new": "New"}])["reason"] == "target_missing"


def a_pdf():
    body = zlib.compress(b"BT /F1 12 Tf 50 700 Td (Hello) Tj 100 0 Td (world) Tj ET BT 50 680 Td [(s) -20 (econd)] TJ ET")
    return b"%PDF-1.4\n1 0 obj<< /Type /Catalog /Pages 2 0 R >>endobj\n2 0 obj<< /Type /Pages /Kids [3 0 R] /Count 1 >>endobj\n3 0 obj<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>endobj\n4 0 obj<< /Length " + str(len(body)).encode() + b" /Filter /FlateDecode >>stream\n" + body + b"\nendstream endobj\n5 0 obj<< /Title (Old \\(t\\)) >>endobj\ntrailer<< /Size 6 /Root 1 0 R /Info 5 0 R >>\nstartxref\n0\n%%EOF\n"


def test_pdf():
    data = a_pdf()
    assert pdf.pdf(data) == ("Hello world\nsecond", "Old (t)")
    new = write_one("pdf", data, [{"target": "Title", "new": "Café"}])["candidate"]
    assert new.startswith(data) and pdf.info(new)["Title"] == "Café" and pdf.text(new) == pdf.text(data)


def test_write_table(spark):
    docs = spark.createDataFrame([(1, "csv", bytearray(b"a,b\n"), None), (2, "json", bytearray(b"[1]"), None), (3, "csv", bytearray(b"c\n"), None)], "document_id int, format string, content binary, sha256 string")
    edits = spark.createDataFrame([(1, 0, '{"target": [0, 0], "new": "z"}'), (2, 0, '{"target": "/7", "new": 1}')], "document_id int, position int, payload string")
    got = {r.document_id: r for r in write(docs, edits).collect()}
    assert bytes(got[1].candidate) == b"z,b\n" and got[2].reason == "target_missing" and bytes(got[3].candidate) == b"c\n"


def test_html_values_in_place():
    page = """<!doctype html>\n<html><head><title>A &amp; B</title><script>if (a < b) "x"</script></head>
<body class=plain id="m"><!-- note --><p title='it&#39;s'>one <b>two</b> 3 &lt; 4<p>five<br>six</body></html>""".encode()
    rows = {o["path"]: o for o in html.spans(page.decode())}
    assert all(page.decode()[o["start"] : o["end"]] == o["raw"] for o in rows.values())
    assert rows["/html[1]/head[1]/title[1]/text()[1]"]["value"] == "A & B"
    text = "/html[1]/body[1]/p[1]/text()[2]"
    assert rows[text]["value"] == " 3 < 4"
    made = write_one("html", page, [{"target": text, "new": " a<b & c"}, {"first": "b", "new": "C & D"}, {"target": "/html[1]/body[1]/p[1]/@title", "old": "it's", "new": "x'y"}])
    assert made["status"] == "ok"
    assert made["candidate"] == page.replace(b" 3 &lt; 4", b" a&lt;b &amp; c").replace(b"two", b"C &amp; D").replace(b"it&#39;s", b"x&#39;y")
    refused = lambda *e: write_one("html", page, list(e))["reason"]
    assert refused({"target": "/html[1]/head[1]/script[1]/text()[1]", "new": "x"}) == "html.raw_text.read_only"
    assert refused({"first": "title", "new": "x"}) == "html.rcdata.read_only"
    assert refused({"target": "/html[1]/body[1]/@class", "new": "x"}) == "html.attribute.unquoted"
    assert refused({"target": "/nothing", "new": "x"}) == "target_missing"
    assert refused({"first": "h1", "new": "x"}) == "target_missing"
    assert refused({"target": text, "old": "other", "new": "x"}) == "old_value_mismatch"
    assert refused({"target": text, "new": ""}) == "topology_changed"
    assert write_one("html", page, [])["candidate"] == page
