"""Native files as model tables."""

import json

from foliant.operators import native as N

from .test_convert import xlsx


def frame(spark, *rows):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(rows)], "document_id int, content binary")


def states(star):
    return {(r.document_id, r.state, r.reason_code) for r in star["capabilities"].collect()}


def test_text(spark):
    star = N.text(frame(spark, b"a\nb", b"a\nb\r\n", b"\xff\xfe\xff"))
    assert states(star) == {(0, "writable", None), (1, "read-only", "text.newlines_mixed"), (2, "read-only", "text.encoding.not_roundtrippable")}


def test_csv(spark):
    star = N.csv(frame(spark, b"a,b\n1,2\n", b"one\ntwo\n", b"a;b,c\n"))
    assert states(star) == {(0, "writable", None), (1, "read-only", "csv.dialect.single_column"), (2, "read-only", "csv.dialect.ambiguous")}
    assert star["cells"].where("document_id = 0").count() == 4
    node = star["nodes"].where("document_id = 0").first()
    assert node.node_id.startswith("csv-table-") and (node.rows, node.columns) == (2, 2)


def test_json(spark):
    star = N.json(frame(spark, b'{"a": [1, {"b": null}]}', b"{bad"))
    rows = {r.pointer: r for r in star["nodes"].collect()}
    assert set(rows) == {"", "/a", "/a/0", "/a/1", "/a/1/b"} and rows["/a/0"].parent_id == rows["/a"].node_id
    assert sorted(r.state for r in star["capabilities"].collect()) == ["read-only"] * 3 + ["writable"] * 2


def test_markup(spark):
    star = N.xml(frame(spark, b'<r xmlns="u" a="1">t<!-- c --><![CDATA[d]]></r>'))
    assert {(r.operation, r.state) for r in star["capabilities"].collect()} == {("replace_xml_text", "writable"), ("replace_xml_attribute", "writable"), ("edit", "read-only")}
    page = frame(spark, b'<meta http-equiv="x" content="text/html; charset=UTF-8"><title>T</title><p>x</p><script>s</script>')
    assert N.html_encodings(page).first().declared == ["utf-8"]
    assert {r.reason_code for r in N.html(page)["capabilities"].collect()} == {None, "html.element.structural_edit_unsupported", "html.rcdata.read_only", "html.raw_text.read_only"}
    head = N.xml_declaration(frame(spark, b"\xef\xbb\xbf<?xml version='1.0' encoding='UTF-8'?><!DOCTYPE r><r/>")).first()
    assert (head.bom, head.declared, head.refused) == ("utf-8", "utf-8", True)


def test_notebook(spark):
    book = lambda n: json.dumps({"nbformat": n, "nbformat_minor": 0, "cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "raw", "source": 5}]}).encode()
    star = N.notebook(frame(spark, book(4), book(3), b"{}"))
    assert [(r.text, r.semantic_role) for r in star["nodes"].orderBy("index").collect()] == [("a\nb", "ipynb-code"), (None, "ipynb-raw")]
    assert states(star) == {(0, "writable", None), (0, "read-only", "ipynb.source.unsupported_type"), (1, "read-only", "ipynb.nbformat.unsupported_version")}


def test_sheets(spark):
    star = N.sheets(frame(spark, xlsx()))
    assert states(star) == {(0, "writable", None)} and {r.address for r in star["cells"].collect()} == {"A1", "B1", "A2", "B2"}
    assert star["canvases"].first().canvas_id.startswith("xlsx-sheet-")
