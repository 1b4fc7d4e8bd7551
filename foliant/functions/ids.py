"""Identities, digests and small codecs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def nul_joined(*parts: str | Column) -> Column:
    return F.concat_ws("\x00", *[_c(p).cast("string") for p in parts])


def seeded_id(label: str, seed: str | Column, counter: str | Column) -> Column:
    """``label-`` and 24 hex digits that depend on seed, label and counter; without a seed the counter itself."""
    made = F.concat(F.lit(f"{label}-"), F.substring(F.sha2(nul_joined(seed, F.lit(label), counter), 256), 1, 24))
    return F.when(_c(seed).isNull(), F.concat(F.lit(f"local-{label}-"), _c(counter).cast("string"))).otherwise(made)


def projection_id(document_id: str | Column, node_id: str | Column, ordinal: str | Column) -> Column:
    return F.concat(F.lit("p_"), F.substring(F.sha2(nul_joined(document_id, node_id, ordinal), 256), 1, 20))


def edit_id(pid: str | Column, kind: str | Column, value: str | Column) -> Column:
    return F.concat(F.lit("edit_"), F.substring(F.sha2(nul_joined(pid, kind, F.sha2(_c(value), 256)), 256), 1, 24))


def source_ids(digest: str | Column, family: str, parts: tuple[str, ...] = ("document", "canvas")) -> list[Column]:
    return [F.concat(F.lit(f"{family}-{p}-"), F.substring(_c(digest), 1, 24)).alias(f"{p}_id") for p in parts]


def json_value_id(digest: str | Column, pointer: str | Column) -> Column:
    return F.concat(F.lit("json-value-"), F.substring(_c(digest), 1, 16), F.lit("-"), F.substring(F.sha2(_c(pointer), 256), 1, 20))


def sheet_id(digest: str | Column, index: str | Column, part: str | Column) -> Column:
    return F.concat(F.lit("xlsx-sheet-"), F.substring(F.sha2(F.concat_ws(":", _c(digest), _c(index).cast("string"), _c(part)), 256), 1, 24))


def pointer_escape(segment: str | Column) -> Column:
    return F.replace(F.replace(_c(segment), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def child_pointer(parent: str | Column, segment: str | Column) -> Column:
    return F.concat(_c(parent), F.lit("/"), pointer_escape(segment))


def a1_column(index: str | Column) -> Column:
    """Letters of a zero-based column (three at most)."""
    n = _c(index).cast("int")
    letter = lambda x: F.char((F.lit(65) + x).cast("int"))
    one, two = letter(n % 26), F.concat(letter((F.floor(n / 26) - 1) % 26), letter(n % 26))
    three = F.concat(letter(F.floor((n - 702) / 676) % 26), letter(F.floor((n - 702) / 26) % 26), letter((n - 702) % 26))
    return F.when(n < 26, one).when(n < 702, two).otherwise(three)


def a1_encode(row: str | Column, column: str | Column) -> Column:
    """Cell address of zero-based indices; null out of the sheet's bounds."""
    r, c = _c(row).cast("long"), _c(column).cast("long")
    inside = r.between(0, 1048575) & c.between(0, 16383)
    return F.when(inside, F.concat(a1_column(c), (r + 1).cast("string")))


def a1_decode(address: str | Column) -> Column:
    """struct(row, column), zero-based; null for what is no address."""
    a = _c(address)
    letters = F.regexp_extract(a, r"^([A-Z]{1,3})([1-9][0-9]{0,6})$", 1)
    digits = F.regexp_extract(a, r"^([A-Z]{1,3})([1-9][0-9]{0,6})$", 2)
    column = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda t, x: t * 26 + F.ascii(x) - 64) - 1
    row = digits.try_cast("int") - 1
    return F.when((letters != "") & (row < 1048576) & (column < 16384), F.struct(row.alias("row"), column.alias("column")))


#: Windows code pages whose codec has another name (fixed values of the mail format).
CODEPAGES = {20127: "ascii", 20866: "koi8-r", 21866: "koi8-u", 28591: "iso8859-1", 28592: "iso8859-2", 28595: "iso8859-5", 28597: "iso8859-7", 28599: "iso8859-9", 28605: "iso8859-15", 50220: "iso2022-jp", 51932: "euc-jp", 51949: "euc-kr", 54936: "gb18030", 65000: "utf-7", 65001: "utf-8"}


def codepage_codec(page: str | Column) -> Column:
    """Codec name of a code page: the table's, else cpNNN, null for none."""
    p = _c(page).cast("int")
    table = F.create_map(*[F.lit(x) for kv in CODEPAGES.items() for x in kv])
    return F.when(p > 0, F.coalesce(F.try_element_at(table, p), F.concat(F.lit("cp"), p.cast("string"))))


def id3v1(content: str | Column) -> Column:
    """struct(title, artist, album) of the last 128 bytes; null without a tag."""
    tail = F.substring(_c(content), -128, 128)
    slot = lambda at: F.nullif(F.rtrim(F.regexp_extract(F.decode(F.substring(tail, at, 30), "ISO-8859-1"), r"(?s)^([^\x00]*)", 1)), F.lit(""))
    there = (F.length(_c(content)) >= 128) & (F.hex(F.substring(tail, 1, 3)) == "544147")
    return F.when(there, F.struct(slot(4).alias("title"), slot(34).alias("artist"), slot(64).alias("album")))


def sniff(content: str | Column) -> Column:
    """struct(mimetype, extension) by signature; null for what has none."""
    head = F.hex(F.substring(_c(content), 1, 16))
    text = F.lower(F.ltrim(F.decode(F.substring(_c(content), 1, 256), "ISO-8859-1")))
    kind = lambda m, e: F.struct(F.lit(m).alias("mimetype"), F.lit(e).alias("extension"))
    out = F.when(head.startswith("25504446"), kind("application/pdf", ".pdf")).when(head.startswith("89504E470D0A1A0A"), kind("image/png", ".png")).when(head.startswith("FFD8FF"), kind("image/jpeg", ".jpg"))
    out = out.when(head.startswith("504B0304"), kind("application/zip", ".zip")).when(head.startswith("D0CF11E0A1B11AE1"), kind("application/x-ole-storage", None)).when(head.startswith("494433") | head.startswith("FFFB"), kind("audio/mpeg", ".mp3"))
    out = out.when(F.rlike(text, F.lit(r"^(?:<!--.*?-->\s*)?(?:<!doctype html|<html[\s>])")), kind("text/html", ".html")).when(text.startswith("<?xml") | F.rlike(text, F.lit(r"^<(?:rss|feed)[\s>]")), kind("text/xml", ".xml"))
    out = out.when(F.rlike(text, F.lit(r"^[\[{]")), kind("application/json", ".json"))
    return out.when(F.is_valid_utf8(_c(content).cast("string")), kind("text/plain", ".txt"))
