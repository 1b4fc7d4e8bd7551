"""Native files as a star of model tables: documents, canvases, nodes, cells and capabilities.

Lexers give the owners; identities, roles and capability decisions are
Column rules over their rows.  ``documents`` in: document_id, content.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..sources import binary, lexical, office
from ..sources import pdf as pdf_source
from . import convert as CV
from .ir import HTML_RULES, JSON_RULES, SCHEMA_NAME, SCHEMA_VERSION, rule_capability

#: Cells up to which a sheet is laid out as a whole grid (a fixed value).
GRID_CELLS = 100_000


def documents(df: DataFrame, family: str) -> DataFrame:
    """One row a document with its source's digest, size and stable ids."""
    out = df.withColumn("sha256", F.sha2("content", 256))
    return out.select("document_id", F.lit(family).alias("format"), "sha256", F.length("content").cast("long").alias("size_bytes"), *I.source_ids("sha256", family), F.concat(F.lit(f"{family}:sha256:"), "sha256").alias("preserved_source_ref"), F.lit(SCHEMA_NAME).alias("schema_name"), F.lit(SCHEMA_VERSION).alias("schema_version"))


def _with_digest(rows: DataFrame, df: DataFrame) -> DataFrame:
    return rows.join(df.select("document_id", F.sha2("content", 256).alias("sha256")), "document_id")


def _decided(nodes: DataFrame, decision: Column) -> DataFrame:
    return nodes.withColumn("_d", decision).where("_d is not null").select("document_id", "node_id", F.coalesce("_d.operation", F.lit("edit")).alias("operation"), F.col("_d.state").alias("state"), F.col("_d.reason_code").alias("reason_code"))


def text(df: DataFrame) -> dict[str, DataFrame]:
    """One text node; writable if its bytes are UTF-8 and its line ends of one kind."""
    body = df.select("document_id", "content", F.sha2("content", 256).alias("sha256"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^﻿", "")).alias("text"))
    nodes = body.select("document_id", I.seeded_id("text", "sha256", F.lit(0)).alias("node_id"), F.lit("text").alias("kind"), F.lit("document").alias("semantic_role"), "text", (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom"), T.newline_kind("text").alias("newline"))
    reason = F.when(F.col("text").isNull(), "text.encoding.not_roundtrippable").when(F.col("newline") == "mixed", "text.newlines_mixed")
    caps = nodes.select("document_id", "node_id", F.lit("replace_text").alias("operation"), F.when(reason.isNull(), "writable").otherwise("read-only").alias("state"), reason.alias("reason_code"))
    return {"documents": documents(df, "text"), "nodes": nodes, "capabilities": caps}


def csv(df: DataFrame) -> dict[str, DataFrame]:
    """One table node and its fields as cells; the first rule that holds decides whether cells may be edited."""
    cells = CV.csv_fields(df)
    dialect = CV.explode_bytes(df, lambda b: [dict(zip(("delimiter", "proven", "dialect_reason"), lexical.csv_dialect(b.decode("utf-8"))))], "delimiter string, proven boolean, dialect_reason string")
    per = cells.where("error is null").groupBy("document_id").agg((F.max("row") + 1).alias("rows"), (F.max("column") + 1).alias("columns"), F.count("*").alias("fields"))
    joined = _with_digest(dialect.select("document_id", "proven", "dialect_reason", F.col("error").alias("decode_error")), df).join(per, "document_id", "left")
    nodes = joined.withColumn("node_id", F.concat(F.lit("csv-table-"), F.substring("sha256", 1, 24)))
    reason = F.when(F.col("decode_error").isNotNull(), "csv.encoding.not_roundtrippable").when(~F.col("proven"), F.coalesce("dialect_reason", F.lit("csv.dialect.ambiguous"))).when(F.coalesce("fields", F.lit(0)) == 0, "csv.table.no_writable_cells")
    caps = nodes.select("document_id", "node_id", F.lit("update_csv_cells").alias("operation"), F.when(reason.isNull(), "writable").otherwise("read-only").alias("state"), reason.alias("reason_code"))
    return {"documents": documents(df, "csv"), "nodes": nodes.select("document_id", "node_id", F.lit("table").alias("kind"), F.lit("csv-table").alias("semantic_role"), "rows", "columns"), "cells": cells, "capabilities": caps}


def json(df: DataFrame) -> dict[str, DataFrame]:
    """A node for every value, by pointer; scalars are writable."""
    values = _with_digest(CV.json_values(df).where("error is null"), df)
    nodes = values.select("document_id", I.json_value_id("sha256", "pointer").alias("node_id"), F.lit("unknown_native").alias("kind"), F.concat(F.lit("json-"), F.col("kind")).alias("semantic_role"), "pointer", F.when(F.col("parent").isNotNull(), I.json_value_id("sha256", "parent")).alias("parent_id"), "start", "end", "raw", F.col("kind").alias("value_kind"))
    return {"documents": documents(df, "json"), "nodes": nodes, "capabilities": _decided(nodes, rule_capability(F.col("value_kind"), JSON_RULES))}


def xml(df: DataFrame) -> dict[str, DataFrame]:
    from .ir import XML_RULES

    owners = _with_digest(CV.xml_owners(df).where("error is null"), df)
    nodes = owners.select("document_id", I.seeded_id("xml", "sha256", "path").alias("node_id"), F.lit("unknown_native").alias("kind"), F.concat(F.lit("xml-"), F.col("kind")).alias("semantic_role"), "path", "start", "end", "value", "namespace", F.col("kind").alias("owner_kind"))
    return {"documents": documents(df, "xml"), "nodes": nodes, "capabilities": _decided(nodes, rule_capability(F.col("owner_kind"), XML_RULES))}


def html(df: DataFrame) -> dict[str, DataFrame]:
    owners = _with_digest(CV.html_owners(df).where("error is null"), df)
    nodes = owners.select("document_id", I.seeded_id("html", "sha256", F.concat_ws("/", "kind", "name", F.coalesce("value", F.lit("")))).alias("node_id"), F.lit("unknown_native").alias("kind"), F.concat(F.lit("html-"), F.col("kind")).alias("semantic_role"), "name", "value", F.col("kind").alias("owner_kind"))
    return {"documents": documents(df, "html"), "nodes": nodes, "capabilities": _decided(nodes, rule_capability(F.col("owner_kind"), HTML_RULES))}


def html_encodings(df: DataFrame) -> DataFrame:
    """(document_id, declared): charsets that the first 4096 bytes declare, lower-cased, in order."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    found = F.regexp_extract_all(head, F.lit(r"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)"""), F.lit(1))
    return df.select("document_id", F.transform(found, lambda x: F.lower(x)).alias("declared"))


def xml_declaration(df: DataFrame) -> DataFrame:
    """(document_id, bom, declared, refused): byte order mark, declared encoding, and whether there is a document type."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    bom = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", "utf-8").when(F.hex(F.substring("content", 1, 2)) == "FFFE", "utf-16-le").when(F.hex(F.substring("content", 1, 2)) == "FEFF", "utf-16-be")
    declared = F.nullif(F.lower(F.regexp_extract(head, r"""^(?:ï»¿)?<\?xml[^>]*encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", 1)), F.lit(""))
    return df.select("document_id", bom.alias("bom"), declared.alias("declared"), F.rlike(head, F.lit(r"<!(?:DOCTYPE|ENTITY)")).alias("refused"))


def notebook(df: DataFrame) -> dict[str, DataFrame]:
    """A node for each cell of version 4 notebooks; others have none and one read-only decision."""

    def cells(data: bytes) -> list[dict]:
        import json as j

        book = j.loads(data)
        if not isinstance(book.get("nbformat"), int) or not isinstance(book.get("nbformat_minor"), int):
            raise ValueError("ipynb.nbformat.missing")
        if book["nbformat"] != 4:
            return [{"index": -1, "cell_type": None, "source": None}]
        out = []
        for i, c in enumerate(book.get("cells") or []):
            s = c.get("source", "")
            ok = isinstance(s, str) or (isinstance(s, list) and all(isinstance(x, str) for x in s))
            out.append({"index": i, "cell_type": c.get("cell_type"), "source": "".join(s) if ok else None})
        return out

    rows = _with_digest(CV.explode_bytes(df, cells, "index int, cell_type string, source string").where("error is null"), df)
    nodes = rows.select("document_id", I.seeded_id("cell", "sha256", "index").alias("node_id"), F.lit("text").alias("kind"), F.concat(F.lit("ipynb-"), F.coalesce("cell_type", F.lit("unsupported"))).alias("semantic_role"), F.col("source").alias("text"), "index")
    reason = F.when(F.col("index") < 0, "ipynb.nbformat.unsupported_version").when(F.col("text").isNull(), "ipynb.source.unsupported_type")
    caps = nodes.select("document_id", "node_id", F.lit("replace_ipynb_cell_source").alias("operation"), F.when(reason.isNull(), "writable").otherwise("read-only").alias("state"), reason.alias("reason_code"))
    return {"documents": documents(df, "ipynb"), "nodes": nodes.where("index >= 0"), "capabilities": caps}


def sheets(df: DataFrame) -> dict[str, DataFrame]:
    """Sheets as canvases, their cells with what forbids an edit, and whether a sheet is laid out as a grid."""
    cells = _with_digest(CV.xlsx_cells(df).where("error is null"), df)
    reason = F.when(F.col("formula").isNotNull(), "xlsx.cell.formula_requires_explicit_formula_edit").when(F.col("merged"), "xlsx.cell.merged_range").when(F.coalesce("rich", F.lit(False)), "xlsx.cell.rich_text_requires_run_preserving_edit").when(F.col("type").isin("error", "date"), "xlsx.cell.unsupported_type")
    cells = cells.withColumns({"canvas_id": I.sheet_id("sha256", "sheet_index", "sheet"), "read_only_reason": reason, "address": I.a1_encode("row", "column")})
    per = cells.groupBy("document_id", "canvas_id", "sheet_index", "sheet").agg((F.max("row") + 1).cast("long").alias("rows"), (F.max("column") + 1).cast("long").alias("columns"), F.count_if(F.col("read_only_reason").isNull()).alias("writable"))
    large = F.col("rows") * F.col("columns") > GRID_CELLS
    why = F.when(large, "xlsx.sheet.grid_too_large_to_materialize").when(F.col("writable") == 0, "xlsx.sheet.no_writable_cells")
    caps = per.select("document_id", F.col("canvas_id").alias("node_id"), F.lit("update_sheet_cells").alias("operation"), F.when(why.isNull(), "writable").otherwise("read-only").alias("state"), why.alias("reason_code"))
    return {"documents": documents(df, "xlsx"), "canvases": per, "cells": cells, "capabilities": caps}


OWNER = "owner string, value string, operation string, reason string, again int"


def owned(df: DataFrame, family: str, find: Callable[[bytes], list[dict]], operation: str | None = None) -> dict[str, DataFrame]:
    """A node for every editable value that ``find`` names, and the decision on each (owners of one name are numbered); a document it refuses has one read-only decision."""

    def rows(data: bytes) -> list[dict]:
        seen: Counter = Counter()
        out = []
        for o in find(data):
            o = {"operation": operation, **o}
            key = o["operation"], o["owner"]
            out.append(o | {"again": seen[key] or None})
            seen[key] += 1
        return out

    name = F.concat_ws("\x00", F.coalesce("operation", F.lit("edit")), F.coalesce("owner", F.lit("")), F.col("again").cast("string"))
    found = _with_digest(CV.explode_bytes(df, rows, OWNER), df).withColumn("node_id", I.seeded_id(family, "sha256", name))
    nodes = found.where("error is null").select("document_id", "node_id", F.when(F.col("operation") == "replace_text", "text").otherwise("unknown_native").alias("kind"), F.concat(F.lit(f"{family}-"), "operation").alias("semantic_role"), "owner", "value")
    reason = F.when(F.col("error").isNotNull(), F.lit(f"{family}.source.refused")).otherwise(F.col("reason"))
    caps = found.select("document_id", "node_id", F.coalesce("operation", F.lit("edit")).alias("operation"), F.when(reason.isNull(), "writable").otherwise("read-only").alias("state"), reason.alias("reason_code"))
    return {"documents": documents(df, family), "nodes": nodes, "capabilities": caps}


def epub(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "epub", office.epub_owners)


def archive(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "zip", office.zip_owners)


def docx(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "docx", office.docx_owners)


def pptx(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "pptx", office.pptx_owners)


def pdf(df: DataFrame) -> dict[str, DataFrame]:
    """Information fields, links and text fields."""

    def find(data: bytes) -> list[dict]:
        refused = next((reason for mark, reason in pdf_source.REFUSED.items() if mark in data), None)
        out = [{"owner": k, "value": v, "operation": "update_pdf_metadata", "reason": None} for k, v in pdf_source.info(data).items()]
        out += [o | {"operation": "update_pdf_link_uri"} for o in pdf_source.links(data)]
        out += [o | {"operation": "update_pdf_text_field_value"} for o in pdf_source.text_fields(data)]
        return [o | {"reason": refused or o["reason"]} for o in out]

    return owned(df, "pdf", find)


def png(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "png", lambda b: [{"owner": o["keyword"], "value": o["text"], "reason": None if o["writable"] else "png.text.not_unique_or_animated"} for o in binary.png_text(b)], "update_png_text_metadata")


def jpeg(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "jpeg", lambda b: [{"owner": o["name"], "value": o["text"], "reason": None} for o in binary.jpeg_exif(b)], "update_jpeg_exif_text")


def mp3(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "mp3", binary.id3v1, "update_mp3_id3v1_text")


def msg(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "msg", binary.msg_subject, "update_msg_subject_text")


def xls(df: DataFrame) -> dict[str, DataFrame]:
    return owned(df, "xls", binary.xls_numbers, "update_sheet_cells")


READERS = {"text": text, "csv": csv, "json": json, "xml": xml, "html": html, "ipynb": notebook, "xlsx": sheets, "epub": epub, "zip": archive, "docx": docx, "pptx": pptx, "pdf": pdf, "png": png, "jpeg": jpeg, "mp3": mp3, "msg": msg, "xls": xls}
