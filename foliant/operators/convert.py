"""Conversion of whole tables: route, try converters in order, normalise.

Routing and normalisation are Column expressions; only the converters run in
Python, over Arrow batches, and rows never fail a task: what goes wrong is in
``status`` and ``attempts``.
"""

from __future__ import annotations

import codecs
import json
import posixpath
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_output
from ..sources import binary, html, lexical, office, pdf, web
from . import layout
from .registry import TYPES, Registry, route
from .staging import settle

SAMPLE = 64 << 10


def decode(data: bytes, charset: str | None = None) -> str:
    """Text by the charset, else by detection over a sample that ends on a whole character, else UTF-8 without what is none."""
    if charset:
        try:
            return data.decode(codecs.lookup(charset).name)
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    end = SAMPLE
    while end < min(len(data), SAMPLE + 3) and data[end] & 0xC0 == 0x80:
        end += 1
    from charset_normalizer import from_bytes

    best = from_bytes(data[:end]).best()
    try:
        return data.decode(best.encoding) if best is not None else data.decode("utf-8", "ignore")
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "ignore")


Convert = Callable[[bytes, dict], "tuple[str, str | None] | None"]


def _html(data: bytes, info: dict) -> tuple[str, str | None]:
    return html.convert(decode(data, info.get("charset")), keep_data_uris=bool(info.get("keep_data_uris")), references=info.get("references") or "html")


def _youtube(data: bytes, info: dict) -> tuple[str, str | None]:
    return web.youtube(decode(data, info.get("charset")), info.get("transcript")) or _html(data, info)


def _zip(data: bytes, info: dict, depth: int = 4) -> tuple[str, str | None]:
    """Every member through the registry again; members that nothing takes are left out."""
    out = [f"Content from the zip file `{info.get('url') or info.get('local_path') or info.get('filename') or ''}`:\n"]
    for name, body in office.members(data).items():
        ext = posixpath.splitext(name)[1].lower()
        if ext == ".zip" and depth <= 1:
            continue
        got = convert_bytes(body, {"extension": ext, "mimetype": TYPES.get(ext), "filename": posixpath.basename(name)}, depth - 1)
        if got["status"] == "ok":
            out.append(f"## File: {name}\n\n{got['markdown']}\n")
    return "\n".join(out).strip(), None


#: Converters by name.
CONVERTERS: dict[str, Convert] = {
    "text": lambda d, i: (decode(d, i.get("charset")), None),
    "html": _html,
    "rss": lambda d, i: web.feed(d, i.get("url")),
    "wikipedia": lambda d, i: web.wikipedia(decode(d, i.get("charset"))),
    "youtube": _youtube,
    "bing": lambda d, i: web.bing(decode(d, i.get("charset")), i.get("url") or ""),
    "docx": lambda d, i: office.docx(d),
    "xlsx": lambda d, i: office.xlsx(d),
    "xls": lambda d, i: binary.xls(d),
    "pptx": lambda d, i: office.pptx(d),
    "epub": lambda d, i: office.epub(d),
    "msg": lambda d, i: binary.mail_markdown(d),
    "pdf": lambda d, i: pdf.pdf(d),
    "image": lambda d, i: binary.image(d),
    "audio": lambda d, i: binary.audio(d),
    "ipynb": lambda d, i: lexical.notebook(json.loads(decode(d, i.get("charset")).lstrip("﻿"))),
    "csv": lambda d, i: (lexical.csv_markdown(decode(d, i.get("charset"))), None),
    "zip": _zip,
    "rtf": lambda d, i: (lexical.rtf(decode(d, i.get("charset"))), None),
}


def _by_extension(info: dict) -> list[str]:
    """Routing of archive members, which have a name but no url: the rules' extensions in their order."""
    ext = (info.get("extension") or "").lower()
    return [r.name for r in Registry().order() if ext and ext in r.extensions and r.also is None and r.name in CONVERTERS]


def convert_bytes(data: bytes, info: dict, depth: int = 4, candidates: list[str] | None = None, converters: dict[str, Convert] | None = None) -> dict:
    """markdown, title, converter, status and attempts of one document: the first candidate that succeeds wins."""
    attempts = []
    for name in _by_extension(info) if candidates is None else candidates:
        run = (converters or CONVERTERS).get(name)
        if run is None:
            attempts.append({"converter": name, "error_class": "MissingDependency", "message": "no converter"})
            continue
        try:
            got = _zip(data, info, depth) if name == "zip" else run(data, info)
        except (Exception, RecursionError) as e:  # noqa: BLE001  a row's error is the row's
            attempts.append({"converter": name, "error_class": type(e).__name__, "message": str(e)[:500]})
            continue
        if got is not None:
            return {"markdown": got[0], "title": got[1], "converter": name, "status": "ok", "attempts": attempts}
    return {"markdown": None, "title": None, "converter": None, "status": "failed" if attempts else "unsupported", "attempts": attempts}


ATTEMPTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("converter", "error_class", "message")]))
INFO = ("mimetype", "extension", "charset", "filename", "local_path", "url")


def convert(df: DataFrame, key: str = "document_id", registry: Registry | None = None, keep_data_uris: bool = False, forms: bool = False, references: str = "html") -> DataFrame:
    """(key, converter, status, title, markdown, attempts) of documents (key, content, and any of mimetype, extension, charset, filename, local_path, url).

    With ``forms``, PDF pages that are forms become tables; the results are
    settled, and only the bytes of documents converted as PDF are laid out.
    ``references`` says which of them HTML pages have (see ``html.parse``).
    """
    registry = registry or Registry()
    for name in INFO:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    routed = route(df, registry).select(key, "content", *INFO, "candidates")
    converters = CONVERTERS | registry.converters

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [convert_bytes(bytes(r.content or b""), {n: getattr(r, n) for n in INFO} | {"keep_data_uris": keep_data_uris, "references": references}, candidates=list(r.candidates), converters=converters) for r in frame.itertuples()]
            yield pd.DataFrame({key: frame[key].to_numpy(), **{c: [r[c] for r in rows] for c in ("converter", "status", "title", "markdown", "attempts")}})

    schema = T.StructType([df.schema[key], *(T.StructField(n, T.StringType()) for n in ("converter", "status", "title", "markdown")), T.StructField("attempts", ATTEMPTS)])
    made = routed.mapInPandas(run, schema).withColumn("markdown", normalize_output("markdown"))
    if not forms:
        return made
    made = settle(made, "converted")
    found = pdf_markdown(df.select(key, "content").join(made.where("converter = 'pdf'").select(key), key, "left_semi"), key)
    laid = found.where("form_pages > 0").select(key, F.col("markdown").alias("_forms"))
    return made.join(laid, key, "left").withColumn("markdown", F.coalesce("_forms", "markdown")).drop("_forms")


def explode_bytes(df: DataFrame, function: Callable[[bytes], list[dict]], schema: str, key: str = "document_id") -> DataFrame:
    """Rows that a parser finds in each document: (key, schema..., error); a document it refuses is one row with its error."""
    own = T._parse_datatype_string(schema)
    names = own.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, content in zip(frame[key], frame["content"]):
                try:
                    out += [{key: k, **{n: r.get(n) for n in names}, "error": None} for r in function(bytes(content or b""))]
                except Exception as e:  # noqa: BLE001
                    out.append({key: k, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(out, columns=[key, *names, "error"], dtype=object)

    full = T.StructType([df.schema[key], *(T.StructField(f.name, f.dataType) for f in own.fields), T.StructField("error", T.StringType())])
    return df.select(key, "content").mapInPandas(run, full)


PAGE = "page int, width double, text string, words array<struct<text:string,x0:double,x1:double,top:double>>"


def pdf_markdown(df: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, markdown, form_pages) of PDF files: pages that are forms as tables, others as their lines, in order.

    Pages are parsed once and settled; word boxes are laid out by ``layout``
    on all pages at once, and a document is put together in one aggregate.
    Files that can't be parsed, and those without pages, have a null Markdown.
    """
    pages = settle(explode_bytes(df, pdf.page_table, PAGE, key).withColumnRenamed(key, "document_id"), "pdf-pages")
    words = pages.select("document_id", "page", "width", F.inline("words"))
    forms = layout.form_markdown(words).select("document_id", "page", F.col("markdown").alias("form"))
    numbers = F.regexp_replace("text", r"(?m)^[ \t]*(\.\d+)[ \t]*\n(?:[ \t]*\n)*[ \t]*(?=\S)([^\n]*)", "$1 $2")
    parts = pages.join(forms, ["document_id", "page"], "left").select("document_id", "page", F.coalesce("form", numbers).alias("body"), F.col("form").isNotNull().alias("is_form"))
    rows = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", "body"))))
    made = parts.groupBy("document_id").agg(rows.alias("_p"), F.count_if("is_form").alias("form_pages"))
    body = F.when(F.size("_p") > 0, normalize_output(F.trim(F.array_join(F.transform("_p", lambda p: p["body"]), "\n\n"))))
    return made.select(F.col("document_id").alias(key), body.alias("markdown"), "form_pages")


SHEET = "sheet_index int, sheet string, row int, column int, type string, value string, formula string, merged boolean, rich boolean"


def csv_fields(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, lambda b: lexical.csv_fields(decode(b)), "row int, column int, value string, start int, end int, raw string, quoted boolean", key)


def json_values(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, lambda b: lexical.json_values(decode(b)), "pointer string, kind string, start int, end int, raw string, parent string", key)


def xml_owners(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, lambda b: list(lexical.xml_owners(decode(b))), "kind string, path string, start int, end int, raw string, value string, name string, namespace string", key)


def html_owners(df: DataFrame, key: str = "document_id") -> DataFrame:
    def owners(data: bytes) -> list[dict]:
        out = []
        for n in html.parse(decode(data)).walk():
            out.append({"kind": "element", "name": n.tag, "value": None, "attributes": sorted(n.attrs)})
            kind = "rawtext" if n.tag in ("script", "style") else "rcdata" if n.tag in ("title", "textarea") else "text"
            out += [{"kind": kind, "name": n.tag, "value": c, "attributes": []} for c in n.children if isinstance(c, str)]
        return out

    return explode_bytes(df, owners, "kind string, name string, value string, attributes array<string>", key)


def xlsx_cells(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, office.xlsx_cells, SHEET, key)


def xls_cells(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, binary.xls_cells, SHEET, key)


def zip_members(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, office.member_rows, "name string, size long, packed long, crc long, sha256 string", key)


def pptx_shapes(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, office.pptx_shapes, "slide int, ordinal int, top long, left long, kind string, role string, text string", key)


def png_text(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, binary.png_text, "start int, kind string, keyword string, text string, writable boolean", key)


def jpeg_exif(df: DataFrame, key: str = "document_id") -> DataFrame:
    return explode_bytes(df, binary.jpeg_exif, "name string, text string, offset int, room int", key)


def compound_streams(df: DataFrame, key: str = "document_id") -> DataFrame:
    def streams(data: bytes) -> list[dict]:
        box = binary.Compound(data)
        return [{"path": list(p), "size": box.entries[i]["size"]} for p, i in box.streams.items()]

    return explode_bytes(df, streams, "path array<string>, size long", key)


def derived_snapshot(df: DataFrame, surface: str, key: str = "document_id") -> DataFrame:
    """One text node with a ``derived`` capability for each snapshot (key, uri, content, markdown): never writable."""
    from ..functions.ids import seeded_id
    from ..functions.text import block_digest

    seed = F.concat_ws("\x00", F.lit(surface), F.coalesce("uri", F.lit("")), F.sha2("content", 256), F.sha2("markdown", 256))
    out = df.withColumn("_seed", seed).withColumn("text", normalize_output("markdown"))
    return out.select(
        key, seeded_id("document", "_seed", F.lit(0)).alias("ir_document_id"), seeded_id("node", "_seed", F.lit(1)).alias("node_id"), F.lit("text").alias("kind"), "text", F.sha2("content", 256).alias("source_sha256"), F.length("content").cast("long").alias("source_bytes"), block_digest("markdown").alias("markdown_digest"), F.lit("derived").alias("state"), F.lit(f"{surface}.snapshot.read_only").alias("reason_code")
    )


def url_allowed(surface: str):
    """Which uris a remote snapshot may have: http(s) with a host and no credentials; search results https only."""
    u = F.col("uri")
    plain = F.rlike(u, F.lit(r"^https?://[^/?#@\s]+(?:[/?#]|$)"))
    return plain & (u.startswith("https://") if surface == "bing" else F.lit(True))
