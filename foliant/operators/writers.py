"""Source-preserving writers: documents and their edits to patched bytes.

For each document: the source is what the caller says it is, all edits pass
their checks on a fresh parse, the tokens are spliced, and the candidate is
read again: what was asked is there, all else is as before.  Otherwise the
row has its error and no bytes.  No edits give back the very source.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import binary, html, lexical, office, patches, pdf
from .ir import HTML_RULES

#: Archives inside archives (a fixed value).
ZIP_DEPTH = 4
RESULT = "status string, reason string, tier string, candidate binary, bytes_written long"


class Refused(Exception):
    """An edit's reason code."""


def _spliced(text: str, tokens: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, token in sorted(tokens):
        if start < at:
            raise Refused("overlapping_spans")
        out += [text[at:start], token]
        at = end
    return "".join([*out, text[at:]])


def _codec(data: bytes) -> tuple[str, str]:
    """Encoding and text; only what decodes and encodes to the same bytes is edited."""
    for name, mark in (("utf-8-sig", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-8", b"")):
        if data.startswith(mark):
            try:
                text = data.decode(name)
            except UnicodeDecodeError as e:
                raise Refused("encoding.not_roundtrippable") from e
            if text.encode(name) != data:
                raise Refused("encoding.not_roundtrippable")
            return name, text
    raise Refused("encoding.not_roundtrippable")


def _by_owner(owners: Callable[[str], list[dict]], key: Callable[[dict], object], token: Callable[[dict, dict], str], read: Callable[[dict], object], want: Callable[[dict], object]) -> Callable:
    """A text format's writer from its lexer: edits name an owner and what is new."""

    def write(data: bytes, edits: list[dict]) -> bytes:
        name, text = _codec(data)
        before = {key(o): o for o in owners(text)}
        asked: dict = {}
        for e in edits:
            k = tuple(e["target"]) if isinstance(e["target"], list) else e["target"]
            if k not in before:
                raise Refused("target_missing")
            if k in asked:
                raise Refused("duplicate_target")
            if "old" in e and e["old"] is not None and read(before[k]) != e["old"]:
                raise Refused("old_value_mismatch")
            if read(before[k]) == want(e):
                raise Refused("no_op_update")
            asked[k] = e
        made = _spliced(text, [(before[k]["start"], before[k]["end"], token(before[k], e)) for k, e in asked.items()])
        after = {key(o): o for o in owners(made)}
        if list(after) != list(before):
            raise Refused("topology_changed")
        for k, o in after.items():
            if (read(o) != want(asked[k])) if k in asked else (o.get("kind") not in ("object", "array", "element") and read(o) != read(before[k])):
                raise Refused("verification_failed")
        return made.encode(name)

    return write


def _csv_token(owner: dict, edit: dict) -> str:
    new = edit["new"]
    if "\n" in new or "\r" in new:
        raise Refused("newline_in_replacement")
    return '"' + new.replace('"', '""') + '"' if owner["quoted"] or "," in new or '"' in new else new


def _json_token(owner: dict, edit: dict) -> str:
    if owner["kind"] in ("object", "array") or isinstance(edit["new"], (dict, list)):
        raise Refused("json.container.structural_edit_unsupported")
    return json.dumps(edit["new"], ensure_ascii=False, allow_nan=False)


def _xml_token(owner: dict, edit: dict) -> str:
    if owner["kind"] not in ("text", "attribute"):
        raise Refused(f"xml.{owner['kind']}.structural_edit_unsupported")
    out = edit["new"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;").replace("'", "&apos;").replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;") if owner["kind"] == "attribute" else out


def _html_token(owner: dict, edit: dict) -> str:
    """Texts and quoted attributes; what the capability rules call read-only stays as it is."""
    operation, reason = HTML_RULES.get(owner["kind"], (None, f"html.{owner['kind']}.read_only"))
    if operation is None:
        raise Refused(reason)
    if owner["kind"] == "attribute" and not owner["quote"]:
        raise Refused("html.attribute.unquoted")
    out = edit["new"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace(owner["quote"], {'"': "&quot;", "'": "&#39;"}[owner["quote"]]) if owner["quote"] else out


def _html(data: bytes, edits: list[dict]) -> bytes:
    """Edits name a path, or with ``first`` the first text of an element by its name."""
    if any("first" in e for e in edits):
        known = html.spans(_codec(data)[1])
        first = {}
        for o in known:
            if o["kind"] in ("text", "rcdata", "rawtext"):
                first.setdefault(o["name"], o["path"])
        if any("first" in e and e["first"] not in first for e in edits):
            raise Refused("target_missing")
        edits = [{**e, "target": first[e["first"]]} if "first" in e else e for e in edits]
    return _html_by_path(data, edits)


def _text(data: bytes, edits: list[dict]) -> bytes:
    name, text = _codec(data)
    if len(edits) != 1:
        raise Refused("single_edit_expected")
    new = edits[0]["new"].replace("\r\n", "\n").replace("\r", "\n")
    plain = text.replace("\r\n", "")
    kinds = [s for s, there in (("\r\n", "\r\n" in text), ("\n", "\n" in plain), ("\r", "\r" in plain)) if there]
    if len(kinds) > 1:
        raise Refused("text.newlines_mixed")
    if not kinds and "\n" in new:
        raise Refused("text.no_newline_convention")
    if edits[0].get("old") is not None and edits[0]["old"] != text:
        raise Refused("old_value_mismatch")
    return new.replace("\n", kinds[0] if kinds else "\n").encode(name)


def _ipynb(data: bytes, edits: list[dict]) -> bytes:
    """Cell sources, lowered to edits of the strings that hold them."""
    book, low = json.loads(data), []
    if book.get("nbformat") != 4:
        raise Refused("ipynb.nbformat.unsupported_version")
    for e in edits:
        i = int(e["target"])
        if not 0 <= i < len(book.get("cells", [])):
            raise Refused("target_missing")
        source = book["cells"][i].get("source")
        if isinstance(source, str):
            low.append({"target": f"/cells/{i}/source", "new": e["new"], "old": e.get("old")})
            continue
        lines = e["new"].splitlines(keepends=True)
        n = len(source)
        if not n:
            raise Refused("ipynb.source.no_segments")
        parts = [*lines[: n - 1], "".join(lines[n - 1 :])] if len(lines) > n else [*lines, *[""] * (n - len(lines))]
        low += [{"target": f"/cells/{i}/source/{k}", "new": p} for k, p in enumerate(parts) if p != source[k]]
    return WRITERS["json"](data, low)


def _package(edit_member: Callable[[bytes, list[dict]], bytes]) -> Callable:
    """A container's writer: edits name member and target; all other members keep their bytes."""

    def write(data: bytes, edits: list[dict]) -> bytes:
        parts, by = office.members(data), {}
        for e in edits:
            if e["member"] not in parts:
                raise Refused("member_missing")
            by.setdefault(e["member"], []).append(e)
        new = {m: edit_member(parts[m], es) for m, es in by.items()}
        made = office.rewrite(data, new)
        if {k: v for k, v in office.members(made).items() if k not in new} != {k: v for k, v in parts.items() if k not in new}:
            raise Refused("package_changed")
        return made

    return write


def _zip(data: bytes, edits: list[dict], depth: int = 1) -> bytes:
    """Edits name a chain of members, ``inner.zip!/a.csv``; archives are rebuilt from the innermost outwards."""
    if depth > ZIP_DEPTH:
        raise Refused("zip.depth_exceeded")
    by: dict[str, list[dict]] = {}
    for e in edits:
        head, _, rest = e["member"].partition("!/")
        by.setdefault(head, []).append({**e, "member": head, "_rest": rest or None})

    def member(part: bytes, es: list[dict]) -> bytes:
        inner = [{k: v for k, v in e.items() if k != "_rest"} | {"member": e["_rest"]} for e in es if e["_rest"] is not None]
        own = [e for e in es if e["_rest"] is None]
        if (inner and own) or len({e["format"] for e in own}) > 1:
            raise Refused("zip.mixed_edits")
        return _zip(part, inner, depth + 1) if inner else WRITERS[own[0]["format"]](part, [{**e, "member": e.get("part")} for e in own])

    return _package(member)(data, [e for es in by.values() for e in es])


def _xlsx(data: bytes, edits: list[dict]) -> bytes:
    """Values of native cells (``target``: sheet and address); only their elements in the sheets' parts change."""
    before = office.xlsx_cells(data)
    at = {(c["sheet"], c["row"], c["column"]): c for c in before}
    extent: dict[str, tuple[int, int]] = {}
    for c in before:
        r, k = extent.get(c["sheet"], (0, 0))
        extent[c["sheet"]] = max(r, c["row"] + 1), max(k, c["column"] + 1)
    asked: dict[tuple[str, int, int], object] = {}
    for e in edits:
        sheet, address = e["target"]
        if sheet not in extent:
            raise Refused("unsupported_sheet_structure")
        try:
            row, column = office.a1(address)
        except ValueError as x:
            raise Refused("invalid_edit_payload") from x
        key = (sheet, row, column)
        if key in asked:
            raise Refused("duplicate_cell_coordinate")
        if row >= extent[sheet][0] or column >= extent[sheet][1]:
            raise Refused("cell_out_of_range")
        if "new" not in e:
            raise Refused("missing_typed_cell_value")
        new = patches.scalar(e["new"])
        if key not in at:
            raise Refused("xlsx.cell.missing_native_cell")
        if reason := office.cell_reason(at[key]):
            raise Refused(reason)
        have = patches.cell_scalar(at[key])
        if "old" in e and patches.scalar(e["old"]) != have:
            raise Refused("cell_old_value_mismatch")
        if new == have:
            raise Refused("no_op_cell_update")
        asked[key] = e["new"]
    by: dict[str, dict[str, object]] = {}
    for key, value in asked.items():
        by.setdefault(at[key]["part"], {})[at[key]["address"]] = value

    parts = office.members(data)
    new_parts = {}
    for part, updates in by.items():
        name, text = _codec(parts[part])
        new_parts[part] = _spliced(text, patches.sheet_tokens(text, lexical.xml_tree(text), updates)).encode(name)
    made = office.rewrite(data, new_parts)
    after = office.xlsx_cells(made)
    if [(c["sheet"], c["row"], c["column"]) for c in after] != [(c["sheet"], c["row"], c["column"]) for c in before]:
        raise Refused("topology_changed")
    for a, b in zip(after, before):
        key = (a["sheet"], a["row"], a["column"])
        if (patches.cell_scalar(a) != patches.scalar(asked[key])) if key in asked else a != b:
            raise Refused("verification_failed")
    return made


def _office(family: str) -> Callable:
    """Edits of a part: of whole paragraphs, table cells, runs' styles, alternative texts and boxes, or of XML owners by path."""

    def member(data: bytes, edits: list[dict]) -> bytes:
        if all("operation" not in e for e in edits):
            return WRITERS["xml"](data, edits)
        name, text = _codec(data)
        root = lexical.xml_tree(text)
        paragraphs, tables = list(root.walk("p")), list(root.walk("tbl"))
        at = lambda rows, i: rows[i] if isinstance(i, int) and 0 <= i < len(rows) else _missing()
        tokens: list[tuple[int, int, str]] = []
        wanted: list[tuple[int, str]] = []
        for e in edits:
            what = e.get("operation")
            if what in ("replace_text", "update_table_cells"):
                p = at(paragraphs, e["paragraph"]) if what == "replace_text" else patches.table_cell(at(tables, e["table"]), e["row"], e["column"])
                tokens += patches.text_tokens(text, p, e["new"], family, e.get("old"))
                wanted.append((paragraphs.index(p), e["new"]))
            elif what == "set_text_style":
                tokens += patches.style_tokens(text, at(paragraphs, e["paragraph"]), e["run"], e["new"], family)
            elif what == "set_alt_text":
                tokens += patches.alt_tokens(root, str(e["shape"]), e["new"])
            elif what == "move_resize" and family == "pptx":
                tokens += patches.geometry_tokens(root, str(e["shape"]), e["new"])
            else:
                raise Refused("unsupported_operation")
        made = _spliced(text, tokens)
        after = [patches.paragraph_text(p) for p in lexical.xml_tree(made).walk("p")]
        expect = [patches.paragraph_text(p) for p in paragraphs]
        for i, new in wanted:
            expect[i] = new
        if after != expect:
            raise Refused("verification_failed")
        return made.encode(name)

    return _package(member)


def _missing():
    raise Refused("target_missing")


def _single(write: Callable[[bytes, str, str], bytes]) -> Callable:
    def run(data: bytes, edits: list[dict]) -> bytes:
        for e in edits:
            try:
                data = write(data, e["target"], e["new"])
            except StopIteration as x:
                raise Refused("target_missing") from x
            except ValueError as x:
                raise Refused(str(x)) from x
        return data

    return run


_html_by_path = _by_owner(html.spans, lambda o: o["path"], _html_token, lambda o: o["value"], lambda e: e["new"])
WRITERS: dict[str, Callable[[bytes, list[dict]], bytes]] = {
    "text": _text,
    "csv": _by_owner(lexical.csv_fields, lambda o: (o["row"], o["column"]), _csv_token, lambda o: o["value"], lambda e: e["new"]),
    "json": _by_owner(lexical.json_values, lambda o: o["pointer"], _json_token, lambda o: json.loads(o["raw"]) if o["kind"] not in ("object", "array") else o["kind"], lambda e: e["new"]),
    "xml": _by_owner(lambda t: list(lexical.xml_owners(t)), lambda o: o["path"], _xml_token, lambda o: o["value"], lambda e: e["new"]),
    "html": _html,
    "ipynb": _ipynb,
    "png": _single(binary.png_replace),
    "jpeg": _single(binary.jpeg_replace),
    "mp3": _single(binary.id3v1_replace),
    "pdf": pdf.update,
    "msg": _single(binary.msg_replace),
    "xls": binary.xls_replace,
}
WRITERS["epub"] = _package(lambda data, edits: WRITERS["xml"](data, edits))
WRITERS |= {"docx": _office("docx"), "pptx": _office("pptx"), "xlsx": _xlsx, "zip": _zip}


def write_one(family: str, data: bytes, edits: list[dict], sha256: str | None = None) -> dict:
    """status, reason, tier, candidate and bytes_written of one document."""
    refuse = lambda reason: {"status": "refused", "reason": reason[:200], "tier": None, "candidate": None, "bytes_written": 0}
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256:
        return refuse("source_digest_mismatch")
    if family not in WRITERS:
        return refuse("unsupported_format")
    if not edits:
        return {"status": "ok", "reason": None, "tier": "exact-preserve", "candidate": data, "bytes_written": len(data)}
    try:
        made = WRITERS[family](data, edits)
    except Refused as e:
        return refuse(str(e))
    except ValueError as e:  # parsers and patches name their reason
        return refuse(str(e))
    except Exception as e:  # noqa: BLE001  a row's error is the row's
        return refuse(f"{type(e).__name__}: {e}")
    return {"status": "ok", "reason": None, "tier": "exact-preserve", "candidate": made, "bytes_written": len(made)}


def write(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """documents (document_id, format, content, sha256 or null) patched by edits (document_id, position, payload as JSON).

    Edits are gathered by document before they meet the bytes, so contents are
    shuffled once at most; documents without edits return their source.
    """
    per = edits.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "payload"))), lambda x: x["payload"]).alias("edits"))
    joined = documents.join(per, "document_id", "left").select("document_id", "format", "content", "sha256", "edits")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [write_one(r.format, bytes(r.content or b""), [json.loads(e) for e in (r.edits if r.edits is not None else [])], r.sha256) for r in frame.itertuples()]
            yield pd.DataFrame({"document_id": frame.document_id.to_numpy(), **{c: [r[c] for r in rows] for c in ("status", "reason", "tier", "candidate", "bytes_written")}})

    schema = T.StructType([documents.schema["document_id"], *T._parse_datatype_string(RESULT).fields])
    return joined.mapInPandas(run, schema)
