"""Office edits lowered to tokens: spans of a part's text and what replaces them.

Each function takes the parsed part and what is asked and returns
(start, end, token) triples; all text between the spans stays.  What can't be
done raises ValueError with its reason code.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterable

from .lexical import Element, xml_tree

Token = tuple[int, int, str]
#: Children of a paragraph that plain text can't stand for (fixed values).
STRUCTURE = ("br", "cr", "tab", "sym", "fld", "fldChar", "instrText", "del", "ins", "moveFrom", "moveTo", "oMath", "p", "noBreakHyphen")


def escaped(text: str, quote: str = "") -> str:
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;").replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;") if quote else out


def attribute(e: Element, name: str, value: str | None) -> list[Token]:
    """An attribute set, added after the others, or with None taken out together with the space before it."""
    have = e.attributes.get(name)
    if have is None:
        return [] if value is None else [(e.attrs[0], e.attrs[0], f' {name}="{escaped(value, chr(34))}"')]
    return [(have[1], have[2], "" if value is None else f'{name}="{escaped(value, chr(34))}"')]


# -- sheets ------------------------------------------------------------------------------------------------------------


def scalar(value: object) -> tuple[str, object]:
    """Type and value of a JSON scalar: true, 1 and 1.0 are three values."""
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "bool", value
    if isinstance(value, int):
        return "int", value
    if isinstance(value, float) and math.isfinite(value):
        return "float", value
    if isinstance(value, str):
        return "string", value
    raise ValueError("invalid_cell_value")


def cell_scalar(cell: dict) -> tuple[str, object]:
    kind, raw = cell["type"], cell["value"]
    if kind == "string":
        return kind, raw or ""
    return kind, {"bool": lambda: raw == "TRUE", "int": lambda: int(raw), "float": lambda: float(raw)}.get(kind, lambda: raw)()


def cell_tokens(text: str, c: Element, value: object) -> list[Token]:
    """A cell's type and value; its style, position and extensions stay."""
    kind, v = scalar(value)
    p = c.prefix
    made = {"null": "", "bool": f"<{p}v>{int(bool(v))}</{p}v>", "string": f'<{p}is><{p}t xml:space="preserve">{escaped(str(v))}</{p}t></{p}is>'}.get(kind, f"<{p}v>{v!r}</{p}v>")
    out = attribute(c, "t", {"bool": "b", "string": "inlineStr"}.get(kind))
    if c.inner == c.end:  # <c r="A1"/>
        slash = text.rindex("/", c.start, c.end)
        return [*out, (slash, c.end, f">{made}</{c.name}>")] if made else out
    old = [(e.start, e.end, "") for e in c.of("v", "is")]
    return [*out, (c.inner, c.inner, made), *old] if made else [*out, *old]


def sheet_tokens(text: str, root: Element, updates: dict[str, object]) -> list[Token]:
    """Updates by cell address, each cell native."""
    cells = {c.attributes["r"][0]: c for row in root.walk("row") for c in row.of("c") if "r" in c.attributes}
    if any(a not in cells for a in updates):
        raise ValueError("xlsx.cell.missing_native_cell")
    return [t for a, v in updates.items() for t in cell_tokens(text, cells[a], v)]


# -- paragraphs --------------------------------------------------------------------------------------------------------


def paragraph_text(p: Element) -> str:
    return "".join(t.value() for t in p.walk("t"))


def paragraph_reason(p: Element, family: str) -> str | None:
    if any(e is not p and e.local in STRUCTURE for e in p.walk()):
        return f"{family}.paragraph.unsupported_structure"
    return None if p.first("t") else "no_style_context"


def shares(old: list[str], new: str) -> list[str]:
    """``new`` dealt to the runs that hold ``old``: kept characters stay with theirs, others go to the one before."""
    whole = "".join(old)
    owner = [i for i, t in enumerate(old) for _ in t]
    out = [""] * len(old)
    for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, whole, new, autojunk=False).get_opcodes():
        for k in range(b0, b1):
            at = a0 + (k - b0) if op == "equal" else a0 if op == "replace" else a0 - 1
            out[owner[max(0, at)] if owner else 0] += new[k]
    return out


def text_tokens(text: str, p: Element, new: str, family: str, old: str | None = None) -> list[Token]:
    """A paragraph's text; every run keeps its style."""
    reason = paragraph_reason(p, family)
    if reason:
        raise ValueError(reason)
    if "\n" in new or "\r" in new:
        raise ValueError("paragraph_count_changed")
    if old is not None and paragraph_text(p) != old:
        raise ValueError("old_value_mismatch")
    if paragraph_text(p) == new:
        raise ValueError("no_op_update")
    holders = list(p.walk("t"))
    out: list[Token] = []
    for t, part in zip(holders, shares([t.value() for t in holders], new)):
        if part == t.value():
            continue
        out += attribute(t, "xml:space", "preserve" if part != part.strip() else None)
        if t.inner == t.end:
            slash = text.rindex("/", t.start, t.end)
            out.append((slash, t.end, f">{escaped(part)}</{t.name}>"))
        else:
            out.append((t.inner, t.close, escaped(part)))
    return out


def table_cell(table: Element, row: int, column: int) -> Element:
    """The one paragraph of a cell of a table without spans or holes."""
    rows = [r.of("tc") for r in table.of("tr")]
    spans = any({"gridSpan", "rowSpan", "hMerge", "vMerge"} & set(c.attributes) or c.first("gridSpan", "vMerge", "hMerge") for r in rows for c in r)
    if spans or len({len(r) for r in rows}) != 1:
        raise ValueError("unsupported_table_structure")
    if not (0 <= row < len(rows) and 0 <= column < len(rows[0])):
        raise ValueError("cell_out_of_range")
    inside = list(rows[row][column].walk("p"))
    if len(inside) != 1:
        raise ValueError("unsupported_table_structure")
    return inside[0]


# -- shapes and styles -------------------------------------------------------------------------------------------------


def named(root: Element, number: str) -> Element:
    found = [e for e in root.walk("cNvPr", "docPr") if e.attributes.get("id", ("",))[0] == number]
    if len(found) != 1:
        raise ValueError("target_missing")
    return found[0]


def alt_tokens(root: Element, number: str, new: str) -> list[Token]:
    return attribute(named(root, number), "descr", new)


def _place(root: Element, mark: Element) -> tuple[Element | None, str | None]:
    """The element that holds a shape's box, or why it can't be moved."""
    shape = next((e for e in root.walk("sp", "pic", "graphicFrame", "cxnSp", "grpSp") if any(x is mark for k in e.children for x in k.children)), None)
    if shape is None or shape.local == "grpSp":
        return None, "pptx.geometry.group_unsupported"
    place = next(iter(shape.of("xfrm")), None) or next((x for k in shape.of("spPr") for x in k.of("xfrm")), None)
    return place, None if place is not None and place.of("off") and place.of("ext") else "missing_geometry"


def geometry_tokens(root: Element, number: str, box: dict) -> list[Token]:
    """x, y, width and height of a shape, in whole units of the file."""
    if set(box) != {"x", "y", "width", "height"} or any(isinstance(v, bool) or not isinstance(v, int) for v in box.values()):
        raise ValueError("invalid_geometry")
    if box["width"] <= 0 or box["height"] <= 0:
        raise ValueError("invalid_size")
    place, reason = _place(root, named(root, number))
    if reason:
        raise ValueError(reason)
    off, size = place.of("off")[0], place.of("ext")[0]
    now = [int(off.attributes["x"][0]), int(off.attributes["y"][0]), int(size.attributes["cx"][0]), int(size.attributes["cy"][0])]
    if now == [box["x"], box["y"], box["width"], box["height"]]:
        raise ValueError("no_op_geometry_update")
    return [*attribute(off, "x", str(box["x"])), *attribute(off, "y", str(box["y"])), *attribute(size, "cx", str(box["width"])), *attribute(size, "cy", str(box["height"]))]


def style_tokens(text: str, p: Element, run: int, style: dict, family: str) -> list[Token]:
    """bold, italic, underline (none, single or double) and size (points) of one run; other style fields are refused."""
    if not style or set(style) - {"bold", "italic", "underline", "size"}:
        raise ValueError("unsupported_style_field")
    runs = p.of("r")
    if not 0 <= run < len(runs):
        raise ValueError("run_out_of_range")
    r = runs[run]
    have = next(iter(r.of("rPr")), None)
    if family == "pptx":
        lines = {"none": "none", "single": "sng", "double": "dbl"}
        want = {"bold": ("b", lambda v: str(int(v))), "italic": ("i", lambda v: str(int(v))), "underline": ("u", lambda v: lines[v]), "size": ("sz", lambda v: str(round(v * 100)))}
        pairs = [(want[k][0], want[k][1](v)) for k, v in style.items()]
        if have is None:
            return [(r.inner, r.inner, f"<{r.prefix}rPr" + "".join(f' {k}="{v}"' for k, v in pairs) + "/>")]
        return _merged([t for k, v in pairs for t in attribute(have, k, v)])
    w = r.prefix
    tags = {"bold": ("b", lambda v: "1" if v else "0"), "italic": ("i", lambda v: "1" if v else "0"), "underline": ("u", str), "size": ("sz", lambda v: str(round(v * 2)))}
    order = [tags[k][0] for k in ("bold", "italic", "size", "underline")]
    new = {tags[k][0]: f'<{w}{tags[k][0]} {w}val="{tags[k][1](v)}"/>' for k, v in style.items()}
    if have is None or have.inner == have.end:
        made = f"<{w}rPr>" + "".join(new[k] for k in order if k in new) + f"</{w}rPr>"
        return [(r.inner, r.inner, made)] if have is None else [(have.start, have.end, made)]
    out: list[Token] = []
    for k in order:
        if k in new:
            old = next(iter(have.of(k)), None)
            out.append((old.start, old.end, new[k]) if old else (_slot(have, k), _slot(have, k), new[k]))
    return _merged(out)


#: Order of run properties in a text document, as far as it is edited or stands around it (fixed values).
RUN_ORDER = ("rStyle", "rFonts", "b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "noProof", "snapToGrid", "vanish", "webHidden", "color", "spacing", "w", "kern", "position", "sz", "szCs", "highlight", "u")


def _slot(properties: Element, name: str) -> int:
    """Where a new property goes: before the first that must follow it."""
    before = RUN_ORDER[: RUN_ORDER.index(name)]
    return next((c.start for c in properties.children if c.local not in before), properties.close)


def _merged(tokens: Iterable[Token]) -> list[Token]:
    """Insertions at one place as one, in the given order."""
    out: dict[tuple[int, int], str] = {}
    for a, b, t in tokens:
        out[a, b] = out.get((a, b), "") + t
    return [(a, b, t) for (a, b), t in out.items()]


# -- owners ------------------------------------------------------------------------------------------------------------


def paragraph_owners(text: str, part: str, family: str) -> list[dict]:
    """Paragraphs of a part as owners, in order; owner is the part and the paragraph's number."""
    return [{"owner": f"{part}#{i}", "value": paragraph_text(p), "operation": "replace_text", "reason": paragraph_reason(p, family)} for i, p in enumerate(xml_tree(text).walk("p"))]


def shape_owners(text: str, part: str, family: str) -> list[dict]:
    """Alternative texts and, on slides, boxes; owner is the part and the shape's number."""
    root, out = xml_tree(text), []
    marks = [e for e in root.walk("cNvPr", "docPr") if "id" in e.attributes]
    for e in marks:
        number = e.attributes["id"][0]
        twice = sum(m.attributes["id"][0] == number for m in marks) > 1
        out.append({"owner": f"{part}#shape-{number}", "value": e.attributes.get("descr", ("",))[0], "operation": "set_alt_text", "reason": f"{family}.shape.duplicate_id" if twice else None})
        if family == "pptx":
            out.append({"owner": f"{part}#box-{number}", "value": None, "operation": "move_resize", "reason": f"{family}.shape.duplicate_id" if twice else _place(root, e)[1]})
    return out


def table_owners(text: str, part: str) -> list[dict]:
    """Tables whose cells can be edited one by one, and why others can't."""
    out = []
    for i, t in enumerate(xml_tree(text).walk("tbl")):
        reason = None
        try:
            for r, row in enumerate(t.of("tr")):
                for c in range(len(row.of("tc"))):
                    table_cell(t, r, c)
        except ValueError as e:
            reason = str(e)
        out.append({"owner": f"{part}#table-{i}", "value": None, "operation": "update_table_cells", "reason": reason})
    return out
