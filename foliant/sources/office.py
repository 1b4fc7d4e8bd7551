"""Zip containers and the office formats in them: DOCX with equations, XLSX, PPTX, EPUB."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET
from html import escape
from urllib.parse import unquote

from . import lexical, patches
from .html import normalized, to_markdown

#: Container limits (fixed values).
MEMBERS, MEMBER_BYTES, TOTAL_BYTES, RATIO = 10_000, 64 << 20, 512 << 20, 200
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"


def xml(data: bytes) -> ET.Element:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document type declarations are refused")
    return ET.fromstring(data)


def members(data: bytes) -> dict[str, bytes]:
    """Members by name, in order, within the limits."""
    out: dict[str, bytes] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MEMBERS:
            raise ValueError("zip.too_many_members")
        for i in infos:
            total += i.file_size
            if i.file_size > MEMBER_BYTES or total > TOTAL_BYTES or i.file_size > RATIO * max(1, i.compress_size) + 4096:
                raise ValueError("zip.limit_exceeded")
            if i.filename in out:
                raise ValueError("zip.duplicate_member")
            if i.flag_bits & 1:
                raise ValueError("zip.encrypted_member")
            out[i.filename] = z.read(i)
    return out


def member_rows(data: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [{"name": i.filename, "size": i.file_size, "packed": i.compress_size, "crc": i.CRC, "sha256": hashlib.sha256(z.read(i)).hexdigest()} for i in z.infolist() if not i.is_dir()]


def rewrite(data: bytes, changed: dict[str, bytes]) -> bytes:
    """The same archive with some members replaced: order, times, methods and comments stay."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as new:
        new.comment = z.comment
        for i in z.infolist():
            new.writestr(i, changed.get(i.filename, z.read(i)), compress_type=i.compress_type)
    return out.getvalue()


def resolve(base: str, target: str) -> str:
    """Name of a relationship's target relative to the part that has it."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(base), target))


def relationships(parts: dict[str, bytes], part: str) -> dict[str, tuple[str, str]]:
    """id -> (type, target part)."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in parts:
        return {}
    return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], r.get("Target") if r.get("TargetMode") == "External" else resolve(part, r.get("Target", ""))) for r in xml(parts[name])}


def duplicate_relationship_ids(parts: dict[str, bytes]) -> list[tuple[str, str]]:
    out = []
    for name, data in parts.items():
        if name.endswith(".rels"):
            seen: set[str] = set()
            for r in xml(data):
                if r.get("Id") in seen:
                    out.append((name, r.get("Id")))
                seen.add(r.get("Id"))
    return out


# -- equations ---------------------------------------------------------------------------------------------------------

#: Accents, big operators and functions by their character or name (fixed values).
ACCENTS = {"̀": "grave", "́": "acute", "̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overline", "̆": "breve", "̇": "dot", "̈": "ddot", "̌": "check", "⃗": "vec"}
OPERATORS = {"∑": "\\sum", "∏": "\\prod", "∐": "\\coprod", "∫": "\\int", "∬": "\\iint", "∭": "\\iiint", "∮": "\\oint", "⋂": "\\bigcap", "⋃": "\\bigcup"}
FUNCTIONS = frozenset("sin cos tan cot sec csc sinh cosh tanh arcsin arccos arctan exp log ln lg lim max min sup inf det dim gcd".split())
SYMBOLS = {"α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\epsilon", "θ": "\\theta", "λ": "\\lambda", "μ": "\\mu", "π": "\\pi", "ρ": "\\rho", "σ": "\\sigma", "τ": "\\tau", "φ": "\\phi", "ω": "\\omega", "Γ": "\\Gamma", "Δ": "\\Delta", "Σ": "\\Sigma", "Ω": "\\Omega", "∞": "\\infty", "±": "\\pm", "×": "\\times", "÷": "\\div", "·": "\\cdot", "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "→": "\\rightarrow", "∂": "\\partial", "∇": "\\nabla", "∈": "\\in"}


def latex_escape(text: str) -> str:
    """Special characters escaped unless a backslash stands before them."""
    return re.sub(r"(?<!\\)([#$%&_{}])", r"\\\1", text)


class Equation:
    """One rule an element; what has none passes its children on."""

    def latex(self, e: ET.Element) -> str:
        rule = getattr(self, "on_" + e.tag.rsplit("}", 1)[-1], None)
        return rule(e) if rule else self.all(e)

    def all(self, e: ET.Element | None) -> str:
        return "" if e is None else "".join(self.latex(c) for c in e if not c.tag.endswith("Pr"))

    def part(self, e: ET.Element, name: str) -> str:
        return self.all(e.find(M + name))

    def value(self, e: ET.Element, holder: str, name: str, default: str | None = None) -> str | None:
        found = e.find(f"{M}{holder}/{M}{name}")
        return default if found is None else found.get(M + "val", "")

    def on_r(self, e: ET.Element) -> str:
        text = "".join(t.text or "" for t in e.iter(M + "t"))
        return "".join(SYMBOLS[c] + " " if c in SYMBOLS else c for c in latex_escape(text))

    def on_acc(self, e: ET.Element) -> str:
        return f"\\{ACCENTS.get(self.value(e, 'accPr', 'chr', chr(0x302)), 'hat')}{{{self.part(e, 'e')}}}"

    def on_bar(self, e: ET.Element) -> str:
        return f"\\{'overline' if self.value(e, 'barPr', 'pos', 'bot') == 'top' else 'underline'}{{{self.part(e, 'e')}}}"

    def on_d(self, e: ET.Element) -> str:
        left, right = self.value(e, "dPr", "begChr", "("), self.value(e, "dPr", "endChr", ")")
        middle = self.value(e, "dPr", "sepChr", "|")
        return f"\\left{latex_escape(left) or '.'}{middle.join(self.all(x) for x in e.findall(M + 'e'))}\\right{latex_escape(right) or '.'}"

    def on_sSub(self, e: ET.Element) -> str:
        return f"{self.part(e, 'e')}_{{{self.part(e, 'sub')}}}"

    def on_sSup(self, e: ET.Element) -> str:
        return f"{self.part(e, 'e')}^{{{self.part(e, 'sup')}}}"

    def on_sSubSup(self, e: ET.Element) -> str:
        return f"{self.part(e, 'e')}_{{{self.part(e, 'sub')}}}^{{{self.part(e, 'sup')}}}"

    def on_f(self, e: ET.Element) -> str:
        kind, n, d = self.value(e, "fPr", "type", "bar"), self.part(e, "num"), self.part(e, "den")
        return {"skw": f"^{{{n}}}/_{{{d}}}", "noBar": f"\\genfrac{{}}{{}}{{0pt}}{{}}{{{n}}}{{{d}}}", "lin": f"{{{n}}}/{{{d}}}"}.get(kind, f"\\frac{{{n}}}{{{d}}}")

    def on_func(self, e: ET.Element) -> str:
        name = self.part(e, "fName").strip()
        return f"{'\\' + name if name in FUNCTIONS else name}({self.part(e, 'e')})"

    def on_groupChr(self, e: ET.Element) -> str:
        return f"\\{'overbrace' if self.value(e, 'groupChrPr', 'pos', 'bot') == 'top' else 'underbrace'}{{{self.part(e, 'e')}}}"

    def on_rad(self, e: ET.Element) -> str:
        degree = self.part(e, "deg")
        return f"\\sqrt[{degree}]{{{self.part(e, 'e')}}}" if degree else f"\\sqrt{{{self.part(e, 'e')}}}"

    def on_eqArr(self, e: ET.Element) -> str:
        return "\\begin{array}{c}" + "\\\\".join(self.all(x) for x in e.findall(M + "e")) + "\\end{array}"

    def on_limLow(self, e: ET.Element) -> str:
        name = self.part(e, "e").strip()
        return f"{'\\' + name if name in FUNCTIONS else name}_{{{self.part(e, 'lim')}}}"

    def on_limUpp(self, e: ET.Element) -> str:
        return f"\\overset{{{self.part(e, 'lim')}}}{{{self.part(e, 'e')}}}"

    def on_m(self, e: ET.Element) -> str:
        return "\\begin{matrix}" + "\\\\".join("&".join(self.all(x) for x in row.findall(M + "e")) for row in e.findall(M + "mr")) + "\\end{matrix}"

    def on_nary(self, e: ET.Element) -> str:
        op = OPERATORS.get(self.value(e, "naryPr", "chr", "∫"), "\\int")
        sub, sup = self.part(e, "sub"), self.part(e, "sup")
        return op + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + self.part(e, "e")


def omml_to_latex(data: str | bytes | ET.Element) -> str:
    root = data if isinstance(data, ET.Element) else xml(data.encode() if isinstance(data, str) else data)
    found = [root] if root.tag == M + "oMath" else list(root.iter(M + "oMath"))
    return " ".join(Equation().all(e) for e in found)


# -- DOCX --------------------------------------------------------------------------------------------------------------


def _run(r: ET.Element) -> str:
    out = []
    for c in r:
        if c.tag == W + "t":
            out.append(escape(c.text or "", quote=False))
        elif c.tag == W + "tab":
            out.append("\t")
        elif c.tag in (W + "br", W + "cr"):
            out.append("<br>")
    text, pr = "".join(out), r.find(W + "rPr")
    on = lambda n: pr is not None and (x := pr.find(W + n)) is not None and x.get(W + "val", "1") not in ("0", "false", "none")
    if text:
        for name, tag in (("b", "strong"), ("i", "em"), ("u", "u"), ("strike", "s"), ("dstrike", "s")):
            if on(name):
                text = f"<{tag}>{text}</{tag}>"
    return text


def _inline(p: ET.Element, rels: dict) -> str:
    out = []
    for c in p:
        if c.tag == W + "r":
            out.append(_run(c))
            out += [f'<img src="{rels.get(b.get(R + "embed"), ("", ""))[1]}" alt="{escape((d.get("descr") or "") if (d := next(iter(c.iter("{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}docPr")), None)) is not None else "")}">' for b in c.iter(A + "blip")]
        elif c.tag == W + "hyperlink":
            href = rels.get(c.get(R + "id"), ("", ""))[1]
            out.append(f'<a href="{escape(href)}">{_inline(c, rels)}</a>' if href else _inline(c, rels))
        elif c.tag == M + "oMath":
            out.append(f"<code>{escape('$' + omml_to_latex(c) + '$')}</code>")
        elif c.tag == M + "oMathPara":
            out.append(f"<code>{escape('$$' + omml_to_latex(c) + '$$')}</code>")
        elif c.tag in (W + "ins", W + "smartTag", W + "sdt", W + "sdtContent"):
            out.append(_inline(c, rels))
    return "".join(out)


def docx_html(data: bytes) -> str:
    parts = members(data)
    main = next((t for k, t in relationships(parts, "").values() if k == "officeDocument"), "word/document.xml")
    root, rels = xml(parts[main]), relationships(parts, main)
    names = {}
    if "word/styles.xml" in parts:
        for s in xml(parts["word/styles.xml"]).iter(W + "style"):
            n = s.find(W + "name")
            names[s.get(W + "styleId")] = (n.get(W + "val", "") if n is not None else "").lower()

    def block(e: ET.Element) -> str:
        if e.tag == W + "tbl":
            rows = []
            for tr in e.findall(W + "tr"):
                cells = ["".join(block(x) for x in tc).replace("</p><p>", " ") for tc in tr.findall(W + "tc")]
                rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
            return "<table>" + "".join(rows) + "</table>"
        if e.tag == W + "sdt":
            return "".join(block(x) for x in e.find(W + "sdtContent") or [])
        if e.tag != W + "p":
            return ""
        text, style, num = _inline(e, rels), e.find(f"{W}pPr/{W}pStyle"), e.find(f"{W}pPr/{W}numPr/{W}ilvl")
        name = names.get(style.get(W + "val"), style.get(W + "val", "").lower()) if style is not None else ""
        if not text:
            return ""
        if m := re.fullmatch(r"heading ?([1-6])", name):
            return f"<h{m[1]}>{text}</h{m[1]}>"
        if name == "title":
            return f"<h1>{text}</h1>"
        if num is not None:
            depth = int(num.get(W + "val", "0"))
            return "<ul>" * (depth + 1) + f"<li>{text}</li>" + "</ul>" * (depth + 1)
        return f"<p>{text}</p>"

    body = root.find(W + "body")
    html = "".join(block(e) for e in (body if body is not None else []))
    return re.sub(r"</ul><ul>", "", html)


def docx(data: bytes, **options) -> tuple[str, str | None]:
    text = to_markdown(docx_html(data), **options)
    return re.sub(r"`(\${1,2}[^`]*\${1,2})`", lambda m: ("\n\n" + m[1] + "\n\n") if m[1].startswith("$$") else m[1], text), None


# -- XLSX --------------------------------------------------------------------------------------------------------------


def a1(address: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]{1,3})([1-9]\d{0,6})", address)
    if not m:
        raise ValueError(f"no cell address: {address}")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    row = int(m[2])
    if row > 1_048_576 or column > 16_384:
        raise ValueError(f"out of the sheet: {address}")
    return row - 1, column - 1


def _strings(parts: dict[str, bytes], name: str | None) -> list[tuple[str, bool]]:
    """Shared strings and whether their runs have styles."""
    if not name or name not in parts:
        return []
    return [("".join(t.text or "" for t in si.iter(S + "t")), si.find(S + "r") is not None) for si in xml(parts[name]).findall(S + "si")]


def cell_reason(cell: dict) -> str | None:
    """Why a native cell can't be edited: the first rule that holds."""
    if cell["formula"] is not None:
        return "xlsx.cell.formula_requires_explicit_formula_edit"
    if cell["merged"]:
        return "xlsx.cell.merged_range"
    if cell["rich"]:
        return "xlsx.cell.rich_text_requires_run_preserving_edit"
    return "xlsx.cell.unsupported_type" if cell["type"] in ("error", "date") else None


def xlsx_cells(data: bytes) -> list[dict]:
    """Native cells: sheet_index, sheet, part, address, row, column, type, value (JSON scalar as text), formula, merged, rich (styled runs)."""
    parts = members(data)
    book = next((t for k, t in relationships(parts, "").values() if k == "officeDocument"), "xl/workbook.xml")
    rels = relationships(parts, book)
    shared = _strings(parts, next((t for k, t in rels.values() if k == "sharedStrings"), None))
    out = []
    for index, sheet in enumerate(xml(parts[book]).iter(S + "sheet")):
        part = rels.get(sheet.get(R + "id"), ("", ""))[1]
        if part not in parts:
            continue
        fixed = re.sub(rb"(<(?:\w+:)?sheetView[^>]*?)\bshowZeroes=", rb"\1showZeros=", parts[part])
        root = xml(fixed)
        merged = set()
        for m in root.iter(S + "mergeCell"):
            (r0, c0), (r1, c1) = (a1(x) for x in (m.get("ref") + ":" + m.get("ref")).split(":")[:2]) if ":" in m.get("ref") else (a1(m.get("ref")),) * 2
            merged |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} if (r1 - r0 + 1) * (c1 - c0 + 1) <= 100_000 else set()
        for c in root.iter(S + "c"):
            row, column = a1(c.get("r"))
            kind, v, f = c.get("t", "n"), c.find(S + "v"), c.find(S + "f")
            raw, rich = v.text if v is not None else None, False
            if kind == "s":
                kind, (value, rich) = "string", shared[int(raw)] if raw is not None else (None, False)
            elif kind == "inlineStr":
                kind, value, rich = "string", "".join(t.text or "" for t in c.iter(S + "t")), c.find(f"{S}is/{S}r") is not None
            elif kind == "b":
                kind, value = "bool", "TRUE" if raw == "1" else "FALSE"
            elif kind in ("str", "e", "d"):
                kind, value = {"str": "string", "e": "error", "d": "date"}[kind], raw
            else:
                kind, value = ("null" if raw is None else "float" if re.search("[.eE]", raw) else "int"), raw
            out.append({"sheet_index": index, "sheet": sheet.get("name"), "part": part, "address": c.get("r"), "row": row, "column": column, "type": kind, "value": value, "formula": None if f is None else f.text or "", "merged": (row, column) in merged, "rich": rich})
    return out


def grid_markdown(cells: list[dict]) -> str:
    """A sheet's cells as a pipe table over its whole extent."""
    if not cells:
        return ""
    rows, columns = max(c["row"] for c in cells) + 1, max(c["column"] for c in cells) + 1
    at = {(c["row"], c["column"]): c["value"] for c in cells}
    show = lambda v: "" if v is None else re.sub(r"\r\n|\n|\r", " ", v).replace("|", "\\|")
    lines = ["| " + " | ".join(show(at.get((r, c))) for c in range(columns)) + " |" for r in range(rows)]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * columns) + " |", *lines[1:]])


def sheets_markdown(cells: list[dict]) -> str:
    names = dict.fromkeys((c["sheet_index"], c["sheet"]) for c in cells)
    return "\n\n".join(f"## {name}\n{grid_markdown([c for c in cells if c['sheet_index'] == i])}" for i, name in names).strip()


def xlsx(data: bytes, **_) -> tuple[str, str | None]:
    return sheets_markdown(xlsx_cells(data)), None


# -- PPTX --------------------------------------------------------------------------------------------------------------


def _paragraphs(body: ET.Element | None) -> str:
    if body is None:
        return ""
    return "\n".join("".join("\n" if r.tag == A + "br" else r.findtext(A + "t") or "" for r in p if r.tag in (A + "r", A + "br", A + "fld")) for p in body.iter(A + "p"))


def pptx_shapes(data: bytes) -> list[dict]:
    """Shapes: slide, ordinal, top, left, kind, text, role; charts and tables rendered."""
    parts = members(data)
    deck = next((t for k, t in relationships(parts, "").values() if k == "officeDocument"), "ppt/presentation.xml")
    rels, out = relationships(parts, deck), []
    for number, s in enumerate(xml(parts[deck]).iter(P + "sldId"), 1):
        part = rels[s.get(R + "id")][1]
        own = relationships(parts, part)
        stack = [(x, number) for x in reversed(list(xml(parts[part]).find(f"{P}cSld/{P}spTree")))]
        ordinal = 0
        while stack:
            e, _ = stack.pop()
            if e.tag == P + "grpSp":
                stack += [(x, number) for x in reversed(list(e))]
                continue
            off = next(iter(e.iter(A + "off")), None)
            name = next(iter(e.iter(P + "cNvPr")), None)
            row = {"slide": number, "ordinal": ordinal, "top": int(off.get("y")) if off is not None else None, "left": int(off.get("x")) if off is not None else None, "kind": None, "role": None, "text": ""}
            if e.tag == P + "sp":
                ph = next(iter(e.iter(P + "ph")), None)
                row |= {"kind": "text", "role": "title" if ph is not None and ph.get("type") in ("title", "ctrTitle") else None, "text": _paragraphs(e.find(P + "txBody"))}
            elif e.tag == P + "pic":
                alt = re.sub(r"[\r\n\[\]]", " ", (name.get("descr") or name.get("name") or "") if name is not None else "")
                file = re.sub(r"\W", "", name.get("name") or "" if name is not None else "") + ".jpg"
                row |= {"kind": "image", "text": f"![{re.sub(r'\s+', ' ', alt).strip()}]({file})"}
            elif e.tag == P + "graphicFrame" and (table := next(iter(e.iter(A + "tbl")), None)) is not None:
                rows = [[_paragraphs(tc.find(A + "txBody")) for tc in tr.findall(A + "tc")] for tr in table.findall(A + "tr")]
                cell = lambda tag, v: f"<{tag}>{escape(v)}</{tag}>"
                row |= {"kind": "table", "text": to_markdown("<table>" + "".join("<tr>" + "".join(cell("th" if i == 0 else "td", v) for v in r) + "</tr>" for i, r in enumerate(rows)) + "</table>")}
            elif e.tag == P + "graphicFrame" and (ref := next(iter(e.iter(C + "chart")), None)) is not None:
                row |= {"kind": "chart", "text": chart(xml(parts[own[ref.get(R + "id")][1]]))}
            if row["kind"]:
                out.append(row)
                ordinal += 1
        note = next((t for k, t in own.values() if k == "notesSlide"), None)
        if note in parts:
            text = "\n".join(_paragraphs(sp.find(P + "txBody")) for sp in xml(parts[note]).iter(P + "sp") if (ph := next(iter(sp.iter(P + "ph")), None)) is not None and ph.get("type") == "body")
            out.append({"slide": number, "ordinal": ordinal, "top": None, "left": None, "kind": "notes", "role": None, "text": text})
    return out


def chart(root: ET.Element) -> str:
    """A chart's categories by series; a point that is missing reads None."""
    title = "".join(t.text or "" for t in root.iter(A + "t")) if root.find(f"{C}chart/{C}title") is not None else ""
    points = lambda e: {int(p.get("idx")): p.findtext(C + "v") for p in e.iter(C + "pt")} if e is not None else {}
    series = [(next(iter(points(s.find(C + "tx")).values()), ""), points(s.find(C + "cat")), points(s.find(C + "val"))) for s in root.iter(C + "ser")]
    if not series:
        return "[unsupported chart]"
    lines = ["| Category | " + " | ".join(n for n, _, _ in series) + " |", "| " + " | ".join(["---"] * (len(series) + 1)) + " |"]
    lines += [f"| {c} | " + " | ".join(str(v.get(i)) for _, _, v in series) + " |" for i, c in series[0][1].items()]
    return f"### Chart{': ' + title if title else ''}\n\n" + "\n".join(lines)


def pptx(data: bytes, **_) -> tuple[str, str | None]:
    shapes = pptx_shapes(data)
    slides: dict[int, str] = {}
    low = -(1 << 62)
    for s in sorted((s for s in shapes if s["kind"] != "notes"), key=lambda s: (s["slide"], low if s["top"] is None else s["top"], low if s["left"] is None else s["left"])):
        text = ("# " + s["text"].lstrip() if s["role"] == "title" else s["text"]) + "\n"
        slides[s["slide"]] = slides.get(s["slide"], f"\n\n<!-- Slide number: {s['slide']} -->\n") + (text if s["text"].strip() else "")
    for s in shapes:
        if s["kind"] == "notes" and s["text"].strip():
            slides[s["slide"]] = slides.get(s["slide"], f"\n\n<!-- Slide number: {s['slide']} -->\n") + f"\n\n### Notes:\n{s['text']}"
    return "".join(slides[k] for k in sorted(slides)).strip(), None


# -- EPUB --------------------------------------------------------------------------------------------------------------


def epub(data: bytes, **options) -> tuple[str, str | None]:
    parts = members(data)
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    opf = next(e.get("full-path") for e in xml(parts["META-INF/container.xml"]).iter() if local(e) == "rootfile")
    root = xml(parts[opf])
    texts = lambda n: [t for e in root.iter() if local(e) == n and (t := "".join(e.itertext()).strip())]
    fields = (("Title", "title"), ("Authors", "creator"), ("Language", "language"), ("Publisher", "publisher"), ("Date", "date"), ("Description", "description"), ("Identifier", "identifier"))
    head = [f"**{label}:** {', '.join(texts(n)) if label == 'Authors' else texts(n)[0]}" for label, n in fields if texts(n)]
    manifest = {e.get("id"): e.get("href") for e in root.iter() if local(e) == "item"}

    def member(href: str) -> str:
        tries = [posixpath.normpath(posixpath.join(posixpath.dirname(opf), h)) for h in (unquote(href), href)]
        return next((t for t in tries if t in parts), tries[0])

    out = ["\n".join(head)]
    for e in root.iter():
        if local(e) == "itemref" and e.get("idref") in manifest and (name := member(manifest[e.get("idref")])) in parts:
            out.append(to_markdown(parts[name].decode("utf-8", "replace"), **options))
    return "\n\n".join(out), (texts("title") or [None])[0]


# -- owners of editable values -----------------------------------------------------------------------------------------

#: Archives inside archives that are opened, and the families of members by their ending (fixed values).
DEPTH = 4
FAMILIES = {"epub": "epub", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "ipynb": "ipynb", "csv": "csv", "json": "json", "xml": "xml", "html": "html", "htm": "html", "xhtml": "html", "md": "text", "txt": "text", "zip": "zip"}


def epub_owners(data: bytes) -> list[dict]:
    """Metadata texts of the package and texts of the spine's pages; owner is member and path."""
    parts = members(data)
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    opf = next(e.get("full-path") for e in xml(parts["META-INF/container.xml"]).iter() if local(e) == "rootfile")
    root, base = xml(parts[opf]), posixpath.dirname(opf)
    items = {e.get("id"): e.get("href") or "" for e in root.iter() if local(e) == "item"}
    spine = [posixpath.normpath(posixpath.join(base, unquote(items[e.get("idref")]))) for e in root.iter() if local(e) == "itemref" and e.get("idref") in items]
    pages = [("replace_epub_metadata_text", opf)] + [("replace_epub_xhtml_text", n) for n in dict.fromkeys(spine)]
    out = []
    for operation, name in pages:
        if name not in parts:
            out.append({"owner": name, "value": None, "operation": operation, "reason": "epub.member_missing"})
            continue
        try:
            owners = list(lexical.xml_owners(parts[name].decode("utf-8-sig")))
        except ValueError as e:
            out.append({"owner": name, "value": None, "operation": operation, "reason": f"epub.member_refused: {e}"[:200]})
            continue
        for o in owners:
            wanted = "/metadata[" in o["path"].replace("opf:", "") if operation == "replace_epub_metadata_text" else "/body[" in o["path"]
            if o["kind"] == "text" and o["value"].strip() and wanted:
                out.append({"owner": f"{name}#{o['path']}", "value": o["value"], "operation": operation, "reason": None})
    return out


def zip_owners(data: bytes, above: str = "", depth: int = 1) -> list[dict]:
    """Members at every level, ``inner.zip!/a.csv``; writable are those whose family has a writer."""
    out = []
    for name, part in members(data).items():
        family = FAMILIES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
        reason = "zip.member.unsafe_name" if name.startswith("/") or "\\" in name or ".." in name.split("/") else None if family else "zip.member.unsupported_format"
        if family == "zip":
            if depth >= DEPTH:
                reason = "zip.depth_exceeded"
            else:
                try:
                    out += zip_owners(part, f"{above}{name}!/", depth + 1)
                except (ValueError, zipfile.BadZipFile) as e:
                    reason = f"zip.member_refused: {e}"[:200]
        out.append({"owner": above + name, "value": family, "operation": f"route_{family or 'unknown'}", "reason": reason})
    return out


def document_parts(parts: dict[str, bytes]) -> list[str]:
    """The main part, and what it refers to as headers, footers and notes."""
    main = next((t for k, t in relationships(parts, "").values() if k == "officeDocument"), "word/document.xml")
    return [p for p in [main, *(t for k, t in relationships(parts, main).values() if k in ("header", "footer", "footnotes", "endnotes"))] if p in parts]


def slide_parts(parts: dict[str, bytes]) -> list[str]:
    """Slides in their order, each followed by its notes."""
    deck = next((t for k, t in relationships(parts, "").values() if k == "officeDocument"), "ppt/presentation.xml")
    rels, out = relationships(parts, deck), []
    for s in xml(parts[deck]).iter(P + "sldId"):
        part = rels.get(s.get(R + "id"), ("", ""))[1]
        out += [p for p in [part, *(t for k, t in relationships(parts, part).values() if k == "notesSlide")] if p in parts]
    return out


def _office_owners(data: bytes, family: str, chosen) -> list[dict]:
    parts, out = members(data), []
    for name in chosen(parts):
        text = parts[name].decode("utf-8-sig")
        out += patches.paragraph_owners(text, name, family) + patches.table_owners(text, name) + patches.shape_owners(text, name, family)
    return out


def docx_owners(data: bytes) -> list[dict]:
    return _office_owners(data, "docx", document_parts)


def pptx_owners(data: bytes) -> list[dict]:
    return _office_owners(data, "pptx", slide_parts)


__all__ = ["docx", "epub", "normalized", "omml_to_latex", "pptx", "xlsx"]
