"""Text, words and metadata of PDF files whose streams are plain or deflated and whose fonts are simple."""

from __future__ import annotations

import re
import zlib

#: Limits (fixed values).
SOURCE_BYTES, PAGES = 512 << 20, 20_000
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_TEXT = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>(?!>)|\[|\]|-?\d*\.?\d+|/[^\s/<>\[\]()]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def objects(data: bytes) -> dict[int, bytes]:
    """Bodies by object number, those of later revisions first; object streams are opened."""
    if not data.lstrip().startswith(b"%PDF") or len(data) > SOURCE_BYTES:
        raise ValueError("pdf.signature")
    out = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body[:300]:
            raw, n, first = stream(body), int(re.search(rb"/N\s+(\d+)", body)[1]), int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = [int(x) for x in raw[:first].split()[: 2 * n]]
            for k in range(n):
                end = first + heads[2 * k + 3] if k + 1 < n else len(raw)
                out.setdefault(heads[2 * k], raw[first + heads[2 * k + 1] : end])
    return out


def stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    if b"/FlateDecode" in body[: m.start()]:
        return zlib.decompressobj().decompress(m[1], 64 << 20)
    return m[1] if b"/Filter" not in body[: m.start()] else b""


def _literal(raw: bytes) -> str:
    if raw[:1] == b"<":
        text = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", raw[1:-1])) % 2))
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in b"\r\n" else _ESCAPES.get(m[1], m[1])
        text = re.sub(rb"\\([0-7]{1,3}|.)", octal, raw[1:-1], flags=re.S)
    if text[:2] == b"\xfe\xff":
        return text[2:].decode("utf-16-be", "replace")
    return text.decode("cp1252", "replace")


def info(data: bytes) -> dict[str, str]:
    """Text fields of the document information."""
    ref = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    body = objects(data).get(int(ref[-1]), b"") if ref else b""
    return {m[1].decode("latin-1"): _literal(m[2]) for m in re.finditer(rb"/([A-Za-z]+)\s*(\((?:\\.|[^\\()]|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>)", body)}


def _dictionary(body: bytes) -> bytes:
    return body.split(b"stream", 1)[0]


#: Width of a page that names none, and of a character whose font names none, in thousandths (fixed values).
PAGE_WIDTH, CHARACTER = 612.0, 500.0


def _refs(name: bytes, body: bytes) -> list[int]:
    m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", _dictionary(body))
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _fonts(objs: dict[int, bytes], line: list[bytes]) -> dict[bytes, list[float]]:
    """Widths of the 256 character codes by font name, of the nearest of a page and its ancestors that has fonts."""
    for body in line:
        head = _dictionary(body)
        if (r := _refs(b"Resources", body)) and b"/Font" not in head:
            head = objs.get(r[0], b"")
        m = re.search(rb"/Font\s*(<<.*?>>|(\d+)\s+\d+\s+R)", head, re.S)
        if not m:
            continue
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", objs.get(int(m[2]), b"") if m[2] else m[1]):
            font = _dictionary(objs.get(int(n), b""))
            w = re.search(rb"/Widths\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", font)
            first = re.search(rb"/FirstChar\s+(\d+)", font)
            table = [CHARACTER] * 256
            if w:
                raw = w[1] if w[1] is not None else objs.get(int(w[2]), b"").strip(b"[] \r\n\t")
                for k, x in enumerate(re.findall(rb"-?\d*\.?\d+", raw)):
                    if (at := (int(first[1]) if first else 0) + k) < 256:
                        table[at] = float(x)
            out[name] = table
        return out
    return {}


def page_rows(data: bytes) -> list[dict]:
    """Pages in the order of the page tree: page (from 1), width, pieces and words (text, x0, x1, top)."""
    objs = objects(data)
    root = next((b for b in objs.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    stack: list[tuple[int, tuple[bytes, ...]]] = [(n, ()) for n in _refs(b"Pages", root)[::-1]]
    out, seen = [], set()
    while stack and len(out) < PAGES:
        n, above = stack.pop()
        if n in seen or n not in objs:
            continue
        seen.add(n)
        line = (objs[n], *above)
        kids = _refs(b"Kids", objs[n])
        if kids:
            stack += [(k, line) for k in kids[::-1]]
            continue
        content = b"\n".join(stream(objs[c]) for c in _refs(b"Contents", objs[n]) if c in objs)
        box = next((m for b in line if (m := re.search(rb"/MediaBox\s*\[\s*(-?[\d.]+)\s+-?[\d.]+\s+(-?[\d.]+)", _dictionary(b)))), None)
        pieces, words = _pieces(content, _fonts(objs, list(line)))
        out.append({"page": len(out) + 1, "width": float(box[2]) - float(box[1]) if box else PAGE_WIDTH, "pieces": pieces, "words": words})
    return out


def pages(data: bytes) -> list[list[dict]]:
    """Text pieces (text, x0, top) of each page in reading order of the page tree."""
    return [r["pieces"] for r in page_rows(data)]


def _pieces(content: bytes, fonts: dict[bytes, list[float]]) -> tuple[list[dict], list[dict]]:
    """What each operator shows, and the words in it with where they begin and end."""
    out, words, args, x, y, lead, inside = [], [], [], 0.0, 0.0, 12.0, False
    line_x = line_y = 0.0
    size, scale, widths = 12.0, 1.0, [CHARACTER] * 256
    for m in _TEXT.finditer(content):
        t = m[0]
        if not t[:1].isalpha() and t[:1] not in b"'\"*":
            args.append(t)
            continue
        op, nums = t.decode("latin-1"), [float(a) for a in args if re.fullmatch(rb"-?\d*\.?\d+", a)]
        texts = [a for a in args if a[:1] in b"(<"]
        if op == "BT":
            x = y = line_x = line_y = 0.0
            scale, inside = 1.0, True
        elif op == "ET":
            inside = False
        elif op == "Tf" and nums:
            size = nums[-1]
            widths = next((fonts[a[1:]] for a in args if a[:1] == b"/" and a[1:] in fonts), [CHARACTER] * 256)
        elif op in ("Td", "TD") and len(nums) >= 2:
            line_x, line_y = line_x + nums[-2] * scale, line_y + nums[-1] * scale
            x, y = line_x, line_y
            lead = -nums[-1] if op == "TD" else lead
        elif op == "TL" and nums:
            lead = nums[-1]
        elif op == "Tm" and len(nums) >= 6:
            x, y = line_x, line_y = nums[-2], nums[-1]
            scale = abs(nums[-6]) or 1.0
        elif op in ("T*", "'", '"'):
            line_y -= lead * scale
            x, y = line_x, line_y
        if op in ("Tj", "TJ", "'", '"') and inside and texts:
            gaps = "".join(_literal(a) if a[:1] in b"(<" else " " if re.fullmatch(rb"-\d+\.?\d*", a) and float(a) < -200 else "" for a in args)
            out.append({"text": gaps, "x0": x, "top": -y})
            word, begun, shown = "", x, args if op == "TJ" else texts[-1:]
            for a in shown:
                if a[:1] not in b"(<":
                    step = -float(a) / 1000 * size * scale if re.fullmatch(rb"-?\d*\.?\d+", a) else 0.0
                    if word and step > 0.2 * size * scale:
                        words.append({"text": word, "x0": begun, "x1": x, "top": -y})
                        word = ""
                    x += step
                    continue
                for c in _literal(a):
                    if c.isspace():
                        if word:
                            words.append({"text": word, "x0": begun, "x1": x, "top": -y})
                            word = ""
                    else:
                        begun = begun if word else x
                        word += c
                    code = ord(c) if ord(c) < 256 else (c.encode("cp1252", "replace") or b"?")[0]
                    x += widths[code] / 1000 * size * scale
            if word:
                words.append({"text": word, "x0": begun, "x1": x, "top": -y})
        args = []
    return out, words


def page_text(pieces: list[dict]) -> str:
    """A page's lines: pieces of one height go together, left to right."""
    lines: dict[float, list[dict]] = {}
    for p in pieces:
        lines.setdefault(round(p["top"]), []).append(p)
    return "\n".join(" ".join(p["text"] for p in sorted(row, key=lambda p: p["x0"])) for _, row in sorted(lines.items()))


def text(data: bytes) -> str:
    """Lines of all pages."""
    return "\n\n".join(page_text(r["pieces"]) for r in page_rows(data))


def page_table(data: bytes) -> list[dict]:
    """page, width, text and words of each page, for layout by the operators on word boxes."""
    return [{"page": r["page"], "width": r["width"], "text": page_text(r["pieces"]), "words": r["words"]} for r in page_rows(data)]


def merge_partial_numbers(body: str) -> str:
    """A line that is only ``.12`` joins the next line that is not blank."""
    return re.sub(r"(?m)^[ \t]*(\.\d+)[ \t]*\n(?:[ \t]*\n)*[ \t]*(?=\S)([^\n]*)", r"\1 \2", body)


def pdf(data: bytes, **_) -> tuple[str, str | None]:
    return merge_partial_numbers(text(data)).strip(), info(data).get("Title")


#: What forbids an appended revision, by the mark that shows it (fixed values).
REFUSED = {b"/Encrypt": "pdf.encrypted", b"/ByteRange": "pdf.signed", b"/XRef": "pdf.xref_stream"}
_STRING = rb"(\((?:\\.|[^\\()]|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>(?!>))"


def _encoded(value: str) -> bytes:
    if all(ord(c) < 128 for c in value):
        return b"(" + "".join("\\" + c if c in "\\()" else c for c in value).replace("\r", "\\r").encode("latin-1") + b")"
    return b"<" + (b"\xfe\xff" + value.encode("utf-16-be")).hex().encode() + b">"


def _revised(data: bytes, bodies: dict[int, bytes]) -> bytes:
    """The file with objects replaced by an appended revision: the source is an exact prefix."""
    for mark, reason in REFUSED.items():
        if mark in data:
            raise ValueError(reason)
    starts, root, size = re.findall(rb"startxref\s+(\d+)", data), re.findall(rb"/Root\s+\d+\s+\d+\s+R", data), re.findall(rb"/Size\s+(\d+)", data)
    if not starts or not root or not size:
        raise ValueError("pdf.trailer_missing")
    out, table = data + (b"" if data.endswith(b"\n") else b"\n"), b"xref\n"
    for n, body in sorted(bodies.items()):
        g = int((re.findall(rb"(?<![0-9])%d\s+(\d+)\s+obj\b" % n, data) or [b"0"])[-1])
        table += f"{n} 1\n{len(out):010d} {g:05d} n \n".encode()
        out += f"{n} {g} obj".encode() + body + b"endobj\n"
    refs = re.findall(rb"/Info\s+\d+\s+\d+\s+R", data)
    tail = b" ".join([root[-1], *refs[-1:], b"/Prev " + starts[-1]])
    return out + table + b"trailer\n<< /Size " + size[-1] + b" " + tail + b" >>\nstartxref\n%d\n%%%%EOF\n" % len(out)


def update_info(data: bytes, field: str, value: str) -> bytes:
    """One information field replaced."""
    refs = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    if not refs or field not in info(data):
        raise ValueError("pdf.info_missing")
    n = int(refs[-1])
    return _revised(data, {n: re.sub(rb"(/" + field.encode() + rb"\s*)" + _STRING, lambda m: m[1] + _encoded(value), objects(data)[n], count=1)})


def links(data: bytes) -> list[dict]:
    """Addresses that link annotations open: owner is the object's number."""
    out = []
    for n, body in sorted(objects(data).items()):
        found = re.findall(rb"/URI\s*" + _STRING, _dictionary(body))
        if found:
            out.append({"owner": str(n), "value": _literal(found[0]), "reason": "pdf.link.ambiguous" if len(found) > 1 else None})
    return out


def update_link(data: bytes, owner: str, value: str) -> bytes:
    """One link's address replaced by another http, https or mailto address."""
    have = next(o for o in links(data) if o["owner"] == owner)
    if have["reason"]:
        raise ValueError(have["reason"])
    if not re.fullmatch(r"(?:https?://[^\s/]+\S*|mailto:\S+)", value) or not value.isascii():
        raise ValueError("pdf.link.invalid_uri")
    if value == have["value"]:
        raise ValueError("no_op_update")
    return _revised(data, {int(owner): re.sub(rb"(/URI\s*)" + _STRING, lambda m: m[1] + _encoded(value), objects(data)[int(owner)], count=1)})


def text_fields(data: bytes) -> list[dict]:
    """Text fields of forms: owner is the full name, value their text; what can't be filled has its reason."""
    objs, out = objects(data), []
    parent = {n: int(m[1]) for n, b in objs.items() if (m := re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", _dictionary(b))) and not re.search(rb"/Type\s*/Pages?\b", b)}

    def up(n: int) -> list[int]:
        line: list[int] = []
        while n in objs and n not in line:
            line.append(n)
            n = parent.get(n, -1)
        return line

    for n, body in sorted(objs.items()):
        head = _dictionary(body)
        if not re.search(rb"/T\s*[(<]", head):
            continue
        line = [_dictionary(objs[k]) for k in up(n)]
        if not any(re.search(rb"/FT\s*/Tx\b", b) for b in line):
            continue
        name = ".".join(_literal(m[1]) for b in reversed(line) if (m := re.search(rb"/T\s*" + _STRING, b)))
        value = re.search(rb"/V\s*" + _STRING, head)
        flags = next((int(m[1]) for b in line if (m := re.search(rb"/Ff\s+(\d+)", b))), 0)
        limit = re.search(rb"/MaxLen\s+(\d+)", head)
        reason = "pdf.field.read_only" if flags & 1 else "pdf.field.password" if flags & 1 << 13 else "pdf.field.rich_text" if flags & 1 << 25 else "pdf.field.value_missing" if value is None else None
        out.append({"owner": name, "value": _literal(value[1]) if value else None, "reason": reason, "object": n, "limit": int(limit[1]) if limit else None, "multiline": bool(flags & 1 << 12)})
    names = [o["owner"] for o in out]
    for o in out:
        o["reason"] = o["reason"] or ("pdf.field.duplicate_name" if names.count(o["owner"]) > 1 else None)
    return out


def update_field(data: bytes, owner: str, value: str) -> bytes:
    """One text field filled; the form asks viewers to draw its fields anew."""
    have = next(o for o in text_fields(data) if o["owner"] == owner)
    if have["reason"]:
        raise ValueError(have["reason"])
    if value == have["value"]:
        raise ValueError("no_op_update")
    if (have["limit"] is not None and len(value) > have["limit"]) or ("\n" in value and not have["multiline"]):
        raise ValueError("pdf.field.value_not_allowed")
    objs = objects(data)
    new = {have["object"]: re.sub(rb"(/V\s*)" + _STRING, lambda m: m[1] + _encoded(value), objs[have["object"]], count=1)}
    form = next((n for n, b in objs.items() if b"/Fields" in _dictionary(b)), None)
    if form is not None and not re.search(rb"/NeedAppearances\s+true", objs[form]):
        base = re.sub(rb"/NeedAppearances\s+false", b"", new.get(form, objs[form]))
        at = base.index(b"/Fields")
        new[form] = base[:at] + b"/NeedAppearances true " + base[at:]
    return _revised(data, new)


def update(data: bytes, edits: list[dict]) -> bytes:
    """Edits of information fields, links (``kind`` link) and form fields (``kind`` field); each is proven by reading again."""
    writers = {"info": (update_info, lambda d: info(d)), "link": (update_link, lambda d: {o["owner"]: o["value"] for o in links(d)}), "field": (update_field, lambda d: {o["owner"]: o["value"] for o in text_fields(d)})}
    made, before = data, {k: read(data) for k, (_, read) in writers.items()}
    for e in edits:
        kind = e.get("kind", "info")
        if e["target"] not in before[kind]:
            raise ValueError("target_missing" if kind != "info" else "pdf.info_missing")
        if e.get("old") is not None and before[kind][e["target"]] != e["old"]:
            raise ValueError("old_value_mismatch")
        made = writers[kind][0](made, e["target"], e["new"])
        before[kind] = before[kind] | {e["target"]: e["new"]}
    if not made.startswith(data) or any(read(made) != before[k] for k, (_, read) in writers.items()):
        raise ValueError("verification_failed")
    return made
