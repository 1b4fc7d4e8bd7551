"""Lexers that keep every span: CSV fields, JSON values, XML owners."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

DELIMITERS = ",;\t|"


def csv_fields(text: str, delimiter: str = ",") -> list[dict]:
    """Fields with row, column, value, start, end, raw and quoted; quotes may hold breaks."""
    out, row, column, at, n = [], 0, 0, 0, len(text)
    while at < n or column:
        start = at
        if at < n and text[at] == '"':
            at += 1
            while True:
                at = text.find('"', at)
                if at < 0:
                    raise ValueError("csv.unclosed_quote")
                if text[at + 1 : at + 2] != '"':
                    break
                at += 2
            at += 1
            value, quoted = text[start + 1 : at - 1].replace('""', '"'), True
            if at < n and text[at] not in (delimiter, "\r", "\n"):
                raise ValueError("csv.text_after_quote")
        else:
            m = re.compile(rf"[^{re.escape(delimiter)}\r\n]*").match(text, at)
            at, value, quoted = m.end(), m[0], False
        blank = not quoted and not column and not value and (at >= n or text[at] in "\r\n")
        if not blank:
            out.append({"row": row, "column": column, "value": value, "start": start, "end": at, "raw": text[start:at], "quoted": quoted})
        if at < n and text[at] == delimiter:
            at, column = at + 1, column + 1
            if at == n:
                out.append({"row": row, "column": column, "value": "", "start": at, "end": at, "raw": "", "quoted": False})
                break
            continue
        if at >= n:
            break
        at += 2 if text[at : at + 2] == "\r\n" else 1
        row, column = row + 1, 0
    return out


def csv_parity(text: str, fields: list[dict], delimiter: str = ",") -> bool:
    """Whether the strict standard reader sees the same rows."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True) if r]
    own: dict[int, list[str]] = {}
    for f in fields:
        own.setdefault(f["row"], []).append(f["value"])
    return rows == list(own.values())


def csv_dialect(text: str) -> tuple[str, bool, str | None]:
    """(delimiter, proven, reason): the one delimiter that gives further columns; none or several are no proof."""
    evidence = {}
    for d in DELIMITERS:
        try:
            fields = csv_fields(text, d)
        except ValueError:
            continue
        evidence[d] = sum(f["column"] > 0 for f in fields)
    some = [d for d, n in evidence.items() if n]
    if len(some) == 1:
        return some[0], True, None
    return ",", False, "csv.dialect.single_column" if not some else "csv.dialect.ambiguous"


def csv_rows(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text.lstrip("﻿"), newline="")))


def csv_markdown(text: str) -> str:
    rows = csv_rows(text)
    solid = [i for i, r in enumerate(rows) if r]
    if not solid:
        return ""
    head, rest = rows[solid[0]], rows[(solid[1] if len(solid) > 1 else len(rows)) : solid[-1] + 1] if len(solid) > 1 else []
    width = max(len(r) for r in [head, *rest])
    cell = lambda v: re.sub(r"\r\n|\n|\r", " ", re.sub(r"(\\*)\|", r"\1\1\\|", v))
    line = lambda r: "| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |"
    return "\n".join([line(head), "| " + " | ".join(["---"] * width) + " |", *map(line, rest)])


_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')


def json_values(text: str) -> list[dict]:
    """Every value with pointer, kind, start, end, raw and parent pointer; strict, duplicate keys refused, no recursion."""
    out: list[dict] = []
    stack: list[dict] = []
    at, key, expect = 0, None, "value"

    def place(kind: str, start: int, end: int) -> None:
        nonlocal key, expect
        parent = stack[-1] if stack else None
        if parent is None:
            pointer = ""
        elif parent["kind"] == "object":
            pointer = parent["pointer"] + "/" + key.replace("~", "~0").replace("/", "~1")
        else:
            pointer = f"{parent['pointer']}/{parent['n']}"
            parent["n"] += 1
        out.append({"pointer": pointer, "kind": kind, "start": start, "end": end, "raw": text[start:end], "parent": parent["pointer"] if parent else None})
        if kind in ("object", "array"):
            stack.append({"kind": kind, "pointer": pointer, "n": 0, "keys": set(), "row": out[-1]})
            expect = "key_or_end" if kind == "object" else "value_or_end"
        else:
            expect = "comma_or_end" if stack else "end"

    while True:
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip(" \t\r\n") or expect != "end":
                raise ValueError(f"json.syntax at {at}")
            return out
        at = m.end()
        if expect == "end":
            raise ValueError(f"json.syntax at {at}")
        punct, string, number, word = m.groups()
        if punct and punct in "{[" and expect.startswith("value"):
            place("object" if punct == "{" else "array", m.start(1), at)
        elif punct and punct in "}]" and stack and (expect in ("comma_or_end", "key_or_end", "value_or_end")) and (punct == "}") == (stack[-1]["kind"] == "object"):
            row = stack.pop()["row"]
            row["end"], row["raw"] = at, text[row["start"] : at]
            expect = "comma_or_end" if stack else "end"
        elif punct == "," and expect == "comma_or_end" and stack:
            expect = "key" if stack[-1]["kind"] == "object" else "value"
        elif punct == ":" and expect == "colon":
            expect = "value"
        elif string and expect in ("key", "key_or_end"):
            key = json.loads(string)
            if key in stack[-1]["keys"]:
                raise ValueError(f"json.duplicate_key {key}")
            stack[-1]["keys"].add(key)
            expect = "colon"
        elif not punct and expect.startswith("value"):
            g = 2 if string else 3 if number else 4
            place("string" if string else "number" if number else "null" if word == "null" else "boolean", m.start(g), at)
        else:
            raise ValueError(f"json.syntax at {at}")


_MARKUP = re.compile(r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<pi>.*?)\?>|</(?P<close>[^\s>]+)\s*>|<(?P<open>[A-Za-z_:][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/?)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def xml_decode(raw: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] == "#":
            return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
        if name not in ENTITIES:
            raise ValueError(f"xml.entity {name}")
        return ENTITIES[name]

    return re.sub(r"&([^;&\s]+);", one, raw)


def xml_owners(text: str) -> Iterator[dict]:
    """Elements, attributes, namespaces, texts, CDATA, comments and instructions with path and span; DTDs are refused."""
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text):
        raise ValueError("xml.dtd_refused")
    stack: list[tuple[str, dict[str, int], dict[str, str]]] = [("", {}, {"xml": "http://www.w3.org/XML/1998/namespace"})]
    at = 0
    row = lambda kind, path, a, b, value, name=None, space=None: {"kind": kind, "path": path, "start": a, "end": b, "raw": text[a:b], "value": value, "name": name, "namespace": space}

    def step(name: str) -> str:
        stack[-1][1][name] = stack[-1][1].get(name, 0) + 1
        return f"{stack[-1][0]}/{name}[{stack[-1][1][name]}]"

    while at < len(text):
        m = _MARKUP.search(text, at)
        end = m.start() if m else len(text)
        if end > at and (len(stack) > 1 or text[at:end].strip()):
            if len(stack) == 1:
                raise ValueError("xml.text_outside")
            yield row("text", step("text()"), at, end, xml_decode(text[at:end]))
        if not m:
            break
        at = m.end()
        if m["comment"] is not None:
            yield row("comment", step("comment()"), m.start(), at, m["comment"])
        elif m["cdata"] is not None:
            yield row("cdata", step("text()"), m.start(), at, m["cdata"])
        elif m["pi"] is not None:
            yield row("processing_instruction", step("processing-instruction()"), m.start(), at, m["pi"])
        elif m["close"] is not None:
            if len(stack) == 1 or stack[-1][0].rsplit("/", 1)[-1].split("[")[0] != m["close"]:
                raise ValueError("xml.mismatched_end")
            stack.pop()
        else:
            path, spaces = step(m["open"]), dict(stack[-1][2])
            attributes = list(_ATTRIBUTE.finditer(m["attrs"]))
            for a in attributes:
                if a[1] == "xmlns" or a[1].startswith("xmlns:"):
                    spaces[a[1][6:]] = xml_decode(a[2] if a[2] is not None else a[3])
            expand = lambda n, default: spaces.get(n.split(":")[0]) if ":" in n else spaces.get("") if default else None
            yield row("element", path, m.start(), at, None, m["open"], expand(m["open"], True))
            seen = set()
            for a in attributes:
                if a[1] in seen:
                    raise ValueError("xml.duplicate_attribute")
                seen.add(a[1])
                g = 2 if a[2] is not None else 3
                start = m.start("attrs") + a.start(g)
                kind = "namespace" if a[1] == "xmlns" or a[1].startswith("xmlns:") else "attribute"
                yield row(kind, f"{path}/@{a[1]}", start, start + len(a[g]), re.sub(r"[\t\n\r]", " ", xml_decode(a[g])), a[1], expand(a[1], False))
            if not m["self"]:
                stack.append((path, {}, spaces))
    if len(stack) != 1:
        raise ValueError("xml.unclosed_element")


def notebook(data: dict) -> tuple[str, str | None]:
    """Markdown cells as they are, code in Python fences, raw text in bare ones; the title from metadata or the first heading."""
    title, out = (data.get("metadata") or {}).get("title"), []
    for cell in data.get("cells") or []:
        source = cell.get("source") or ""
        text = "".join(source) if isinstance(source, list) else source
        kind = cell.get("cell_type")
        if kind == "markdown":
            out.append(text)
            if title is None:
                title = next((x[2:].strip() for x in text.split("\n") if x.startswith("# ")), None)
        elif kind in ("code", "raw"):
            out.append(f"```{'python' if kind == 'code' else ''}\n{text}\n```")
    return "\n\n".join(out), title


def rtf(text: str) -> str:
    """Plain text of an RTF document."""
    out, skip, depth = [], None, 0
    for m in re.finditer(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", text, re.I | re.S):
        word, number, hexed, symbol, brace, char = m.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            if skip is not None and depth < skip:
                skip = None
        elif skip is None and (symbol == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict")):
            skip = depth
        elif skip is None:
            out.append({"par": "\n", "line": "\n", "tab": "\t"}.get(word, "") if word and word != "u" else chr(int(number) % 65536) if word == "u" else bytes.fromhex(hexed).decode("cp1252", "replace") if hexed else symbol if symbol and symbol in "\\{}" else char or "")
    return "".join(out).strip()


class Element:
    """An element of a text with the spans of its start tag, attributes, content and whole."""

    __slots__ = ("name", "local", "start", "attrs", "attributes", "inner", "close", "end", "children", "texts")

    def __init__(self, name: str, start: int) -> None:
        self.name, self.local, self.start = name, name.rsplit(":", 1)[-1], start
        self.attrs, self.attributes, self.inner, self.close, self.end = (start, start), {}, start, start, start
        self.children: list[Element] = []
        self.texts: list[str] = []

    @property
    def prefix(self) -> str:
        return self.name[: -len(self.local)]

    def walk(self, *locals_: str) -> Iterator[Element]:
        """This element and those below in the text's order; with names, only those so called."""
        stack = [self]
        while stack:
            e = stack.pop()
            if not locals_ or e.local in locals_:
                yield e
            stack += reversed(e.children)

    def first(self, *locals_: str) -> Element | None:
        return next((e for e in self.walk(*locals_) if e is not self), None)

    def of(self, *locals_: str) -> list[Element]:
        return [e for e in self.children if e.local in locals_]

    def value(self) -> str:
        return "".join(self.texts)


def xml_tree(text: str) -> Element:
    """The document as a tree of spans under a nameless root; the same texts are refused as by ``xml_owners``."""
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text):
        raise ValueError("xml.dtd_refused")
    root = Element("", 0)
    stack, at = [root], 0
    for m in _MARKUP.finditer(text):
        if m.start() > at:
            stack[-1].texts.append(xml_decode(text[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            stack[-1].texts.append(m["cdata"])
        elif m["close"] is not None:
            e = stack.pop()
            if e.name != m["close"] or not stack:
                raise ValueError("xml.mismatched_end")
            e.close, e.end = m.start(), at
        elif m["open"] is not None:
            e = Element(m["open"], m.start())
            e.attrs, e.inner, e.close, e.end = m.span("attrs"), at, at, at
            for a in _ATTRIBUTE.finditer(m["attrs"]):
                g = 2 if a[2] is not None else 3
                e.attributes[a[1]] = (xml_decode(a[g]), m.start("attrs") + a.start(), m.start("attrs") + a.end())
            stack[-1].children.append(e)
            if not m["self"]:
                stack.append(e)
    if len(stack) != 1:
        raise ValueError("xml.unclosed_element")
    return root
