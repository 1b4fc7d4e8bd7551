"""HTML to Markdown: a tree from the tolerant stdlib parser, rendered bottom-up without recursion."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit, urlunsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self):
        """This node and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, tag: str | None = None, **attrs: str) -> Node | None:
        for n in self.walk():
            if (tag is None or n.tag == tag) and all(v in (n.attrs.get(k.rstrip("_")) or "").split() if k == "class_" else n.attrs.get(k) == v for k, v in attrs.items()):
                return n
        return None

    def all(self, test) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]


class _Tree(HTMLParser):
    """Tags nest as they come; an end tag closes what is open down to its start, or nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        seen: dict = {}
        for k, v in attrs:
            seen[k] = "" if v is None else v
        node = Node(tag, seen, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


_UNESCAPED = re.compile("&(?!(?:lt|gt|quot|amp);)")


def parse(html: str, references: str = "html") -> Node:
    """The tree; references are all that HTML has, without their semicolons too, or (``escaped``) the four that escaping writes.

    With ``escaped`` any other reference stays as it is written, so a text that
    was cut inside a reference ends with what is left of it.
    """
    tree = _Tree()
    tree.feed(html if references == "html" else _UNESCAPED.sub("&amp;", html))
    tree.close()
    return tree.root


_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAWTEXT, RCDATA = frozenset(("script", "style")), frozenset(("title", "textarea"))


class _Spans(_Tree):
    """The same tree, with the place of every text, comment and attribute value in the source."""

    def __init__(self, source: str) -> None:
        super().__init__()
        self.source, self.rows, self.open = source, [], None
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.paths: dict[int, tuple[str, dict[str, int]]] = {id(self.root): ("", {})}

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _step(self, name: str) -> str:
        path, seen = self.paths[id(self.at)]
        seen[name] = seen.get(name, 0) + 1
        return f"{path}/{name}[{seen[name]}]"

    def _row(self, kind: str, name: str, path: str, start: int, end: int | None, value: str | None) -> dict:
        self.rows.append({"kind": kind, "name": name, "path": path, "start": start, "end": end, "value": value, "quote": ""})
        return self.rows[-1]

    def mark(self, at: int) -> None:
        """What comes next begins here, so an open text ends here."""
        if self.open is not None:
            self.open["end"], self.open = at, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at, raw = self._here(), self.get_starttag_text() or ""
        self.mark(at)
        path, parent = self._step(tag), self.at
        super().handle_starttag(tag, attrs)
        node = parent.children[-1]
        self.paths[id(node)] = (path, {})
        self._row("element", tag, path, at, at + len(raw), None)
        seen = set()
        for m in _ATTRIBUTE.finditer(raw, 1 + len(tag)):
            name = m[1].lower()
            if name in seen or name not in node.attrs:
                continue
            seen.add(name)
            g = next((k for k in (2, 3, 4) if m[k] is not None), None)
            a, b = m.span(g) if g else (m.end(1), m.end(1))
            self._row("attribute", name, f"{path}/@{name}", at + a, at + b, node.attrs[name])["quote"] = {2: '"', 3: "'"}.get(g, "")

    def handle_endtag(self, tag: str) -> None:
        self.mark(self._here())
        super().handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        if self.open is not None:
            self.open["value"] += data
            return
        kind = "rawtext" if self.at.tag in RAWTEXT else "rcdata" if self.at.tag in RCDATA else "text"
        self.open = self._row(kind, self.at.tag, self._step("text()"), self._here(), None, data)

    def handle_comment(self, data: str) -> None:
        at = self._here()
        self.mark(at)
        self._row("comment", "", self._step("comment()"), at, at + len(data) + 7, data)

    def handle_decl(self, decl: str) -> None:
        self.mark(self._here())

    def handle_pi(self, data: str) -> None:
        self.mark(self._here())

    def unknown_decl(self, data: str) -> None:
        self.mark(self._here())


def spans(source: str) -> list[dict]:
    """Elements, attributes, texts and comments with kind, name, path, start, end, value and an attribute's quote, in order."""
    found = _Spans(source)
    found.feed(source)
    found.close()
    found.mark(len(source))
    return [{**r, "raw": source[r["start"] : r["end"]]} for r in found.rows]


def title_of(root: Node) -> str | None:
    t = root.find("title")
    return t.text() if t is not None and t.children else None


def requote(href: str) -> str | None:
    """href with its path quoted anew, sequences that are there kept; None if its scheme is none of http, https, file."""
    try:
        parts = urlsplit(href)
    except ValueError:
        return None
    if parts.scheme and parts.scheme.lower() not in ("http", "https", "file"):
        return None
    path = "".join(p if re.fullmatch("%[0-9A-Fa-f]{2}", p) else quote(p, safe="/!$&'()*+,;=:@~") for p in re.split("(%[0-9A-Fa-f]{2})", parts.path))
    return urlunsplit((parts.scheme, parts.netloc, path, parts.query, parts.fragment))


def _around(text: str, mark: str) -> str:
    body = text.strip()
    if not body:
        return text if not text.strip() else ""
    head, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{' ' if head else ''}{mark}{body}{mark}{' ' if tail else ''}"


class Renderer:
    """Rules by tag; each gets the rendered children and the node."""

    def __init__(self, keep_data_uris: bool = False, base: str | None = None) -> None:
        self.keep_data_uris, self.base = keep_data_uris, base

    def render(self, root: Node) -> str:
        done: dict[int, str] = {}
        stack: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
        while stack:
            node, ready, pre, flat = stack.pop()
            if not ready:
                stack.append((node, True, pre, flat))
                below = (pre or node.tag in ("pre", "code", "kbd", "samp"), flat or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "a"))
                stack += [(c, False, *below) for c in node.children if isinstance(c, Node)]
                continue
            parts = []
            for i, c in enumerate(node.children):
                parts.append(done.pop(id(c)) if isinstance(c, Node) else self.words(c, node, i, pre or node.tag in ("pre", "code", "kbd", "samp")))
            body = "".join(parts)
            rule = getattr(self, f"on_{node.tag}", None)
            done[id(node)] = rule(body, node, flat) if rule else (f"\n{body}\n" if node.tag in BLOCKS else body)
        return done[id(root)]

    def words(self, text: str, node: Node, at: int, pre: bool) -> str:
        if pre:
            return text
        text = re.sub(r"[\t \r\n\f]+", " ", text)
        near = lambda i: node.children[i] if 0 <= i < len(node.children) else None
        block = lambda n: isinstance(n, Node) and n.tag in BLOCKS | {"br"}
        if block(near(at - 1)) or (at == 0 and node.tag in BLOCKS):
            text = text.lstrip(" ")
        if block(near(at + 1)) or (at == len(node.children) - 1 and node.tag in BLOCKS):
            text = text.rstrip(" ")
        return re.sub(r"([*_])", r"\\\1", text)

    def _drop(self, body: str, node: Node, flat: bool) -> str:
        return ""

    on_script = on_style = on_head = on_noscript = on_template = _drop

    def _heading(self, body: str, node: Node, flat: bool) -> str:
        text = " ".join(body.split())
        return f"\n\n{'#' * int(node.tag[1])} {text}\n\n" if text else ""

    on_h1 = on_h2 = on_h3 = on_h4 = on_h5 = on_h6 = _heading

    def on_p(self, body: str, node: Node, flat: bool) -> str:
        text = body.strip()
        return (f" {text} " if flat else f"\n\n{text}\n\n") if text else ""

    def on_div(self, body: str, node: Node, flat: bool) -> str:
        return f" {body.strip()} " if flat else f"\n\n{body.strip()}\n\n" if body.strip() else ""

    on_article = on_section = on_main = on_header = on_footer = on_nav = on_aside = on_div

    def on_br(self, body: str, node: Node, flat: bool) -> str:
        return " " if flat else "  \n"

    def on_hr(self, body: str, node: Node, flat: bool) -> str:
        return "\n\n---\n\n"

    def on_b(self, body: str, node: Node, flat: bool) -> str:
        return _around(body, "**")

    def on_i(self, body: str, node: Node, flat: bool) -> str:
        return _around(body, "*")

    def on_s(self, body: str, node: Node, flat: bool) -> str:
        return _around(body, "~~")

    on_strong, on_em, on_del = on_b, on_i, on_s

    def on_u(self, body: str, node: Node, flat: bool) -> str:
        if not body.strip():
            return body
        head, tail = " " * (body != body.lstrip()), " " * (body != body.rstrip())
        return f"{head}<u>{body.strip()}</u>{tail}"

    def on_code(self, body: str, node: Node, flat: bool) -> str:
        if node.parent is not None and node.parent.tag == "pre":
            return body
        return _around(body, "`")

    on_kbd = on_samp = on_code

    def on_pre(self, body: str, node: Node, flat: bool) -> str:
        return f"\n\n```\n{body.strip(chr(10))}\n```\n\n" if body.strip() else ""

    def on_blockquote(self, body: str, node: Node, flat: bool) -> str:
        text = re.sub(r"\n{3,}", "\n\n", body.strip())
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in text.split("\n")) + "\n\n" if text else ""

    def _list(self, body: str, node: Node, flat: bool) -> str:
        inner = node.parent is not None and node.parent.tag == "li"
        return f"\n{body.strip(chr(10))}\n" if inner else f"\n\n{body.strip(chr(10))}\n\n"

    on_ul = on_ol = _list

    def on_li(self, body: str, node: Node, flat: bool) -> str:
        mark, up = "*", node.parent
        if up is not None and up.tag == "ol":
            first = int(up.attrs["start"]) if (up.attrs.get("start") or "").isdigit() else 1
            mark = f"{first + [c for c in up.children if isinstance(c, Node) and c.tag == 'li'].index(node)}."
        elif up is not None:
            depth, n = 0, up
            while n is not None:
                depth += n.tag == "ul"
                n = n.parent
            mark = "*+-"[max(0, depth - 1) % 3]
        text = re.sub(r"\n{3,}", "\n\n", body.strip())
        return f"{mark} " + text.replace("\n", "\n" + " " * (len(mark) + 1)) + "\n"

    def on_a(self, body: str, node: Node, flat: bool) -> str:
        text, n = body.strip(), node.parent
        while n is not None:
            if n.tag == "pre":
                return body
            n = n.parent
        href = node.attrs.get("href")
        if not text:
            return ""
        head, tail = " " * (body != body.lstrip()), " " * (body != body.rstrip())
        if href and self.base:
            href = urljoin(self.base, href)
        href = requote(href) if href else None
        if not href:
            return f"{head}{text}{tail}"
        title = (node.attrs.get("title") or "").replace('"', r"\"")
        if text.replace(r"\_", "_") == href and not title:
            return f"{head}<{href}>{tail}"
        return f"{head}[{text}]({href}{f' {chr(34)}{title}{chr(34)}' if title else ''}){tail}"

    def on_img(self, body: str, node: Node, flat: bool) -> str:
        alt = (node.attrs.get("alt") or "").replace("\n", " ")
        src, lazy = node.attrs.get("src") or "", node.attrs.get("data-src") or ""
        data = src[:5].lower() == "data:"
        if lazy and (not src or (data and not self.keep_data_uris)):
            src, data = lazy, False
        if flat and (node.parent is None or node.parent.tag not in ("td", "th", "a")):
            return alt
        if data and not self.keep_data_uris:
            src = src.split(",")[0] + "..."
        elif self.base and src and not data:
            src = urljoin(self.base, src)
        title = (node.attrs.get("title") or "").replace('"', r"\"")
        return f"![{alt}]({src}{f' {chr(34)}{title}{chr(34)}' if title else ''})"

    def on_input(self, body: str, node: Node, flat: bool) -> str:
        if (node.attrs.get("type") or "").lower() != "checkbox":
            return ""
        return "[x] " if "checked" in node.attrs else "[ ] "

    def _cell(self, body: str, node: Node, flat: bool) -> str:
        span = node.attrs.get("colspan") or "1"
        n = min(1000, int(span)) if span.isdigit() else 1
        return f" {' '.join(body.split()).replace('|', chr(92) + '|')} |" * 1 + " |" * (max(1, n) - 1)

    on_td = on_th = _cell

    def on_tr(self, body: str, node: Node, flat: bool) -> str:
        cells = [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")]
        if not cells:
            return ""
        table = node.parent
        while table is not None and table.tag != "table":
            table = table.parent
        first = table is None or next((n for n in table.walk() if n.tag == "tr" and any(isinstance(c, Node) and c.tag in ("td", "th") for c in n.children)), None) is node
        line = "|" + "".join(self._cells(body)) + "\n"
        width = line.count(" |") or 1
        return line + ("| " + " | ".join(["---"] * width) + " |\n" if first else "")

    @staticmethod
    def _cells(body: str) -> str:
        return body.strip("\n")

    def on_table(self, body: str, node: Node, flat: bool) -> str:
        return "\n\n" + re.sub(r"\n\s*\n", "\n", body).strip() + "\n\n"

    def on_caption(self, body: str, node: Node, flat: bool) -> str:
        return body.strip() + "\n\n"

    def _bare(self, body: str, node: Node, flat: bool) -> str:
        return body

    on_tbody = on_thead = on_tfoot = _bare


def normalized(markdown: str) -> str:
    """Lines without blanks at their ends, one empty line at most in a row."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in re.split("\r?\n", markdown)))


def to_markdown(html: str | Node, keep_data_uris: bool = False, base: str | None = None) -> str:
    root = parse(html) if isinstance(html, str) else html
    for n in root.all(lambda n: n.tag in ("script", "style")):
        n.remove()
    body = root.find("body") or root
    return normalized(Renderer(keep_data_uris, base).render(body)).strip()


def convert(html: str, references: str = "html", **options) -> tuple[str, str | None]:
    """(markdown, title) of a page."""
    root = parse(html, references)
    return to_markdown(root, **options), title_of(root)


def decode_redirect(href: str) -> str:
    import base64
    from urllib.parse import parse_qs

    try:
        u = parse_qs(urlsplit(href).query)["u"][0][2:]
        return base64.b64decode(u + "==", altchars=b"-_").decode()
    except (KeyError, ValueError):
        return href


def percent_bytes(text: str) -> bytes:
    return unquote_to_bytes(text)
