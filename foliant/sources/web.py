"""Well-known sites and feeds."""

from __future__ import annotations

import json
import re
import textwrap
import xml.etree.ElementTree as ET
from urllib.parse import parse_qs, urljoin, urlsplit

from .html import Node, Renderer, decode_redirect, normalized, parse, title_of, to_markdown


def wikipedia(html: str, **options) -> tuple[str, str | None]:
    """The article's body under its title; without a body the whole page."""
    root = parse(html)
    main, head = root.find("div", id="mw-content-text"), root.find("span", class_="mw-page-title-main")
    title = (head.text().strip() if head is not None else "") or (title_of(root) or "").strip() or None
    if main is None:
        return to_markdown(root, **options), title
    for n in main.all(lambda n: n.tag in ("script", "style")):
        n.remove()
    body = normalized(Renderer(**options).render(main)).strip()
    return (f"# {title}\n\n" if title else "") + body, title


def _class(n: Node, name: str) -> bool:
    return name in (n.attrs.get("class") or "").split()


def bing(html: str, url: str = "", **options) -> tuple[str, str | None]:
    """Search results, one after the other, their redirects resolved."""
    root = parse(html)
    for n in root.all(lambda n: _class(n, "tptt")):
        n.children.append(" ")
    for n in root.all(lambda n: _class(n, "algoSlug_icon")):
        n.remove()
    found = []
    for r in root.all(lambda n: _class(n, "b_algo")):
        for a in r.all(lambda n: n.tag == "a" and "href" in n.attrs):
            a.attrs["href"] = decode_redirect(a.attrs["href"])
        text = Renderer(**options).render(r).strip()
        found.append("\n".join(x.strip() for x in text.split("\n") if x.strip()))
    query = parse_qs(urlsplit(url).query).get("q", [""])[0]
    return f"## A Bing search for '{query}' found the following results:\n\n" + "\n\n".join(found), title_of(root)


def _deep(value: object, key: str) -> object:
    """First value under key, depth first, without recursion."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if key in x:
                return x[key]
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return None


def youtube(html: str, transcript: str | None = None, **options) -> tuple[str, str | None] | None:
    """Title, metadata, description and transcript; None if the page has none of them."""
    root = parse(html)
    meta: dict[str, str] = {}
    if title_of(root):
        meta["title"] = title_of(root)
    for n in root.all(lambda n: n.tag == "meta"):
        key = next((n.attrs[k] for k in ("itemprop", "property", "name") if n.attrs.get(k)), None)
        if key and n.attrs.get("content"):
            meta.setdefault(key, n.attrs["content"])
    for s in root.all(lambda n: n.tag == "script"):
        m = re.search(r"var ytInitialData = ({.*?});", s.text(), re.S)
        if m:
            try:
                body = _deep(json.loads(m[1]), "attributedDescriptionBodyText")
                if isinstance(body, dict) and body.get("content"):
                    meta["description"] = body["content"]
            except ValueError:
                continue
    first = lambda *keys: next((meta[k] for k in keys if k in meta), None)
    title, out = first("title", "og:title", "name"), ""
    if title:
        out += f"\n## {title}\n"
    stats = "".join(f"- **{label}:** {v}\n" for label, v in (("Views", first("interactionCount")), ("Keywords", first("keywords")), ("Runtime", first("duration"))) if v)
    if stats:
        out += f"\n### Video Metadata\n{stats}\n"
    if d := first("description", "og:description"):
        out += f"\n### Description\n{d}\n"
    if transcript:
        out += f"\n### Transcript\n{transcript}\n"
    return ("# YouTube\n" + out, title) if out else None


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _space(e: ET.Element) -> str:
    return e.tag[1:].split("}")[0] if isinstance(e.tag, str) and e.tag[:1] == "{" else ""


def _direct(e: ET.Element, name: str, spaces: tuple[str, ...] = ("",)) -> list[ET.Element]:
    return [c for c in e if _name(c) == name and _space(c) in spaces]


def _content(e: ET.Element | None) -> str:
    if e is None:
        return ""
    return ("".join(e.itertext()) if not len(e) else (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)).strip()


def _flat(text: str) -> str | None:
    parts = [re.sub(r"\s+", " ", p).strip() for p in parse(re.sub(r"(?i)</?(?:p|div|br|li|h\d)[^>]*>", "\n", text)).text().split("\n")]
    return " ".join(p for p in parts if p) or None


ATOM = ("http://www.w3.org/2005/Atom", "")
CONTENT, XML = ("http://purl.org/rss/1.0/modules/content/",), "{http://www.w3.org/XML/1998/namespace}base"


def _guarded(data: bytes) -> ET.Element:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document type declarations are refused")
    return ET.fromstring(data)


def atom_kind(kind: str | None, media: bool) -> str:
    k = (kind or "text").strip().lower()
    if k in ("text", "html", "xhtml"):
        return k
    if media and (k.endswith(("+xml", "/xml")) or k == "text/html"):
        return "html"
    return "text" if media and k.startswith("text/") else "binary" if media else "text"


def _atom_value(e: ET.Element | None, base: str | None, media: bool = False) -> str | None:
    if e is None:
        return None
    kind = atom_kind(e.get("type"), media)
    if kind == "binary":
        return None
    if kind == "text":
        return textwrap.dedent("".join(e.itertext())).strip() or None
    markup = "".join(ET.tostring(c, encoding="unicode") for c in e) if kind == "xhtml" else "".join(e.itertext())
    markup = re.sub(r"<(/?)\w+:", r"<\1", markup)
    return to_markdown(markup, base=urljoin(base or "", e.get(XML) or "") or None) or None


def feed(data: bytes, url: str | None = None, **options) -> tuple[str, str | None]:
    """RSS 2 or Atom."""
    root = _guarded(data)
    if _name(root) == "feed":
        base = urljoin(url or "", root.get(XML) or "") or None
        one = lambda e, n: next(iter(_direct(e, n, ATOM)), None)
        head = lambda e: _flat(_atom_value(e, None) or "") if e is not None else None
        title = head(one(root, "title"))
        out = f"# {title}\n" if title else ""
        if sub := _atom_value(one(root, "subtitle"), base):
            out += f"{sub}\n"
        for entry in _direct(root, "entry", ATOM):
            here = urljoin(base or "", entry.get(XML) or "") or None
            if t := head(one(entry, "title")):
                out += f"\n## {t}\n"
            if (u := one(entry, "updated")) is not None and (u.text or "").strip():
                out += f"Updated on: {u.text.strip()}\n"
            for part, media in (("summary", False), ("content", True)):
                if v := _atom_value(one(entry, part), here, media):
                    out += f"{v}\n"
        return out, title
    channel = next((c for c in root if _name(c) == "channel"), None)
    if channel is None:
        raise ValueError("no channel")
    text = lambda e, n: _content(next(iter(_direct(e, n)), None))
    title = _flat(text(channel, "title"))
    out = f"# {title}\n" if title else ""
    if d := text(channel, "description"):
        out += f"{to_markdown(d)}\n"
    for item in _direct(channel, "item"):
        if t := _flat(text(item, "title")):
            out += f"\n## {t}\n"
        if p := text(item, "pubDate".lower()):
            out += f"Published on: {p}\n"
        if d := text(item, "description"):
            out += f"{to_markdown(d)}\n"
        if c := _content(next(iter(_direct(item, "encoded", CONTENT)), None)):
            out += f"{to_markdown(c)}\n"
    return out, title
