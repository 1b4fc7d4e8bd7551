"""Binary containers and media: compound files, mail, BIFF sheets, PNG, JPEG and MP3 metadata.

Every parser is iterative, bounded by the limits below, and reports what it
can't accept as ValueError; the operators turn that into a row's status.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter

#: Resource limits (fixed values).
SOURCE_BYTES, PNG_CHUNKS, PNG_CHUNK_BYTES, JPEG_MARKERS, MSG_PROPERTIES, XLS_RECORDS = 64 << 20, 16_384, 16 << 20, 4_096, 8_192, 1_000_000
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def _u16(b: bytes, at: int) -> int:
    return struct.unpack_from("<H", b, at)[0]


def _u32(b: bytes, at: int) -> int:
    return struct.unpack_from("<I", b, at)[0]


# -- compound files ----------------------------------------------------------------------------------------------------


class Compound:
    """Streams of a compound file by path."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1") or len(data) > SOURCE_BYTES:
            raise ValueError("cfb.signature")
        self.data, self.size = data, 1 << _u16(data, 30)
        self.mini_size, self.cutoff = 1 << _u16(data, 32), _u32(data, 56)
        table = [x for x in struct.unpack_from("<109I", data, 76)]
        at, seen = _u32(data, 68), set()
        per = self.size // 4
        while at not in (END, FREE):
            if at in seen:
                raise ValueError("cfb.difat_cycle")
            seen.add(at)
            block = struct.unpack(f"<{per}I", self.sector(at))
            table += block[:-1]
            at = block[-1]
        self.fat = [x for s in table if s not in (FREE, END) for x in struct.unpack(f"<{per}I", self.sector(s))]
        self.mini = [x for (x,) in struct.iter_unpack("<I", self.chain(_u32(data, 60)))] if _u32(data, 60) not in (END, FREE) else []
        self.entries = [self._entry(e) for e in self._split(self.chain(_u32(data, 48)), 128)]
        self.small = self.chain(self.entries[0]["start"])[: self.entries[0]["size"]] if self.entries and self.entries[0]["start"] != END else b""
        self.streams = self._paths()

    @staticmethod
    def _split(b: bytes, n: int) -> list[bytes]:
        return [b[i : i + n] for i in range(0, len(b) - n + 1, n)]

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at + self.size > len(self.data) + self.size - 1:
            raise ValueError("cfb.sector_out_of_range")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at not in (END, FREE):
            if at in seen or at >= len(self.fat):
                raise ValueError("cfb.chain")
            seen.add(at)
            out.append(self.sector(at))
            at = self.fat[at]
        return b"".join(out)

    def mini_chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at not in (END, FREE):
            if at in seen or at >= len(self.mini):
                raise ValueError("cfb.mini_chain")
            seen.add(at)
            out.append(self.small[at * self.mini_size : (at + 1) * self.mini_size])
            at = self.mini[at]
        return b"".join(out)

    @staticmethod
    def _entry(b: bytes) -> dict:
        n = _u16(b, 64)
        return {"name": b[: max(0, n - 2)].decode("utf-16-le", "replace"), "kind": b[66], "left": _u32(b, 68), "right": _u32(b, 72), "child": _u32(b, 76), "start": _u32(b, 116), "size": _u32(b, 120)}

    def _paths(self) -> dict[tuple[str, ...], int]:
        out: dict[tuple[str, ...], int] = {}
        stack: list[tuple[int, tuple[str, ...]]] = [(self.entries[0]["child"], ())] if self.entries else []
        seen: set[int] = set()
        while stack:
            i, up = stack.pop()
            if i == FREE or i >= len(self.entries):
                continue
            if i in seen:
                raise ValueError("cfb.directory_cycle")
            seen.add(i)
            e = self.entries[i]
            stack += [(e["left"], up), (e["right"], up)]
            if e["kind"] == 1:
                stack.append((e["child"], (*up, e["name"])))
            elif e["kind"] == 2:
                out[(*up, e["name"])] = i
        return out

    def read(self, *path: str) -> bytes | None:
        i = self.streams.get(path)
        if i is None:
            return None
        e = self.entries[i]
        return (self.mini_chain(e["start"]) if e["size"] < self.cutoff else self.chain(e["start"]))[: e["size"]]

    def _sectors(self, at: int, table: list[int]) -> list[int]:
        out: list[int] = []
        seen: set[int] = set()
        while at not in (END, FREE):
            if at in seen or at >= len(table):
                raise ValueError("cfb.chain")
            seen.add(at)
            out.append(at)
            at = table[at]
        return out

    def slices(self, *path: str) -> list[tuple[int, int]]:
        """(file offset, length) of a stream's bytes, in the stream's order."""
        e = self.entries[self.streams[path]]
        if e["size"] >= self.cutoff:
            where, size = [(n + 1) * self.size for n in self._sectors(e["start"], self.fat)], self.size
        else:
            big, size = self._sectors(self.entries[0]["start"], self.fat), self.mini_size
            per = self.size // size
            where = [(big[n // per] + 1) * self.size + n % per * size for n in self._sectors(e["start"], self.mini)]
        return [(at, min(size, e["size"] - k * size)) for k, at in enumerate(where) if k * size < e["size"]]

    def patched(self, path: tuple[str, ...], at: int, new: bytes) -> bytes:
        """The file with bytes of a stream replaced at ``at`` by as many others; nothing else changes."""
        out, done = bytearray(self.data), 0
        for offset, n in self.slices(*path):
            first, last = max(at, done), min(at + len(new), done + n)
            if first < last:
                out[offset + first - done : offset + last - done] = new[first - at : last - at]
            done += n
        if at + len(new) > done:
            raise ValueError("cfb.stream_range")
        return bytes(out)


# -- mail --------------------------------------------------------------------------------------------------------------


def long_properties(data: bytes, header: int = 32) -> dict[int, int]:
    """Tag -> value of 32-bit properties: 16-byte entries after the header."""
    out = {}
    for at in range(header, min(len(data), header + 16 * MSG_PROPERTIES) - 15, 16):
        tag, = struct.unpack_from("<I", data, at)
        if tag & 0xFFFF == 3:
            out[tag >> 16] = _u32(data, at + 8)
    return out


def mail(data: bytes) -> dict:
    """sender, to, subject and body of a message: Unicode streams first, then those of the declared code page."""
    from ..functions.ids import CODEPAGES

    box = Compound(data)
    long = long_properties(box.read("__properties_version1.0") or b"")
    page = long.get(0x3FFD) or long.get(0x3FDE)
    codec = CODEPAGES.get(page, f"cp{page}") if page else "cp1252"

    def text(tag: int) -> str | None:
        wide = box.read(f"__substg1.0_{tag:04X}001F")
        if wide is not None:
            return wide.decode("utf-16-le", "replace").rstrip("\0")
        narrow = box.read(f"__substg1.0_{tag:04X}001E")
        if narrow is None:
            return None
        try:
            return narrow.decode(codec).rstrip("\0")
        except (LookupError, UnicodeDecodeError):
            return narrow.decode("utf-8", "replace").rstrip("\0")

    return {"sender": text(0x0C1F) or text(0x0C1A), "to": text(0x0E04), "subject": text(0x0037), "body": text(0x1000)}


#: A message's subject as MAPI stores it, in Unicode (a fixed value).
SUBJECT = "__substg1.0_0037001F"


def msg_subject(data: bytes) -> list[dict]:
    """The subject as an owner; one in a code page, or none, can't be edited."""
    box = Compound(data)
    raw = box.read(SUBJECT)
    if raw is None:
        narrow = box.read("__substg1.0_0037001E") is not None
        return [{"owner": "subject", "value": mail(data)["subject"], "reason": "msg.subject.ansi_unsupported" if narrow else "msg.subject.missing"}]
    whole = len(raw) % 2 == 0 and raw.decode("utf-16-le", "replace").encode("utf-16-le") == raw
    return [{"owner": "subject", "value": raw.decode("utf-16-le", "replace"), "reason": None if whole else "msg.subject.encoding"}]


def msg_replace(data: bytes, owner: str, text: str) -> bytes:
    """The subject replaced by one of the same encoded length."""
    have = next(o for o in msg_subject(data) if o["owner"] == owner)
    if have["reason"]:
        raise ValueError(have["reason"])
    new = text.encode("utf-16-le")
    if text == have["value"]:
        raise ValueError("no_op_update")
    if len(new) != len(have["value"].encode("utf-16-le")):
        raise ValueError("msg.subject.length_mismatch")
    made = Compound(data).patched((SUBJECT,), 0, new)
    if msg_subject(made)[0]["value"] != text:
        raise ValueError("verification_failed")
    return made


def mail_markdown(data: bytes, **_) -> tuple[str, str | None]:
    m = mail(data)
    head = "".join(f"**{label}:** {m[k]}\n" for label, k in (("From", "sender"), ("To", "to"), ("Subject", "subject")) if m[k])
    return f"# Email Message\n\n{head}\n## Content\n\n{m['body'] or ''}".strip(), m["subject"]


# -- BIFF8 -------------------------------------------------------------------------------------------------------------


def records(stream: bytes) -> list[tuple[int, bytes]]:
    """Records of a workbook stream; continuations are joined to what they continue."""
    out: list[tuple[int, bytes]] = []
    at = 0
    while at + 4 <= len(stream) and len(out) < XLS_RECORDS:
        kind, n = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + n]
        if kind == 0x3C and out and out[-1][0] != 0xFC:
            out[-1] = (out[-1][0], out[-1][1] + body)
        else:
            out.append((kind, body))
        at += 4 + n
    return out


def _rk(v: int) -> float:
    x = float(struct.unpack("<i", struct.pack("<I", v & ~3))[0] >> 2) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & ~3))[0]
    return x / 100 if v & 1 else x


def _shared(parts: list[bytes]) -> list[str]:
    """Shared strings over a record and its continuations; where text goes on, the next part begins with a flag byte."""
    total, out = _u32(parts[0], 4), []
    part, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            got += (piece := parts[part][at : at + n])
            at, n = at + len(piece), n - len(piece)
        return got

    for _ in range(total):
        n, flags = struct.unpack("<HB", take(3))
        runs = _u16(take(2), 0) if flags & 8 else 0
        extra = _u32(take(4), 0) if flags & 4 else 0
        text, wide = "", flags & 1
        while n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
                wide = take(1)[0] & 1
            here = min(n, (len(parts[part]) - at) // (2 if wide else 1))
            text += take(here * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1")
            n -= here
        take(4 * runs + extra)
        out.append(text)
    return out


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def xls_cells(data: bytes) -> list[dict]:
    """Cells of all sheets: sheet_index, sheet, row, column, type, value."""
    box = Compound(data)
    stream = box.read("Workbook") or box.read("Book")
    if stream is None:
        raise ValueError("xls.workbook_missing")
    found = records(stream)
    strings: list[str] = []
    for i, (kind, body) in enumerate(found):
        if kind == 0xFC:
            parts = [body]
            while i + len(parts) < len(found) and found[i + len(parts)][0] == 0x3C:
                parts.append(found[i + len(parts)][1])
            strings = _shared(parts)
    names = [b[8 : 8 + b[6] * (2 if b[7] & 1 else 1)].decode("utf-16-le" if b[7] & 1 else "latin-1") for k, b in found if k == 0x85]
    out, sheet, depth = [], -1, 0

    def add(b: bytes, kind: str, value: str | None, column: int | None = None) -> None:
        out.append({"sheet_index": sheet, "sheet": names[sheet] if sheet < len(names) else str(sheet), "row": _u16(b, 0), "column": _u16(b, 2) if column is None else column, "type": kind, "value": value, "formula": None, "merged": False})

    for kind, b in found:
        if kind == 0x809:
            depth += 1
            sheet += _u16(b, 2) == 0x10
        elif kind == 0x0A:
            depth -= 1
        elif kind == 0xFD:
            add(b, "string", strings[_u32(b, 6)])
        elif kind == 0x203:
            add(b, "float", _number(struct.unpack_from("<d", b, 6)[0]))
        elif kind == 0x27E:
            add(b, "float", _number(_rk(_u32(b, 6))))
        elif kind == 0xBD:
            for k in range((len(b) - 6) // 6):
                add(b, "float", _number(_rk(_u32(b, 6 + 6 * k))), _u16(b, 2) + k)
        elif kind == 0x205:
            add(b, "error" if b[7] else "bool", str(b[6]) if b[7] else ("TRUE" if b[6] else "FALSE"))
        elif kind == 0x204:
            add(b, "string", b[9 : 9 + _u16(b, 6) * (2 if b[8] & 1 else 1)].decode("utf-16-le" if b[8] & 1 else "latin-1"))
        elif kind == 0x06 and b[12:14] != b"\xff\xff":
            add(b, "formula", _number(struct.unpack_from("<d", b, 6)[0]))
    return out


#: Records that forbid edits of a workbook's numbers (fixed values): encryption, macros, formulas, arrays, tables, shared formulas.
BLOCKERS = {0x2F: "xls.encrypted", 0xD3: "xls.macros", 0x06: "xls.formulas", 0x221: "xls.array_formulas", 0x236: "xls.data_tables", 0x4BC: "xls.shared_formulas"}


def xls_numbers(data: bytes) -> list[dict]:
    """NUMBER cells as owners: sheet_index, row, column, value, place of their eight bytes in the stream, reason."""
    box = Compound(data)
    name = next((n for n in ("Workbook", "Book") if (n,) in box.streams), None)
    if name is None:
        raise ValueError("xls.workbook_missing")
    stream, out, at, sheet, blocked = box.read(name), [], 0, -1, None
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        blocked = blocked or BLOCKERS.get(kind)
        if kind == 0x809:
            sheet += _u16(stream, at + 6) == 0x10
        elif kind == 0x203 and n == 14:
            out.append({"sheet_index": sheet, "row": _u16(stream, at + 4), "column": _u16(stream, at + 6), "number": struct.unpack_from("<d", stream, at + 10)[0], "at": at + 10, "stream": name})
        at += 4 + n
    times = Counter((o["sheet_index"], o["row"], o["column"]) for o in out)
    for o in out:
        key = (o["sheet_index"], o["row"], o["column"])
        o |= {"owner": "/".join(map(str, key)), "value": _number(o["number"]), "reason": blocked or ("xls.cell.duplicate" if times[key] > 1 else None)}
    return out


def xls_replace(data: bytes, edits: list[dict]) -> bytes:
    """Numbers by (sheet index, row, column), each in its own eight bytes."""
    have = {(o["sheet_index"], o["row"], o["column"]): o for o in xls_numbers(data)}
    asked: dict[tuple[int, int, int], float] = {}
    for e in edits:
        key = tuple(e["target"])
        if key in asked:
            raise ValueError("duplicate_cell_coordinate")
        if key not in have:
            raise ValueError("xls.cell.not_a_number_record")
        if have[key]["reason"]:
            raise ValueError(have[key]["reason"])
        if isinstance(e["new"], bool) or not isinstance(e["new"], (int, float)) or e["new"] in (float("inf"), float("-inf")) or e["new"] != e["new"]:
            raise ValueError("invalid_cell_value")
        if e.get("old") is not None and e["old"] != have[key]["number"]:
            raise ValueError("cell_old_value_mismatch")
        if float(e["new"]) == have[key]["number"]:
            raise ValueError("no_op_cell_update")
        asked[key] = float(e["new"])
    made = data
    for key, new in asked.items():
        made = Compound(made).patched((have[key]["stream"],), have[key]["at"], struct.pack("<d", new))
    after = xls_numbers(made)
    if any(o["number"] != asked.get((o["sheet_index"], o["row"], o["column"]), o["number"]) for o in after) or len(after) != len(xls_numbers(data)):
        raise ValueError("verification_failed")
    return made


def xls(data: bytes, **_) -> tuple[str, str | None]:
    from .office import sheets_markdown

    return sheets_markdown(xls_cells(data)), None


# -- media -------------------------------------------------------------------------------------------------------------


def png_chunks(data: bytes) -> list[tuple[int, str, bytes]]:
    """(start, type, body) of every chunk, checksums proven."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) > SOURCE_BYTES:
        raise ValueError("png.signature")
    out, at = [], 8
    while at < len(data):
        if at + 12 > len(data) or len(out) >= PNG_CHUNKS:
            raise ValueError("png.framing")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if n > PNG_CHUNK_BYTES or len(body) != n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("png.checksum")
        out.append((at, kind.decode("latin-1"), body))
        at += 12 + n
        if kind == b"IEND":
            break
    return out


def png_text(data: bytes) -> list[dict]:
    """Text owners: keyword, text, chunk type and whether they are writable (keyword unique, no animation)."""
    chunks, out = png_chunks(data), []
    moving = any(k == "acTL" for _, k, _ in chunks)
    for at, kind, body in chunks:
        key, _, rest = body.partition(b"\0")
        if kind == "tEXt":
            text = rest.decode("latin-1")
        elif kind == "zTXt":
            text = zlib.decompressobj().decompress(rest[1:], 1 << 20).decode("latin-1")
        elif kind == "iTXt":
            packed, tail = rest[0], rest[2:]
            raw = tail.split(b"\0", 2)[2]
            text = (zlib.decompressobj().decompress(raw, 1 << 20) if packed else raw).decode("utf-8")
        else:
            continue
        out.append({"start": at, "kind": kind, "keyword": key.decode("latin-1"), "text": text})
    for o in out:
        o["writable"] = not moving and sum(x["keyword"] == o["keyword"] for x in out) == 1
    return out


def png_replace(data: bytes, keyword: str, text: str) -> bytes:
    """The file with one text chunk replaced; all other bytes stay."""
    owner = next(o for o in png_text(data) if o["keyword"] == keyword and o["writable"])
    n = struct.unpack_from(">I", data, owner["start"])[0]
    key = keyword.encode("latin-1") + b"\0"
    body = {"tEXt": lambda: key + text.encode("latin-1"), "zTXt": lambda: key + b"\0" + zlib.compress(text.encode("latin-1")), "iTXt": lambda: key + b"\0\0\0\0" + text.encode()}[owner["kind"]]()
    kind = owner["kind"].encode()
    chunk = struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return data[: owner["start"]] + chunk + data[owner["start"] + 12 + n :]


def jpeg_segments(data: bytes) -> list[tuple[int, int, bytes]]:
    if data[:2] != b"\xff\xd8" or len(data) > SOURCE_BYTES:
        raise ValueError("jpeg.signature")
    out, at = [], 2
    while at + 4 <= len(data) and len(out) < JPEG_MARKERS:
        if data[at] != 0xFF:
            raise ValueError("jpeg.marker")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind in (0xD9, 0xDA):
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        out.append((at, kind, data[at + 4 : at + 2 + n]))
        at += 2 + n
    return out


#: Exif text tags (fixed values).
EXIF = {0x010E: "ImageDescription", 0x013B: "Artist"}


def jpeg_exif(data: bytes) -> list[dict]:
    """Text tags of the first directory: name, text, file offset and room."""
    out = []
    for at, kind, body in jpeg_segments(data):
        if kind != 0xE1 or body[:6] != b"Exif\0\0":
            continue
        tiff, order = body[6:], "<" if body[6:8] == b"II" else ">"
        first = struct.unpack_from(order + "I", tiff, 4)[0]
        for i in range(struct.unpack_from(order + "H", tiff, first)[0]):
            tag, form, n, value = struct.unpack_from(order + "HHII", tiff, first + 2 + 12 * i)
            if tag in EXIF and form == 2:
                where = value if n > 4 else first + 2 + 12 * i + 8
                if where + n > len(tiff):
                    raise ValueError("jpeg.exif_range")
                out.append({"name": EXIF[tag], "text": tiff[where : where + n].split(b"\0")[0].decode("ascii", "replace"), "offset": at + 4 + 6 + where, "room": n})
    return out


def jpeg_replace(data: bytes, name: str, text: str) -> bytes:
    """ASCII text that fits the room of its tag; all other bytes stay."""
    owner = next(o for o in jpeg_exif(data) if o["name"] == name)
    raw = text.encode("ascii") + b"\0"
    if len(raw) > owner["room"]:
        raise ValueError("jpeg.exif_allocation_exceeded")
    return data[: owner["offset"]] + raw.ljust(owner["room"], b"\0") + data[owner["offset"] + owner["room"] :]


def id3v1(data: bytes) -> list[dict]:
    """Title, artist and album of a terminal tag as owners."""
    if data[-128:-125] != b"TAG":
        raise ValueError("mp3.tag_missing")
    return [{"owner": name, "value": data[len(data) - 128 + at : len(data) - 98 + at].split(b"\0")[0].decode("latin-1").rstrip(), "reason": None} for name, at in (("title", 3), ("artist", 33), ("album", 63))]


def id3v1_replace(data: bytes, field: str, text: str) -> bytes:
    at = {"title": 3, "artist": 33, "album": 63}[field] + len(data) - 128
    if data[-128:-125] != b"TAG":
        raise ValueError("mp3.tag_missing")
    raw = text.encode("latin-1")
    if len(raw) > 30:
        raise ValueError("mp3.slot_exceeded")
    return data[:at] + raw.ljust(30, b"\0") + data[at + 30 :]


#: Order of fields in the Markdown of media (fixed values).
IMAGE_FIELDS = ("ImageSize", "Title", "Caption", "Description", "Keywords", "Artist", "Author", "DateTimeOriginal", "CreateDate", "GPSPosition")


def image(data: bytes, **_) -> tuple[str, str | None]:
    found: dict[str, str] = {}
    if data[:4] == b"\x89PNG":
        width, height = struct.unpack_from(">II", png_chunks(data)[0][2])
        found["ImageSize"] = f"{width}x{height}"
        found |= {o["keyword"]: o["text"] for o in png_text(data)}
    else:
        found |= {("Description" if o["name"] == "ImageDescription" else o["name"]): o["text"] for o in jpeg_exif(data)}
    return "\n".join(f"{k}: {found[k]}" for k in IMAGE_FIELDS if found.get(k)), None


def audio(data: bytes, **_) -> tuple[str, str | None]:
    if data[-128:-125] != b"TAG":
        return "", None
    slot = lambda i: data[-128 + i : -98 + i].split(b"\0")[0].decode("latin-1").rstrip()
    return "\n".join(f"{k}: {v}" for k, v in (("Title", slot(3)), ("Artist", slot(33)), ("Album", slot(63))) if v), slot(3) or None
