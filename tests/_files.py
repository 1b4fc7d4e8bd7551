"""Small files of the binary families, made from a rule."""

import struct


def compound(streams):
    """A compound file of 512-byte sectors: small streams in the mini stream, large ones in sectors of their own."""
    free, end, fat_mark = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
    mini, mini_fat, big, entries = b"", [], [], []
    for name, data in streams.items():
        if len(data) < 4096:
            n = -(-len(data) // 64)
            start = len(mini_fat)
            mini_fat += [*range(start + 1, start + n), end] if n else []
            mini += data.ljust(64 * n, b"\0")
        else:
            start = None
            big.append((name, data))
        entries.append([name, 2, start, len(data)])
    sectors, fat = [], []

    def put(data):
        first, n = len(sectors), max(1, -(-len(data) // 512))
        sectors.extend(data[i * 512 : i * 512 + 512].ljust(512, b"\0") for i in range(n))
        fat.extend([*range(first + 1, first + n), end])
        return first

    for e in entries:
        if e[2] is None:
            e[2] = put(dict(big)[e[0]])
    root = put(mini) if mini else end
    mini_at = put(b"".join(struct.pack("<I", x) for x in mini_fat).ljust(512, b"\xff")) if mini_fat else end

    def entry(name, kind, start, size, right=free, child=free):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, free, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    rows = [entry("Root Entry", 5, root, len(mini), child=1 if entries else free)]
    rows += [entry(n, k, s, z, right=i + 2 if i + 1 < len(entries) else free) for i, (n, k, s, z) in enumerate(entries)]
    directory = put(b"".join(rows))
    at = len(sectors)
    fat.append(fat_mark)
    sectors.append(struct.pack("<128I", *(fat + [free] * (128 - len(fat)))))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH6sIII", 0x3E, 3, 0xFFFE, 9, 6, b"", 0, 1, directory)
    head += struct.pack("<IIIIII", 0, 4096, mini_at, 1 if mini_fat else 0, end, 0) + struct.pack("<109I", at, *[free] * 108)
    return head.ljust(512, b"\0") + b"".join(sectors)


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def workbook(*numbers, extra=b"", pad=0):
    """A BIFF8 stream with one sheet of NUMBER cells (row, column, value)."""
    name = b"One"
    out = record(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12) + record(0x85, struct.pack("<IBBBB", 0, 0, 0, len(name), 0) + name) + extra + record(0x0A, b"")
    out += record(0x809, struct.pack("<HH", 0x600, 0x10) + b"\0" * 12) + b"".join(record(0x203, struct.pack("<HHHd", r, c, 0, v)) for r, c, v in numbers) + record(0x0A, b"")
    return out + b"\0" * pad


def mp3():
    return b"\xff\xfb\x90\x00" + b"\0" * 100 + b"TAG" + b"Song".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + b"Disc".ljust(30, b"\0") + b"2001" + b"\0" * 30 + b"\x0c"


def pdf_form():
    objects = ["<< /Type /Catalog /Pages 2 0 R /AcroForm 6 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Annots [4 0 R 5 0 R 7 0 R] >>", "<< /Subtype /Link /A << /S /URI /URI (https://a.example/x) >> >>", "<< /FT /Tx /T (name) /V (Ann) /MaxLen 6 >>", "<< /Fields [5 0 R 7 0 R] >>", "<< /FT /Tx /T (fixed) /V (F) /Ff 1 >>", "<< /Title (T) >>"]
    body = "".join(f"{i} 0 obj{o}endobj\n" for i, o in enumerate(objects, 1))
    return f"%PDF-1.4\n{body}trailer<< /Size 9 /Root 1 0 R /Info 8 0 R >>\nstartxref\n0\n%%EOF\n".encode()
