"""Word boxes out of PDF pages, and forms among them as tables."""

import zlib

from foliant.operators import convert as CV
from foliant.sources import pdf


def a_pdf(*contents, widths=None):
    n = len(contents)
    font = f"<< /Type /Font /FirstChar 32 /Widths [{' '.join(str(w) for w in widths)}] >>" if widths else "<< /Type /Font >>"
    out = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{5 + 2 * i} 0 R' for i in range(n))}] /MediaBox [0 0 500 700] /Resources << /Font << /F1 3 0 R >> >> >>", font, "<< >>"]
    body = b"%PDF-1.4\n" + b"".join(f"{i} 0 obj{o}endobj\n".encode() for i, o in enumerate(out, 1))
    for i, c in enumerate(contents):
        packed = zlib.compress(c.encode())
        body += f"{5 + 2 * i} 0 obj<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>endobj\n{6 + 2 * i} 0 obj<< /Filter /FlateDecode >>stream\n".encode() + packed + b"\nendstream endobj\n"
    return body + b"trailer<< /Root 1 0 R >>"


def rows(*lines):
    """Text at (x, y) in a font of 10."""
    return "BT /F1 10 Tf " + " ".join(f"1 0 0 1 {x} {y} Tm ({t}) Tj" for x, y, t in lines) + " ET"


FORM = rows((50, 650, "Order form"), *[(x, 600 - 20 * r, t) for r, line in enumerate([("Item", "Count", "Price"), ("apple", "2", "1.50"), ("pear", "7", "0.80"), ("plum", "1", "3.10")]) for x, t in zip((50, 200, 350), line)])
PLAIN = rows((50, 600, "Only one line of text"), (50, 580, "and another one"))


def test_words():
    (page,) = pdf.page_rows(a_pdf(rows((50, 600, "ab c")), widths=[250] + [600] * 94))
    assert page["width"] == 500
    assert [(w["text"], round(w["x0"], 3), round(w["x1"], 3), w["top"]) for w in page["words"]] == [("ab", 50, 62, -600), ("c", 64.5, 70.5, -600)]
    (page,) = pdf.page_rows(a_pdf("BT /F1 10 Tf 10 10 Td [(a) -3000 (b) -10 (c)] TJ (d e) Tj ET"))
    assert [(w["text"], round(w["x0"], 3)) for w in page["words"]] == [("a", 10), ("bc", 45), ("d", 55.1), ("e", 65.1)]


def test_forms(spark):
    df = spark.createDataFrame([(1, bytearray(a_pdf(FORM, PLAIN))), (2, bytearray(a_pdf(PLAIN))), (3, bytearray(b"junk")), (4, None)], "document_id int, content binary").withColumn("extension", CV.F.lit(".pdf"))
    got = {r.document_id: r for r in CV.pdf_markdown(df).collect()}
    table = "| Item | Count | Price |\n| --- | --- | --- |\n| apple | 2 | 1.50 |\n| pear | 7 | 0.80 |\n| plum | 1 | 3.10 |"
    assert got[1].form_pages == 1 and got[1].markdown == f"Order form\n\n{table}\n\nOnly one line of text\nand another one"
    assert (got[2].form_pages, got[2].markdown) == (0, "Only one line of text\nand another one")
    assert got[3].markdown is None and got[4].markdown is None
    whole = {r.document_id: r for r in CV.convert(df, forms=True).collect()}
    assert whole[1].markdown == got[1].markdown and whole[2].markdown == got[2].markdown and len(whole) == 4
