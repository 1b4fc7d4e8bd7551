"""Mail subjects, BIFF numbers, links and form fields: edits in place and the model tables of these families."""

import pytest

from foliant.operators import native as N
from foliant.operators.writers import write_one
from foliant.sources import binary, pdf

from ._files import compound, mp3, pdf_form, record, workbook
from .test_convert import docx, epub, pack, png, pptx


def message(subject="Hello"):
    return compound({"__properties_version1.0": b"\0" * 32, "__substg1.0_0037001F": subject.encode("utf-16-le"), "__substg1.0_1000001F": ("x" * 100).encode("utf-16-le")})


def test_compound_builder_is_read():
    assert binary.mail(message()) == {"sender": None, "to": None, "subject": "Hello", "body": "x" * 100}
    long = "é" * 5000
    assert binary.mail(message(long))["subject"] == long


@pytest.mark.parametrize("n", [5, 70, 5000])
def test_subject_in_place(n):
    data = message("a" * n)
    got = write_one("msg", data, [{"target": "subject", "new": "ü" * n}])
    assert got["status"] == "ok" and binary.mail(got["candidate"]) == binary.mail(data) | {"subject": "ü" * n}
    assert sum(a != b for a, b in zip(got["candidate"], data)) == n and len(got["candidate"]) == len(data)
    refused = lambda new: write_one("msg", data, [{"target": "subject", "new": new}])["reason"]
    assert (refused("a" * n), refused("b" * (n + 1))) == ("no_op_update", "msg.subject.length_mismatch")
    assert write_one("msg", compound({"__substg1.0_0037001E": b"old"}), [{"target": "subject", "new": "new"}])["reason"] == "msg.subject.ansi_unsupported"


@pytest.mark.parametrize("pad", [0, 5000])
def test_numbers_in_place(pad):
    data = compound({"Workbook": workbook((0, 0, 1.5), (0, 1, 2.0), (3, 0, -7.25), pad=pad)})
    got = write_one("xls", data, [{"target": [0, 0, 1], "old": 2.0, "new": 1e300}, {"target": [0, 3, 0], "new": 4}])
    assert got["status"] == "ok"
    assert [(o["row"], o["column"], o["number"]) for o in binary.xls_numbers(got["candidate"])] == [(0, 0, 1.5), (0, 1, 1e300), (3, 0, 4.0)]
    refused = lambda **e: write_one("xls", data, [{"target": [0, 0, 0], "new": 3, **e}])["reason"]
    assert refused(target=[0, 9, 9]) == "xls.cell.not_a_number_record"
    assert refused(new=True) == "invalid_cell_value" and refused(new=1.5) == "no_op_cell_update" and refused(old=9) == "cell_old_value_mismatch"


def test_numbers_refused():
    one = lambda stream: write_one("xls", compound({"Workbook": stream}), [{"target": [0, 0, 0], "new": 3}])["reason"]
    assert one(workbook((0, 0, 1.0), (0, 0, 2.0))) == "xls.cell.duplicate"
    assert one(workbook((0, 0, 1.0), extra=record(0x2F, b"\0" * 6))) == "xls.encrypted"


def test_pdf_links_and_fields():
    data = pdf_form()
    assert [(o["owner"], o["value"], o["reason"]) for o in pdf.text_fields(data)] == [("name", "Ann", None), ("fixed", "F", "pdf.field.read_only")]
    got = write_one("pdf", data, [{"kind": "link", "target": "4", "new": "https://b.example/"}, {"kind": "field", "target": "name", "old": "Ann", "new": "Zoë"}, {"target": "Title", "new": "N"}])
    assert got["status"] == "ok" and got["candidate"].startswith(data)
    assert pdf.links(got["candidate"])[0]["value"] == "https://b.example/" and pdf.text_fields(got["candidate"])[0]["value"] == "Zoë" and pdf.info(got["candidate"]) == {"Title": "N"}
    assert b"/NeedAppearances true" in got["candidate"][len(data) :]
    refused = lambda **e: write_one("pdf", data, [e])["reason"]
    assert refused(kind="field", target="fixed", new="x") == "pdf.field.read_only"
    assert refused(kind="field", target="name", new="too long a name") == "pdf.field.value_not_allowed"
    assert refused(kind="link", target="4", new="javascript:x") == "pdf.link.invalid_uri"
    assert refused(kind="link", target="9", new="https://b.example/") == "target_missing"
    assert write_one("pdf", data.replace(b"/Size 9", b"/Size 9 /Encrypt 9 0 R"), [{"target": "Title", "new": "N"}])["reason"] == "pdf.encrypted"


SOURCES = {"epub": epub(), "zip": pack({"in.zip": pack({"a.csv": "a"}), "x.bin": "x"}), "docx": docx(), "pptx": pptx(), "pdf": pdf_form(), "png": png(), "mp3": mp3(), "msg": message(), "xls": compound({"Workbook": workbook((0, 0, 1.0))})}
#: Values of the first nodes by owner, and read-only reasons.
WANT = {
    "epub": ({"O/p.opf#/package[1]/metadata[1]/dc:title[1]/text()[1]": "Book", "O/a a.xhtml#/html[1]/body[1]/h1[1]/text()[1]": "First"}, set()),
    "zip": ({"in.zip!/a.csv": "csv", "in.zip": "zip"}, {"zip.member.unsupported_format"}),
    "docx": ({"word/document.xml#0": "Abstract", "word/document.xml#table-0": None}, {"docx.paragraph.unsupported_structure"}),
    "pptx": ({"ppt/slides/slide1.xml#0": "below"}, {"pptx.shape.duplicate_id"}),
    "pdf": ({"Title": "T", "4": "https://a.example/x", "name": "Ann"}, {"pdf.field.read_only"}),
    "png": ({"Title": "Hello"}, set()),
    "mp3": ({"title": "Song", "artist": "Who", "album": "Disc"}, set()),
    "msg": ({"subject": "Hello"}, set()),
    "xls": ({"0/0/0": "1"}, set()),
}


@pytest.mark.parametrize("family", list(SOURCES))
def test_model_tables(spark, family):
    df = spark.createDataFrame([(0, bytearray(SOURCES[family])), (1, bytearray(b"no such file")), (2, None)], "document_id int, content binary")
    star = N.READERS[family](df)
    nodes = star["nodes"].collect()
    values, reasons = WANT[family]
    assert {r.document_id for r in nodes} == {0} and len({r.node_id for r in nodes}) == len(nodes)
    assert values.items() <= {r.owner: r.value for r in nodes}.items()
    caps = star["capabilities"].collect()
    assert {r.reason_code for r in caps if r.document_id == 0 and r.state == "read-only"} == reasons
    assert {(r.document_id, r.state, r.reason_code) for r in caps if r.document_id == 1} == {(1, "read-only", f"{family}.source.refused")}
    assert star["documents"].count() == 3


def test_every_family_reads_and_writes():
    from foliant.operators.writers import WRITERS

    assert set(N.READERS) == set(WRITERS)
