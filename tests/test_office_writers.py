"""Cells, paragraphs, styles, boxes and nested members edited in place."""

import io
import re
import zipfile

import pytest

from foliant.operators.writers import write_one
from foliant.sources import office

from .test_convert import REL, W, docx, pack, rels, xlsx

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
CELLS = '<row r="1"><c r="A1" s="3" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"/><c r="B2"><v>1.5</v><extLst/></c><c r="C2" t="e"><v>#N/A</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3"><v>7</v></c></row>'


def book():
    parts = {"_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml")), "xl/workbook.xml": f'<workbook {S} xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "sharedStrings", "sharedStrings.xml"))}
    parts |= {"xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData>{CELLS}</sheetData><mergeCells><mergeCell ref="B3:C3"/></mergeCells></worksheet>', "xl/sharedStrings.xml": f"<sst {S}><si><t>A</t></si><si><r><t>rich</t></r></si></sst>"}
    return pack(parts)


def member(data, name):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(name).decode()


def test_sheet_cells_in_place():
    source = book()
    edits = [{"target": ["One", "A1"], "old": "A", "new": "x < y "}, {"target": ["One", "A2"], "new": 5}, {"target": ["One", "B2"], "old": 1.5, "new": None}, {"target": ["One", "A3"], "old": True, "new": 1}]
    got = write_one("xlsx", source, edits)
    assert (got["status"], got["reason"]) == ("ok", None)
    sheet = member(got["candidate"], "xl/worksheets/sheet1.xml")
    want = CELLS.replace('<c r="A1" s="3" t="s"><v>0</v>', '<c r="A1" s="3" t="inlineStr"><is><t xml:space="preserve">x &lt; y </t></is>').replace('<c r="A2"/>', '<c r="A2"><v>5</v></c>').replace("<v>1.5</v>", "").replace('<c r="A3" t="b">', '<c r="A3" >')
    assert want in sheet
    values = {c["address"]: (c["type"], c["value"]) for c in office.xlsx_cells(got["candidate"])}
    assert values["A1"] == ("string", "x < y ") and values["A2"] == ("int", "5") and values["B2"] == ("null", None) and values["A3"] == ("int", "1")
    for name in ("xl/workbook.xml", "xl/sharedStrings.xml"):
        assert member(source, name) == member(got["candidate"], name)


@pytest.mark.parametrize(
    ("edit", "reason"),
    [
        ({"target": ["Two", "A1"], "new": 1}, "unsupported_sheet_structure"),
        ({"target": ["One", "1A"], "new": 1}, "invalid_edit_payload"),
        ({"target": ["One", "A9"], "new": 1}, "cell_out_of_range"),
        ({"target": ["One", "A1"]}, "missing_typed_cell_value"),
        ({"target": ["One", "A1"], "new": [1]}, "invalid_cell_value"),
        ({"target": ["One", "B1"], "new": 1}, "xlsx.cell.formula_requires_explicit_formula_edit"),
        ({"target": ["One", "B3"], "new": 1}, "xlsx.cell.merged_range"),
        ({"target": ["One", "C1"], "new": 1}, "xlsx.cell.rich_text_requires_run_preserving_edit"),
        ({"target": ["One", "C2"], "new": 1}, "xlsx.cell.unsupported_type"),
        ({"target": ["One", "C3"], "new": 1}, "xlsx.cell.missing_native_cell"),
        ({"target": ["One", "A3"], "old": 1, "new": 2}, "cell_old_value_mismatch"),
        ({"target": ["One", "A3"], "new": True}, "no_op_cell_update"),
    ],
)
def test_sheet_cells_refused(edit, reason):
    got = write_one("xlsx", book(), [edit])
    assert (got["status"], got["reason"], got["candidate"]) == ("refused", reason, None)


def test_sheet_same_cell_twice():
    assert write_one("xlsx", xlsx(), [{"target": ["One", "A2"], "new": 1}, {"target": ["One", "A2"], "new": 2}])["reason"] == "duplicate_cell_coordinate"


def runs():
    body = '<w:p><w:r><w:t xml:space="preserve">one </w:t></w:r><w:r><w:rPr><w:i/><w:u w:val="single"/></w:rPr><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:br/></w:r></w:p><w:p/>'
    return pack({"_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")), "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def test_paragraph_text_keeps_runs():
    part = "word/document.xml"
    edit = lambda **e: write_one("docx", runs(), [{"member": part, "operation": "replace_text", "paragraph": 0, **e}])
    got = edit(old="one two", new="one tw & more")
    assert '<w:t xml:space="preserve">one </w:t></w:r><w:r><w:rPr><w:i/><w:u w:val="single"/></w:rPr><w:t>tw &amp; more</w:t>' in member(got["candidate"], part)
    assert re.sub("<[^>]*>", "", member(edit(new="only")["candidate"], part)) == "onlya"
    assert edit(new="one two")["reason"] == "no_op_update"
    assert edit(old="x", new="y")["reason"] == "old_value_mismatch"
    assert edit(new="a\nb")["reason"] == "paragraph_count_changed"
    assert edit(paragraph=1, new="b")["reason"] == "docx.paragraph.unsupported_structure"
    assert edit(paragraph=2, new="b")["reason"] == "no_style_context"
    assert edit(paragraph=9, new="b")["reason"] == "target_missing"


def test_styles_and_table_cells():
    part = "word/document.xml"
    got = write_one("docx", runs(), [{"member": part, "operation": "set_text_style", "paragraph": 0, "run": 1, "new": {"bold": True, "size": 12, "underline": "none"}}])
    assert '<w:rPr><w:b w:val="1"/><w:i/><w:sz w:val="24"/><w:u w:val="none"/></w:rPr>' in member(got["candidate"], part)
    plain = write_one("docx", runs(), [{"member": part, "operation": "set_text_style", "paragraph": 0, "run": 0, "new": {"italic": True}}])
    assert '<w:r><w:rPr><w:i w:val="1"/></w:rPr><w:t xml:space="preserve">one ' in member(plain["candidate"], part)
    assert write_one("docx", runs(), [{"member": part, "operation": "set_text_style", "paragraph": 0, "run": 5, "new": {"bold": True}}])["reason"] == "run_out_of_range"
    cell = lambda **e: write_one("docx", docx(), [{"member": part, "operation": "update_table_cells", "table": 0, "row": 1, "column": 0, **e}])
    assert "| xx | y |" in office.docx(cell(old="x", new="xx")["candidate"])[0]
    assert cell(row=5, new="q")["reason"] == "cell_out_of_range"


SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:cNvPr id="4" name="n"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>T</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'


def test_shapes():
    data = pack({"s.xml": SLIDE})
    edit = lambda what, new, shape=4: write_one("pptx", data, [{"member": "s.xml", "operation": what, "shape": shape, "new": new}])
    assert member(edit("move_resize", {"x": 1, "y": 9, "width": 3, "height": 8})["candidate"], "s.xml") == SLIDE.replace('y="2"', 'y="9"').replace('cy="4"', 'cy="8"')
    assert '<p:cNvPr descr="a &quot;b&quot;" id="4" name="n"/>' in member(edit("set_alt_text", 'a "b"')["candidate"], "s.xml")
    assert edit("move_resize", {"x": 1, "y": 2, "width": 3, "height": 4})["reason"] == "no_op_geometry_update"
    assert edit("move_resize", {"x": 1, "y": 2, "width": 0, "height": 4})["reason"] == "invalid_size"
    assert edit("move_resize", {"x": 1.5, "y": 2, "width": 3, "height": 4})["reason"] == "invalid_geometry"
    assert edit("set_alt_text", "x", 5)["reason"] == "target_missing"
    style = write_one("pptx", data, [{"member": "s.xml", "operation": "set_text_style", "paragraph": 0, "run": 0, "new": {"bold": True, "underline": "single", "size": 18}}])
    assert '<a:r><a:rPr b="1" u="sng" sz="1800"/><a:t>T' in member(style["candidate"], "s.xml")


def test_archives_in_archives():
    data = pack({"in.zip": pack({"deep.zip": pack({"a.csv": "a,b\n"}), "b.json": "[1]"}), "c.txt": "x"})
    got = write_one("zip", data, [{"member": "in.zip!/deep.zip!/a.csv", "format": "csv", "target": [0, 1], "new": "z"}, {"member": "in.zip!/b.json", "format": "json", "target": "/0", "new": 2}])
    inner = io.BytesIO(got["candidate"])
    with zipfile.ZipFile(inner) as z, zipfile.ZipFile(io.BytesIO(z.read("in.zip"))) as y, zipfile.ZipFile(io.BytesIO(y.read("deep.zip"))) as x:
        assert (x.read("a.csv"), y.read("b.json"), z.read("c.txt")) == (b"a,z\n", b"[2]", b"x")
    assert write_one("zip", data, [{"member": "in.zip!/no.csv", "format": "csv", "target": [0, 0], "new": "z"}])["reason"] == "member_missing"
