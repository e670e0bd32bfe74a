import io
import zipfile
import zlib

from sievelight.operators import chunking
from sievelight.sources import pdf, prepare, scan, sheets


def make_pdf():
    cmap = b"beginbfchar <01> <0041> endbfchar beginbfrange <02> <03> <00e9> endbfrange"
    one = zlib.compress(rb"BT /F1 12 Tf 72 700 Td (Hello \(PDF\) w\366rld) Tj 0 -14 Td [(spa) -300 (ced)] TJ ET")
    two = b"BT /F2 9 Tf <010203> Tj ET"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 7 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] /Resources << /Font << /F2 8 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(one) + one + b"\nendstream", b"<< /Length %d >>\nstream\n" % len(two) + two + b"\nendstream", b"<< /Type /Font >>", b"<< /Type /Font /ToUnicode 9 0 R >>", b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"%%EOF"


def make_xlsx():
    out = io.BytesIO()
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="A#1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>na</t><t>me</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row><c r="B2" s="1"><v>45000</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_pdf_pages():
    assert pdf.pdf_pages(make_pdf()) == ["Hello (PDF) wörld\nspa ced", "Aéê"]


def test_sheets():
    assert list(sheets.read_sheets(make_xlsx())) == [("A#1", [["name", "", "2.5"], ["", "2023-03-15", "TRUE"]])]


def test_prepare_folder(spark, tmp_path):
    for name, data in {"a.md": b"Title\r\n===\nx", "b.py": b"print(1)", "c.pdf": make_pdf(), "d.xlsx": make_xlsx(), "e.bin": b"\0\1", "f": b"plain", "g.pdf": b"broken", "h.docx": b"PK\0"}.items():
        (tmp_path / name).write_bytes(data)
    files = scan.scan_folder(spark, str(tmp_path), contents=True)
    rows = prepare.prepare(files, {"docx": lambda name, data: iter([("page:1", "converted")])}).collect()
    by = {(r.path.rsplit("/", 1)[-1], r.unit_key): (r.text, r.error) for r in rows}
    assert by["a.md", "file"] == ("# Title\nx\n", None) and by["b.py", "file"] == ("```python\nprint(1)\n```\n", None)
    assert by["c.pdf", "page:2"][0] == "Aéê\n" and by["d.xlsx", "sheet:A##1"][0].startswith("| name |  | 2.5 |")
    assert by["e.bin", None][1] == "unsupported" and by["f", "file"][0] == "plain\n" and by["g.pdf", None][1].startswith("ValueError") and by["h.docx", "page:1"][0] == "converted\n"
    units = prepare.prepare(files).where("error is null")
    assert chunking.chunk(units).where("heading_path = array('Title')").count() == 1
