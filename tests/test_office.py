import io
import zipfile
import zlib

import pytest

from quarrymill.sources import office, readers

W = 'xmlns:w="http://w"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", data)
    return out.getvalue()


def pdf(*pages, info=b""):
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages))) + b"]/Resources<</Font<</F1 4 0 R>>>>>>", b"<<" + info + b">>", b"<</Type/Font/Subtype/Type1>>"]
    for i, content in enumerate(pages):
        packed = zlib.compress(content)
        objects += [b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (6 + 2 * i), b"<</Filter/FlateDecode/Length %d>>stream\n" % len(packed) + packed + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1)) + b"trailer<</Root 1 0 R/Info 3 0 R>>"


CORE = '<c xmlns:dc="http://dc"><dc:title>Plan</dc:title><dc:creator>Amt</dc:creator></c>'
DOCX = zipped(word__document=f"<w:document {W}><w:body><w:p><w:r><w:t>Erster </w:t></w:r><w:r><w:t>Satz</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", docProps__core=CORE)
XLSX = zipped(xl__workbook="<w/>", xl__sharedStrings="<s><si><t>Ort</t></si></s>", xl__worksheets__sheet1='<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row/></w>')
PPTX = zipped(ppt__presentation="<p/>", ppt__slides__slide2='<p xmlns:a="http://a"><a:p><a:r><a:t>zwei</a:t></a:r></a:p></p>', ppt__slides__slide1='<p xmlns:a="http://a"><a:p><a:r><a:t>eins</a:t></a:r></a:p></p>')
ODT = zipped(content='<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h>Kopf</text:h><text:p>Ein <text:span>roter</text:span> Faden</text:p></o>')


def test_office_formats():
    text, meta = office.read(DOCX)
    assert text.startswith("Erster Satz") and "a" in text and "b" in text and meta == {"title": "Plan", "author": "Amt"}
    assert office.read(XLSX)[0] == "Ort\t7"
    assert office.read(PPTX)[0] == "eins\nzwei"
    assert office.read(ODT)[0] == "Kopf\nEin roter Faden"


def test_pdf():
    pages = [rb"BT /F1 12 Tf 50 700 Td (Erste \(1\) Zeile) Tj 0 -14 Td [(Zwei)-300(Worte)20(n)] TJ ET", rb"BT /F1 9 Tf 1 0 0 1 5 5 Tm <53E46765> Tj T* (ein\145) Tj ET"]
    text, meta = office.read(pdf(*pages, info=b"/Title(Plan A)/Author<FEFF00C4>"))
    assert text == "Erste (1) Zeile\nZwei Worten\fSäge\neine"
    assert meta == {"title": "Plan A", "author": "Ä"}


def test_pdf_letters_by_table():
    table = zlib.compress(b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange")
    raw = pdf(b"BT /F1 1 Tf <0001000200030004> Tj ET").replace(b"<</Type/Font/Subtype/Type1>>", b"<</Type/Font/Subtype/Type0/ToUnicode 9 0 R>>")
    raw = raw.replace(b"trailer", b"9 0 obj<</Filter/FlateDecode>>stream\n" + table + b"\nendstream\nendobj\ntrailer")
    assert office.read(raw)[0] == "Abcd"


def test_other_contents():
    assert office.read("Grüße".encode())[0] == "Grüße"
    assert office.read(b"<html><title>T &amp; U</title><p>x</p></html>") == ("T & U x", {"title": "T & U"})
    for broken in (b"PK\x03\x04xx", zipped(a="<a/>"), b"\x00\x01binary", b"\xff\xfe\xfa", pdf(b"") + b"/Encrypt", None, zipped(word__document="<!DOCTYPE x><w/>")):
        with pytest.raises(ValueError):  # noqa: PT011
            office.read(broken)


def test_as_parser(spark):
    rows = [("/a/b.docx", bytearray(DOCX)), ("/a/c.bin", bytearray(b"\x00")), ("/a/d.txt", None)]
    got = {r["path"]: r for r in readers.parse(spark.createDataFrame(rows, "path string, content binary"), office.read).collect()}
    assert got["/a/b.docx"]["text"].startswith("Erster Satz") and got["/a/b.docx"]["meta"]["title"] == "Plan"
    assert got["/a/c.bin"]["text"] is None and got["/a/d.txt"]["text"] is None
