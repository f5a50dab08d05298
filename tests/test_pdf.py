from __future__ import annotations

import zlib

import numpy as np
import pytest

from quire.operators import pdf

GREY = np.random.default_rng(3).integers(0, 256, (9, 13)).astype(np.uint8)
BLACK_WHITE = np.where(GREY > 127, 255, 0).astype(np.uint8)


def two_pages() -> pdf.Document:
    return pdf.new_document([(157, 153, pdf.image_stream(GREY), b"q Q"), (200.5, 100, pdf.image_stream(BLACK_WHITE, "ccitt"), b"BT (a \\) b) Tj ET")])


def test_round_trip():
    doc = pdf.load(pdf.save(two_pages()))
    (a, box_a, res_a), (b, box_b, res_b) = doc.pages()
    assert box_a == [0, 0, 157, 153] and box_b == [0, 0, 200.5, 100]
    assert (pdf.pixels(doc, pdf.images(doc, res_a)[0][2]) == GREY).all()
    assert (pdf.pixels(doc, pdf.images(doc, res_b)[0][2]) == BLACK_WHITE).all()
    assert [pdf.has_text(doc.content(p)) for p in (a, b)] == [False, True]


def test_edits_survive():
    doc = two_pages()
    page, _, resources = doc.pages()[0]
    assert pdf.replace_image(doc, resources, pdf.image_stream(255 - GREY))
    pdf.add_layer(doc, page, resources, b"BT /Helvetica 9 Tf 3 Tr (hi) Tj ET")
    pdf.add_archive_metadata(doc)
    doc = pdf.load(pdf.save(doc))
    page, _, resources = doc.pages()[0]
    assert (pdf.pixels(doc, pdf.images(doc, resources)[0][2]) == 255 - GREY).all()
    assert pdf.has_text(doc.content(page)) and b"q Q" in doc.content(page)
    assert "Helvetica" in resources["Font"] and "Font" not in doc.pages()[1][2]
    assert b'pdfaid:part="2"' in doc.get(doc.catalog["Metadata"]).data
    assert doc.get(doc.trailer["Info"])["Producer"] == b"quire"


def test_broken_tables_are_searched():
    data = pdf.save(two_pages())
    cut = data[: data.rindex(b"xref\n0")]
    assert len(pdf.load(cut).pages()) == 2
    moved = data.replace(b"%PDF-1.7\n", b"%PDF-1.7\n% moved by a comment\n")
    assert len(pdf.load(moved).pages()) == 2


def test_object_and_cross_reference_streams():
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 10 20]>>", 3: b"<</Type/Page/Parent 2 0 R>>"}
    head, body = b"", b""
    for n, x in inner.items():
        head, body = head + b"%d %d " % (n, len(body)), body + x + b" "
    packed = zlib.compress(head + body)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n<</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>stream\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    at5 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)]
    table = b"".join(bytes([a]) + b.to_bytes(2) + bytes([c]) for a, b, c in rows)
    filtered, above = b"", bytes(4)
    for i in range(0, len(table), 4):  # PNG filter "up"
        row = table[i : i + 4]
        filtered, above = filtered + b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above)), row
    table = zlib.compress(filtered)
    out += b"5 0 obj\n<</Type/XRef/Size 6/W[1 2 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>/Length %d>>stream\n" % len(table) + table + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at5
    for data in (out, out.replace(b"startxref", b"startxxxx")):
        pages = pdf.load(data + b"\ntrailer<</Root 1 0 R>>").pages()
        assert [box for _, box, _ in pages] == [[0, 0, 10, 20]]  # the parent's box
    again = pdf.load(pdf.save(pdf.load(out)))
    assert len(again.pages()) == 1


def test_syntax():
    x = pdf.Reader(rb"<</A#20B [1 -2.5 .5 true null (a\(b\051\n\\) <414>] /C 7 0 R /D<</E/F>>>> % end").one()
    assert x == {"A B": [1, -2.5, 0.5, True, None, b"a(b)\n\\", b"A@"], "C": pdf.Ref(7, 0), "D": {"E": "F"}}
    assert pdf.Reader(pdf.written(x)).one() == x


def test_text_in_strings_and_inline_images_is_no_operator():
    assert not pdf.has_text(b"(Tj) pop /Tj gs BI /W 1 ID \x00 Tj \x01 EI Q")
    assert pdf.has_text(b"BI /W 1 ID \x00\x01 EI [(a)] TJ") and pdf.has_text(b"(a) '")
    assert not pdf.has_text(b"") and not pdf.has_text(b"<< broken")


@pytest.mark.parametrize("data", [b"", b"junk", b"%PDF-1.4\njunk", b"%PDF-1.4\n1 0 obj\n<</Type"])
def test_bad_files(data):
    with pytest.raises(pdf.PdfError):
        pdf.load(data)


def test_empty_and_encrypted_documents():
    assert pdf.load(pdf.save(pdf.new_document([]))).pages() == []
    data = pdf.save(two_pages()).replace(b"trailer\n<<", b"trailer\n<</Encrypt<<>> ")
    with pytest.raises(pdf.PdfError, match="password required"):
        pdf.load(data)
    with pytest.raises(pdf.PdfError, match="password may be incorrect"):
        pdf.load(data, "x")


def test_image_rules():
    doc = pdf.Document()
    one = lambda **e: pdf.pixels(doc, pdf.Stream({"Width": 4, "Height": 1, "BitsPerComponent": 1} | e, b"\xa0")).tolist()
    assert one() == [[255, 0, 255, 0]]
    assert one(ImageMask=True) == one(Decode=[1, 0]) == [[0, 255, 0, 255]] and one(Decode=[0, 1]) == one()
    with pytest.raises(pdf.PdfError, match="unsupported image filter: JPXDecode"):
        one(Filter=pdf.Name("JPXDecode"))
    with pytest.raises(ValueError, match="bits per component"):
        one(BitsPerComponent=4)
    with pytest.raises(pdf.PdfError, match="no resources"):
        pdf.images(doc, None)
    with pytest.raises(pdf.PdfError, match="more than"):
        pdf.inflated(zlib.compress(bytes(100)), 50)


def test_damaged_files_only_raise_pdf_errors():
    rng = np.random.default_rng(11)
    whole = pdf.save(two_pages())
    for _ in range(1500):
        data = bytearray(whole)
        for at in rng.integers(9, len(data), rng.integers(1, 12)):
            data[at] = rng.choice(np.frombuffer(b"0 9/<>[](R\xff\n", np.uint8))
        if rng.random() < 0.3:
            del data[rng.integers(9, len(data)) :]
        try:
            doc = pdf.load(bytes(data))
        except pdf.PdfError:
            continue
        for page, _, resources in doc.pages():  # neither these nor the text of a page may fail
            pdf.has_text(doc.content(page))
            for _, _, stream in pdf.images(doc, resources or {}):
                try:
                    pdf.pixels(doc, stream)
                except pdf.BROKEN:
                    continue
