from __future__ import annotations

import numpy as np
import pytest

from quire.operators import documents, pdf, raster

GREY = np.random.default_rng(9).integers(0, 256, (6, 5)).astype(np.uint8)


def file_of(*sheets) -> bytes:
    return pdf.save(pdf.new_document([(100, 50, s, b"") for s in sheets]))


@pytest.fixture(scope="session")
def docs(spark):
    rows = [("/a.pdf", bytearray(file_of(pdf.image_stream(GREY), None))), ("/b.pdf", bytearray(b"junk")), ("/c.pdf", None), ("/d.pdf", bytearray(file_of()))]
    return spark.createDataFrame(rows, "path string, content binary")


def test_pages_and_reasons(docs):
    got = sorted((tuple(r) for r in documents.document_pages(docs).collect()), key=repr)
    assert got == [("/a.pdf", 1, 100.0, 50.0, False, 1, None), ("/a.pdf", 2, 100.0, 50.0, False, 0, None), ("/b.pdf", None, None, None, None, None, "not a PDF file"), ("/c.pdf", None, None, None, None, None, "not a PDF file")]


def test_rasters_keep_pages_without_images(docs):
    got = {(r.path, r.page_number): r for r in documents.page_rasters(docs).collect()}
    assert bytes(got["/a.pdf", 1].data) == GREY.tobytes() and got["/a.pdf", 1].source == "embedded"
    assert got["/a.pdf", 2].data is None and got["/a.pdf", 2].error == "no image"


def test_edits(spark, docs):
    new = spark.createDataFrame([("/a.pdf", 1, 4, 2, bytearray(bytes([0, 255] * 4))), ("/a.pdf", 9, 4, 2, bytearray(8)), ("/x.pdf", 1, 1, 1, bytearray(1)), ("/a.pdf", 2, 3, 3, bytearray(1))], "path string, page_number int, width int, height int, data binary")
    layers = spark.createDataFrame([("/a.pdf", 2, "BT (é) Tj ET"), ("/a.pdf", 8, "(x) Tj"), ("/a.pdf", 1, None)], "path string, page_number int, operators string")
    encoded = documents.encoded_images(new)
    assert [r.error is None for r in encoded.orderBy("path", "page_number").collect()] == [True, False, True, True]
    got = {r.path: r for r in documents.edited_documents(docs, encoded, layers, archive=True).collect()}
    assert got["/b.pdf"].content is None and got["/b.pdf"].error == "not a PDF file"
    doc = pdf.load(bytes(got["/a.pdf"].content))
    (one, _, resources), (two, _, _) = doc.pages()
    assert pdf.pixels(doc, pdf.images(doc, resources)[0][2]).tolist() == [[0, 255] * 2] * 2
    assert not pdf.has_text(doc.content(one)) and pdf.has_text(doc.content(two))
    assert "Metadata" in doc.catalog


def test_saved_and_read_again(spark, docs, tmp_path):
    out = docs.selectExpr(f"concat('{tmp_path}', upper(path)) output_path", "content").union(spark.createDataFrame([(f"{tmp_path}/none/x.pdf", bytearray(b"x"))], "output_path string, content binary"))
    got = {r.output_path.rsplit("/", 1)[1]: r for r in documents.save_documents(out).collect()}
    assert got["A.PDF"].error is None and got["C.PDF"].error == "no content" and got["x.pdf"].error
    assert not list(tmp_path.glob("*.part"))
    read = documents.read_documents(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in read.collect()) == ["A.PDF", "B.PDF", "D.PDF"]


def test_adaptive_and_triangle_equal_brute_force():
    h, w = GREY.shape
    for radius in (1, 2, 9):
        square = lambda y, x: GREY[max(y - radius, 0) : y + radius + 1, max(x - radius, 0) : x + radius + 1]
        want = [[255 if int(GREY[y, x]) >= int(square(y, x).sum()) // square(y, x).size else 0 for x in range(w)] for y in range(h)]
        assert raster.adaptive(GREY, radius).tolist() == want
    assert (raster.triangle(GREY, w, h) == GREY).all()
    assert raster.at_most(GREY, 3).shape == (3, 2) and raster.at_most(GREY, 6) is GREY
    flat = np.full((50, 20), 77, np.uint8)
    assert (raster.triangle(flat, 7, 9) == 77).all() and (raster.denoised(flat, 2, side=10) == flat).all()
    ramp = np.repeat(np.arange(0, 160, 10, dtype=np.uint8)[None], 4, 0)
    assert raster.triangle(ramp, 8, 4)[0, 1:-1].tolist() == [25 + 20 * i for i in range(6)]
