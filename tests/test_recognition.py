from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import engine
from quire.operators import pdf, recognition


def made_here():
    """A class of this function's, so that it travels to the workers by value."""

    class Bars:
        """Reads upright dark bars as words: w1, w2 and so on; a page of one row is beyond it."""

        def __init__(self, languages):
            self.languages, self.cleared = languages, 0

        def clear(self):
            self.cleared += 1

        def recognise(self, page, psm, dpi):
            if page.shape[0] < 2:
                raise RuntimeError("page too small")
            dark = (page == 0).all(0)
            starts = [x for x in range(len(dark)) if dark[x] and (x == 0 or not dark[x - 1])]
            return [recognition.Word(f"{self.languages[0]}{n}", x, 0, x + 2, page.shape[0], 90.0 if n < 3 else 10.0) for n, x in enumerate(starts)]

    return Bars


Bars = made_here()
PAGE = np.full((20, 60), 255, np.uint8)
PAGE[:, [5, 6, 15, 16, 25, 26, 35, 36]] = 0


def test_recognisers_are_kept_by_language():
    recognition._pool.clear()
    for code in ("eng", "eng", "deu"):
        words = recognition.recognised(PAGE, Bars, (code,))
        assert [w.text for w in words] == [f"{code}{n}" for n in range(4)]
    assert [k[1] for k in recognition._pool] == [("eng",), ("deu",)]
    assert next(iter(recognition._pool.values())).cleared == 2
    recognition.recognised(PAGE, Bars, ("fra",))
    assert [k[1] for k in recognition._pool] == [("deu",), ("fra",)]
    with pytest.raises(recognition.RecognitionError, match="page too small"):
        recognition.recognised(PAGE[:1], Bars, ("fra",))
    assert [k[1] for k in recognition._pool] == [("deu",)]  # one that failed isn't used again
    with pytest.raises(recognition.RecognitionError, match="no recogniser"):
        recognition.recognised(PAGE, lambda languages: recognition.Absent(), ("eng",))
    assert recognition.languages_of("eng+deu+eng") == ("eng", "deu") and recognition.languages_of(None) == ("eng",)


def test_a_document_gets_its_text_layer(spark, tmp_path):
    sheets = [(60, 20, pdf.image_stream(PAGE), b""), (60, 20, None, b"")]
    (tmp_path / "scan.pdf").write_bytes(pdf.save(pdf.new_document(sheets)))
    (tmp_path / "tiny.pdf").write_bytes(pdf.save(pdf.new_document([(60, 20, pdf.image_stream(PAGE[:1]), b"")])))
    (tmp_path / "out").mkdir()
    e = engine.Engine(spark, f"{tmp_path}/engine")
    e.enqueue([f"{tmp_path}/scan.pdf", f"{tmp_path}/tiny.pdf"], f"{tmp_path}/out", {"compression": "ccitt", "languages": "deu"})
    assert e.start_queue(engine.with_recogniser(Bars)) == 2
    done = {r.output_path.rsplit("/", 1)[1]: r for r in e.get_status().collect()}
    assert (done["scan_cleaned.pdf"].status, done["tiny_cleaned.pdf"].status) == ("completed", "failed")
    assert done["tiny_cleaned.pdf"].error_message == "page 1: recognition: page too small"
    doc = pdf.load((tmp_path / "out/scan_cleaned.pdf").read_bytes())
    pages = [doc.content(p) for p, _, _ in doc.pages()]
    assert [pages[0].count(f"<{f'deu{n}'.encode().hex()}>".encode()) + pages[0].count(f"(deu{n})".encode()) for n in range(4)] == [1, 1, 1, 0]
    assert pdf.has_text(pages[0]) and not pdf.has_text(pages[1])

    told = {}
    for r in e.events().orderBy("at_ms").collect():
        told.setdefault(r.channel, []).append(r)
    assert set(told) == {"queueState", "pipelineProgress", "jobProgress", "jobFinished", "historyUpdated"}
    assert {json.loads(r.payload)["status"] for r in told["jobFinished"]} == {"completed", "failed"} and len(told["historyUpdated"]) == 2


def test_text_and_layers(spark):
    rows = [("p", 1, 100.0, 50.0, 200, 100, n, t, 10 * n, 20, 10 * n + 8, 30, c) for n, (t, c) in enumerate([("one", 90.0), ("(two)", 30.0), (" ", 99.0), ("low", 29.9)])]
    words = spark.createDataFrame(rows, "path string, page_number int, page_w double, page_h double, image_w int, image_h int, idx int, text string, left int, top int, right int, bottom int, confidence double")
    assert recognition.page_text(words).first()["text"] == "one (two)   low"
    layer = recognition.layers(words).first()["operators"]
    assert layer.count("Tj") == 2 and r"(\(two\)) Tj" in layer and "1 0 0 1 5 35 Tm" in layer
    assert recognition.layers(words.filter("text = ' '")).count() == 0


def test_language_packs(spark, tmp_path):
    e = engine.Engine(spark, f"{tmp_path}/engine")
    folder = f"{tmp_path}/data"
    assert e.ensure_language_packs([], folder) == {"downloaded": [], "skipped": [], "errors": {}}
    have = {("deu", "fast"): b"x" * 99, ("deu", "standard"): b"d" * 500, ("fra", "fast"): b"f" * 100}

    def fetch(code, kind):
        if code == "ita":
            raise OSError("unreachable")
        return have.get((code, kind))

    got = e.ensure_language_packs(["deu", "fra", "spa", "ita", "../x"], folder, fetch)
    assert got == {"downloaded": ["deu", "fra"], "skipped": [], "errors": {"spa": "no source has this language", "ita": "unreachable", "../x": "not a language code"}}
    assert (tmp_path / "data/deu.traineddata").read_bytes() == b"d" * 500
    assert e.ensure_language_packs(["deu", "spa"], folder)["skipped"] == ["deu"]


def test_failures_are_told_by_kind(spark):
    rows = [("password required",), ("recognition: x",), ("render: y",), ("no such file: z",), ("no catalog",)]
    got = [r[0] for r in spark.createDataFrame(rows, "e string").select(engine.failure(F.col("e"))).collect()]
    assert got == ["Encrypted PDF: password required", "OCR FFI error: recognition: x", "PDFium error: render: y", "I/O error: no such file: z", "PDF parse error: no catalog"]
