"""IMG-1: the preprocess rule, branch by branch, and cleaned files with inks other than 0."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import engine
from quire.operators import image, pdf, raster
from quire.plans.images import preprocessed

RNG = np.random.default_rng(4)
INK = RNG.random((24, 30)) < 0.3
SCAN = np.where(INK, RNG.integers(20, 90, INK.shape), RNG.integers(180, 230, INK.shape)).astype(np.uint8)  # no ink is 0
PALE = np.full((24, 30), 140, np.uint8)
PALE[0, 0] = 20  # too little ink to be worth binarizing
BRIGHT = np.where(INK & (np.arange(30) < 6), 100, 250).astype(np.uint8)


def columns(spark, page):
    return spark.createDataFrame([(1, page.shape[1], page.shape[0], page.ravel().tolist())], "page_id long, width int, height int, px array<int>")


@pytest.mark.parametrize("page", [SCAN, PALE, BRIGHT, np.full((3, 3), 9, np.uint8)])
def test_rules_equal_those_on_columns(spark, page):
    df = columns(spark, page)
    level, px = raster.otsu(page), F.col("px")
    row = df.select(image.otsu_level(px).alias("level"), image.binarizable(px, F.lit(level)).alias("ok"), image.fast_path(px, F.col("width"), F.col("height")).alias("fast")).first()
    assert tuple(row) == (level, raster.binarizable(page, level), raster.fast_path(page))
    binary = raster.thresholded(page, level)
    got = image.morphology(columns(spark, binary), 4).first().px
    assert got == raster.morphology(binary, 4).ravel().tolist()
    assert image.radon_angle(columns(spark, binary)).first().angle == round(raster.radon_angle(binary) * 10)


def test_every_branch():
    how = raster.Settings
    black, bitonal = raster.preprocessed(SCAN, how())
    assert bitonal and (black == np.where(INK, 0, 255)).all()
    black, _ = raster.preprocessed(SCAN, how(binarization="fixed", fixed_threshold=50))
    assert (black == np.where(SCAN > 50, 255, 0)).all()
    black, _ = raster.preprocessed(SCAN, how(binarization="bradley-roth"))
    assert (black == raster.adaptive(SCAN, 11)).all()
    blocks = np.kron(RNG.random((5, 6)) < 0.4, np.ones((16, 16))).astype(bool)
    page = np.where(blocks, 60, 190).astype(np.uint8)
    low = raster.denoised(page, 2)
    opened = raster.morphology(raster.thresholded(low, raster.otsu(low)), 2)
    turned = raster.rotate(opened, -raster.radon_angle(opened))
    whole, bitonal = raster.preprocessed(page, how(denoise_level=2, deskew_mode="radon"), fast=False)
    assert bitonal and (whole == raster.thresholded(turned, raster.otsu(turned))).all()
    assert set(np.unique(whole)) == {0, 255} and abs(raster.radon_angle(opened)) > 0.01
    quick, _ = raster.preprocessed(page, how(denoise_level=2, deskew_mode="radon"), fast=True)
    assert (quick == np.where(blocks, 0, 255)).all()
    grey, bitonal = raster.preprocessed(PALE, how(deskew_mode="radon"))
    assert not bitonal and (grey == raster.rotate(PALE, -raster.radon_angle(PALE))).all()
    flat, _ = raster.preprocessed(SCAN, how(deskew_mode="hough"))
    assert (flat == raster.preprocessed(SCAN, how())[0]).all()  # no lines, no turn
    with pytest.raises(ValueError, match="unknown binarization"):
        how.of({"binarization": "none"})


def test_pages(spark):
    row = preprocessed(columns(spark, SCAN), {"binarization": "fixed", "fixed_threshold": "50"}).first()
    assert row.bitonal and row.px == np.where(SCAN > 50, 255, 0).ravel().tolist()


def test_cleaned_files(spark, tmp_path):
    pages = [(20, 10, pdf.image_stream(p), text) for p, text in ((SCAN, b""), (PALE, b""), (SCAN, b"BT (x) Tj ET"))]
    (tmp_path / "out").mkdir()
    (tmp_path / "a.pdf").write_bytes(pdf.save(pdf.new_document(pages)))
    e = engine.Engine(spark, f"{tmp_path}/engine")
    for options in ({"existing_text": "skip"}, {"binarization": "fixed", "fixed_threshold": 50, "archive": True}, {"deskew_mode": "none"}):
        e.enqueue([f"{tmp_path}/a.pdf"], f"{tmp_path}/out", {"compression": "ccitt"} | options)
    assert e.start_queue(engine.clean_documents) == 3
    jobs = e.get_status().collect()
    assert [j.status for j in jobs] == ["completed", "completed", "failed"] and jobs[2].error_message == "page 1: unknown deskew_mode: none"
    for job, first, third in ((jobs[0], np.where(INK, 0, 255), SCAN), (jobs[1], np.where(SCAN > 50, 255, 0), np.where(SCAN > 50, 255, 0))):
        with open(job.output_path, "rb") as f:
            doc = pdf.load(f.read())
        streams = [pdf.images(doc, resources)[0][2] for _, _, resources in doc.pages()]
        assert [s.entries["Filter"] for s in streams[:2]] == ["CCITTFaxDecode", "FlateDecode"]
        for stream, want in zip(streams, (first, PALE, third), strict=True):
            assert (pdf.pixels(doc, stream) == want).all()
