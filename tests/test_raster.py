from __future__ import annotations

import numpy as np
import pytest

from quire.operators import raster

PAGE = np.random.default_rng(5).integers(0, 256, (17, 23)).astype(np.uint8)


@pytest.mark.parametrize("radius", [0, 1, 3])
@pytest.mark.parametrize("block", [1, 32_000_000])
def test_median_equals_brute_force(monkeypatch, radius, block):
    monkeypatch.setattr(raster, "MEDIAN_BLOCK", block)
    h, w = PAGE.shape
    want = [[sorted(PAGE[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)] for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))[(2 * radius + 1) ** 2 // 2] for x in range(w)] for y in range(h)]
    assert raster.median(PAGE, radius).tolist() == np.array(want).tolist()


def test_nearest_keeps_and_repeats():
    assert (raster.nearest(PAGE, 23, 17) == PAGE).all()
    assert (raster.nearest(PAGE, 46, 34) == PAGE.repeat(2, 0).repeat(2, 1)).all()


def test_rotation():
    assert (raster.rotate(PAGE, 0.009) == PAGE).all()
    square = np.full((40, 40), 90, np.uint8)
    turned = raster.rotate(square, 5)
    assert turned[20, 20] == 90 and turned[0, 0] == 255
    half = raster.rotate(PAGE, 180)  # pixel (x, y) comes from (w - x, h - y)
    assert (half[2:, 2:] == PAGE[::-1, ::-1][1:-1, 1:-1]).all()


def test_flate_round_trip_and_bounds():
    h, w = PAGE.shape
    assert (raster.inflate(raster.flate(PAGE), w, h) == PAGE).all()
    bits = np.packbits(PAGE > 127, axis=1)
    assert (raster.inflate(raster.flate(bits), w, h, 1) == np.where(PAGE > 127, 255, 0)).all()
    assert raster.inflate(raster.flate(np.zeros(10**6, np.uint8)), 4, 4).shape == (4, 4)  # no more than the page holds
    assert raster.inflate(raster.flate(PAGE[:1]), w, 2)[1].sum() == 0
    with pytest.raises(ValueError):
        raster.inflate(b"", 1, 1, 4)


def test_over_pages(spark):
    rows = [(1, 23, 17, bytearray(PAGE.tobytes())), (2, 5, 5, bytearray(b"short")), (3, 1, 1, None)]
    got = {r.page_id: r for r in raster.over_pages(spark.createDataFrame(rows, "page_id long, width int, height int, data binary"), lambda p: raster.nearest(p, 46, 34)).collect()}
    assert (got[1].width, got[1].height, len(got[1].data), got[1].error) == (46, 34, 46 * 34, None)
    assert got[2].data is None and got[2].error and got[3].data is None and got[3].error is None
