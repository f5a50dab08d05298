from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import lines, raster


def strokes(lean: float, h: int = 300, w: int = 240) -> np.ndarray:
    """Upright strokes that lean by so many degrees."""
    y, x = np.mgrid[0:h, 0:w]
    along = (x - w / 2) * math.cos(math.radians(lean)) + (y - h / 2) * math.sin(math.radians(lean))
    return np.where(np.abs(along) % 40 < 4, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("lean", [-15, -4, 0, 3, 12])
def test_the_mean_angle_of_strokes(lean):
    assert abs(lines.hough_angle(strokes(lean)) - lean) <= 1


def test_pages_without_lines():
    assert lines.hough_angle(np.full((200, 200), 255, np.uint8)) is None
    assert lines.hough_angle(np.zeros((2, 2), np.uint8)) is None
    assert lines.hough_angle(strokes(90)) is None  # level lines lean too far


def test_votes_by_hand():
    edge = np.zeros((120, 60), bool)
    edge[:, 20] = True
    assert lines.lines(edge) == [(20, 0)]
    edge[:, 22] = True
    edge[:70, 40] = True  # too few votes
    assert lines.lines(edge) == [(20, 0)]  # of near lines one stays
    edge[:, 50] = True
    assert [r for r, _ in lines.lines(edge)] == [20, 50]


def test_edges_are_thin_and_need_a_strong_pixel():
    page = np.full((40, 40), 255, np.uint8)
    page[:, 20:] = 0
    found = lines.edges(page)
    assert found[5:35].sum(1).tolist() == [1] * 30
    assert not lines.edges(np.where(page == 0, 250, 255).astype(np.uint8)).any()


def test_mean_lean():
    assert lines.mean_lean([175, 5, 90, 20, 160]) == (-5 + 5 + 20 - 20) / 4
    assert lines.mean_lean([]) is None and lines.mean_lean([45]) is None


@pytest.mark.parametrize("mode", ["radon", "hough", "disabled"])
def test_deskew_dispatch(mode):
    page = strokes(4)
    made = raster._deskewed(page, mode)
    if mode == "disabled":
        assert (made == page).all()
    else:
        want = -lines.hough_angle(page) if mode == "hough" else -raster.radon_angle(page)
        assert (made == raster.rotate(page, want)).all() and (made != page).any()
    made, _ = raster.preprocessed(page, raster.Settings(deskew_mode="hough", denoise_level=1), fast=False)
    assert abs(lines.hough_angle(made)) < 1.5


def test_mean_skew_of_rows(spark):
    rows = [(1, 175), (1, 5), (1, 20), (2, 45), (3, 0)]
    got = {r.page_id: r.skew for r in lines.mean_skew(spark.createDataFrame(rows, "page_id long, angle int")).collect()}
    assert got == {1: 20 / 3, 2: None, 3: 0.0}
    turn = spark.createDataFrame([("radon", 1.5, 2.5), ("hough", 1.5, 2.5), ("hough", 1.5, None), ("disabled", 1.5, 2.5)], "m string, r double, h double").select(lines.deskew_turn(F.col("m"), F.col("r"), F.col("h")))
    assert [r[0] for r in turn.collect()] == [-1.5, -2.5, 0.0, 0.0]
