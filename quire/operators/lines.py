"""Skew from straight lines: edges by Canny's rule, lines by Hough votes, their mean angle.

The angle of a line is that of its normal, so what counts are strokes that are nearly upright. How edges are
smoothed and thinned and how votes are rounded is a choice of this library; the thresholds, the
suppression and the mean are the rule's.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gradients that begin and that carry on an edge, votes of a line, distance within which only the best line stays.
WEAK, STRONG, VOTES, APART = 50.0, 150.0, 80, 4
#: Degrees that a stroke may lean.
LEAN = 20
SMOOTHING = 1.4


def _convolved(page: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    reach = len(kernel) // 2
    padded = np.pad(page, [(reach, reach) if a == axis else (0, 0) for a in range(2)], mode="edge")
    n = page.shape[axis]
    return sum(k * np.take(padded, range(i, i + n), axis) for i, k in enumerate(kernel))


def edges(page: np.ndarray, weak: float = WEAK, strong: float = STRONG) -> np.ndarray:
    """Where the page has an edge: thin ridges of the gradient that hold a strong pixel."""
    if min(page.shape) < 3:
        return np.zeros(page.shape, bool)
    reach = math.ceil(2 * SMOOTHING)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SMOOTHING**2))
    kernel /= kernel.sum()
    smooth = _convolved(_convolved(page.astype(np.float32), kernel, 0), kernel, 1)
    side, step = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    gx, gy = _convolved(_convolved(smooth, side, 0), step, 1), _convolved(_convolved(smooth, side, 1), step, 0)
    size = np.hypot(gx, gy)
    # A pixel stays if it is no less than its two neighbours along the gradient, in one of four directions.
    sector = np.floor((np.degrees(np.arctan2(gy, gx)) % 180 + 22.5) / 45).astype(int) % 4
    padded = np.pad(size, 1)
    shift = lambda dy, dx: padded[1 + dy : 1 + dy + page.shape[0], 1 + dx : 1 + dx + page.shape[1]]
    thin = np.zeros(page.shape, bool)
    for s, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        thin |= (sector == s) & (size >= shift(dy, dx)) & (size > shift(-dy, -dx))
    able, found = thin & (size >= weak), thin & (size >= strong)
    while True:  # grow along the ridges
        near = np.pad(found, 1)
        rows = near[:-2] | near[1:-1] | near[2:]
        grown = able & (rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:])
        if (grown == found).all():
            return found
        found = grown


def lines(edge: np.ndarray, votes: int = VOTES, apart: int = APART) -> list[tuple[int, int]]:
    """(distance from the corner, degrees of the normal from 0 to 179) of lines with that many edge pixels.

    Of lines within ``apart`` in both, the one with most votes stays; of equals the first.
    """
    y, x = np.nonzero(edge)
    if not len(y):
        return []
    reach = math.ceil(math.hypot(*edge.shape))
    table = np.zeros((2 * reach + 1, 180), np.int64)
    for angle in range(180):
        turn = math.radians(angle)
        at = np.floor(x * math.cos(turn) + y * math.sin(turn) + 0.5).astype(np.int64) + reach
        table[:, angle] = np.bincount(at, minlength=2 * reach + 1)
    out: list[tuple[int, int]] = []
    places = np.argwhere(table >= votes)
    for r, a in places[np.lexsort((places[:, 1], places[:, 0], -table[places[:, 0], places[:, 1]]))].tolist():
        if all(abs(r - r2) > apart or abs(a - a2) > apart for r2, a2 in out):
            out.append((r, a))
    return sorted((r - reach, a) for r, a in out)


def mean_lean(angles: list[int]) -> float | None:
    """The mean of the angles that lean 20 degrees at most, those above 90 taken as negative; None without any."""
    near = [b for a in angles if abs(b := a - 180 if a > 90 else a) <= LEAN]
    return sum(near) / len(near) if near else None


def hough_angle(page: np.ndarray) -> float | None:
    return mean_lean([a for _, a in lines(edges(page))])


def normalised(angle: Column) -> Column:
    return F.when(angle > 90, angle - 180).otherwise(angle)


def mean_skew(found: DataFrame, key: str = "page_id", angle: str = "angle") -> DataFrame:
    """(key, skew): :func:`mean_lean` of lines (key, angle); keys whose lines all lean further have null."""
    near = normalised(F.col(angle))
    return found.groupBy(key).agg(F.avg(F.when(F.abs(near) <= LEAN, near)).alias("skew"))


def deskew_turn(mode: Column, radon: Column, hough: Column) -> Column:
    """Degrees to turn a page by: against the skew of the chosen measure; 0 where there is none or deskew is off."""
    return F.when(mode == "radon", -radon).when(mode == "hough", -F.coalesce(hough, F.lit(0.0))).otherwise(F.lit(0.0))
