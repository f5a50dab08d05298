"""Full-size rasters: numpy rules on one page at a time, and the codecs of page streams.

A page is a two-dimensional uint8 array. :func:`over_pages` runs a rule over a DataFrame of pages
(width, height, data) in Arrow batches, so rasters stay in their row and nothing is shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators import lines

#: Values that a median block holds at most; bounds the memory of a large page.
MEDIAN_BLOCK = 32_000_000
LEAST_TURN = 0.01
#: Pixels of a page at most, whatever size a file claims.
MAX_PIXELS = 256 * 1024 * 1024
#: Share of dark pixels of a page worth binarizing, both ends included.
DARK_RANGE = (0.02, 0.70)


def median(page: np.ndarray, radius: int) -> np.ndarray:
    """Each pixel becomes the median of its (2 * radius + 1) square; the edge repeats outwards."""
    side = 2 * radius + 1
    if not radius or not page.size:
        return page.copy()
    padded, out = np.pad(page, radius, mode="edge"), np.empty_like(page)
    step = max(1, MEDIAN_BLOCK // (page.shape[1] * side * side))
    for y in range(0, page.shape[0], step):
        windows = np.lib.stride_tricks.sliding_window_view(padded[y : min(y + step, page.shape[0]) + 2 * radius], (side, side))
        flat = windows.reshape(*windows.shape[:2], side * side)
        out[y : y + step] = np.partition(flat, side * side // 2, axis=-1)[..., side * side // 2]
    return out


def denoise_radius(level: int) -> int:
    return 3 if level <= 2 else 5


def nearest(page: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled to the pixel that lies under each new centre."""
    rows = np.minimum(((np.arange(height) + 0.5) * page.shape[0] / height).astype(int), page.shape[0] - 1)
    columns = np.minimum(((np.arange(width) + 0.5) * page.shape[1] / width).astype(int), page.shape[1] - 1)
    return page[np.ix_(rows, columns)]


def rotate(page: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned about its centre, bilinear; what comes from outside is ``fill``; small angles change nothing."""
    if abs(degrees) < LEAST_TURN:
        return page.copy()
    h, w = page.shape
    turn, cx, cy = math.radians(degrees), w / 2, h / 2
    y, x = np.mgrid[0:h, 0:w]
    sx = math.cos(turn) * (x - cx) + math.sin(turn) * (y - cy) + cx
    sy = -math.sin(turn) * (x - cx) + math.cos(turn) * (y - cy) + cy
    # A whole coordinate is off by rounding after sine and cosine.
    sx, sy = np.round(sx, 9), np.round(sy, 9)
    left, top = np.floor(sx).astype(int), np.floor(sy).astype(int)
    inside = (left >= 0) & (top >= 0) & (left + 1 < w) & (top + 1 < h)
    left, top = np.where(inside, left, 0), np.where(inside, top, 0)
    right, low, fx, fy = np.minimum(left + 1, w - 1), np.minimum(top + 1, h - 1), sx - left, sy - top
    upper = page[top, left] * (1 - fx) + page[top, right] * fx
    lower = page[low, left] * (1 - fx) + page[low, right] * fx
    return np.where(inside, np.floor(upper * (1 - fy) + lower * fy + 0.5), fill).astype(np.uint8)


def flate(page: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(page).tobytes(), 9)


def unpacked(raw: bytes, width: int, height: int, bits: int = 8) -> np.ndarray:
    """Rows of one (set: 255) or eight bits a pixel; missing bytes are 0, further ones ignored."""
    if bits not in (1, 8):
        raise ValueError(f"unsupported bits per component: {bits}")
    if width * height > MAX_PIXELS:
        raise ValueError(f"page too large: {width}x{height}")
    stride = width if bits == 8 else (width + 7) // 8
    rows = np.frombuffer(raw[: stride * height].ljust(stride * height, b"\0"), np.uint8).reshape(height, stride)
    return rows.copy() if bits == 8 else np.unpackbits(rows, axis=1)[:, :width] * np.uint8(255)


def inflate(data: bytes, width: int, height: int, bits: int = 8) -> np.ndarray:
    """:func:`unpacked` of deflated rows, inflated to what the page can hold and no further."""
    most = (width if bits == 8 else (width + 7) // 8) * height
    try:
        return unpacked(zlib.decompressobj().decompress(data, most) if 0 < most <= MAX_PIXELS else b"", width, height, bits)
    except zlib.error as e:
        raise ValueError(f"flate: {e}") from e


def over_pages(pages: DataFrame, rule: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """page_id, width, height, data, error: ``rule`` on every page of (page_id, width, height, data).

    A page whose data doesn't fit its size, or on which the rule fails, keeps its row, with the
    reason in ``error`` and null data; null data stays null.
    """
    schema = pa.schema([("page_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary()), ("error", pa.string())])

    def one(page_id: int, width: int, height: int, data: bytes | None) -> dict:
        row = {"page_id": page_id, "width": width, "height": height, "data": None, "error": None}
        if data is None:
            return row
        try:
            made = rule(np.frombuffer(data, np.uint8).reshape(height, width))
        except (TypeError, ValueError) as e:
            return row | {"error": str(e)}
        return row | {"width": made.shape[1], "height": made.shape[0], "data": made.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one page at a time: a page may be 36 MB
                yield pa.RecordBatch.from_pylist([one(*(batch.column(i)[at].as_py() for i in range(4)))], schema=schema)

    return pages.selectExpr("CAST(page_id AS long) page_id", "CAST(width AS int) width", "CAST(height AS int) height", "data").mapInArrow(run, "page_id long, width int, height int, data binary, error string")


def adaptive(page: np.ndarray, radius: int) -> np.ndarray:
    """White where a pixel is at least the whole mean of its square, which the edge cuts."""
    h, w = page.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = page.astype(np.int64).cumsum(0).cumsum(1)
    y, x = np.arange(h), np.arange(w)
    top, low = np.maximum(y - radius, 0), np.minimum(y + radius + 1, h)
    left, right = np.maximum(x - radius, 0), np.minimum(x + radius + 1, w)
    s = total[np.ix_(low, right)] - total[np.ix_(top, right)] - total[np.ix_(low, left)] + total[np.ix_(top, left)]
    return np.where(page >= s // np.outer(low - top, right - left), 255, 0).astype(np.uint8)


def adaptive_radius(level: int) -> int:
    return max(level, 1) * 4 + 7


def _triangle(size: int, to: int) -> np.ndarray:
    """Weights (to, size) of a triangle as wide as the step between new centres."""
    step = size / to
    reach = max(step, 1.0)
    centre = (np.arange(to) + 0.5) * step - 0.5
    weights = np.maximum(1 - np.abs(np.arange(size)[None, :] - centre[:, None]) / reach, 0)
    return weights / weights.sum(axis=1, keepdims=True)


def triangle(page: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled with a triangle filter, rows first."""
    made = _triangle(page.shape[0], height) @ page.astype(float) @ _triangle(page.shape[1], width).T
    return np.floor(np.clip(made, 0, 255) + 0.5).astype(np.uint8)


def at_most(page: np.ndarray, side: int) -> np.ndarray:
    """Scaled down so that neither side is longer than ``side``."""
    h, w = page.shape
    if max(h, w) <= side:
        return page
    scale = side / max(h, w)
    return triangle(page, max(int(w * scale), 1), max(int(h * scale), 1))


def denoised(page: np.ndarray, level: int, side: int = 1200) -> np.ndarray:
    """The median ``level`` times on a copy of at most ``side`` pixels, scaled back."""
    small = at_most(page, side)
    for _ in range(level):
        small = median(small, denoise_radius(level))
    return small if small.shape == page.shape else triangle(small, page.shape[1], page.shape[0])


def otsu(page: np.ndarray) -> int:
    """The lowest threshold of greatest between-class variance; 0 for a page of one value."""
    counts = np.bincount(page.ravel(), minlength=256).astype(np.int64)
    w, s = counts.cumsum(), (counts * np.arange(256)).cumsum()
    at = np.flatnonzero((w > 0) & (w < w[-1]))
    if not len(at):
        return 0
    low, high = w[at].astype(float), (w[-1] - w[at]).astype(float)
    gap = s[at] / low - (s[-1] - s[at]) / high
    variance = low * high * gap * gap
    return int(at[variance.argmax()]) if variance.max() > 0 else 0


def thresholded(page: np.ndarray, level: int) -> np.ndarray:
    return np.where(page > level, 255, 0).astype(np.uint8)


def binarizable(page: np.ndarray, level: int) -> bool:
    return bool(page.size) and DARK_RANGE[0] <= np.count_nonzero(page <= level) / page.size <= DARK_RANGE[1]


def fast_path(page: np.ndarray) -> bool:
    """Pages longer than 2000 pixels a side, or brighter than 200, skip median, morphology and deskew."""
    h, w = page.shape
    return max(h, w) > 2000 or int(page.sum(dtype=np.int64)) // max(w, 1) // max(h, 1) > 200


def _morph(page: np.ndarray, hit: int) -> np.ndarray:
    """Any of the 3x3 neighbourhood equal to ``hit`` gives ``hit``, else the other; the border stays."""
    h, w = page.shape
    out = page.copy()
    if h < 3 or w < 3:
        return out
    near = page == hit
    rows = near[:-2] | near[1:-1] | near[2:]
    out[1:-1, 1:-1] = np.where(rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:], hit, 255 - hit)
    return out


def morphology(page: np.ndarray, level: int, side: int = 1200) -> np.ndarray:
    """Erode, dilate, dilate, erode ``level // 2`` times (once at least) on a copy of at most ``side`` pixels, scaled back."""
    small = at_most(page, side)
    for _ in range(max(level // 2, 1)):
        for hit in (0, 255, 255, 0):
            small = _morph(small, hit)
    return small if small.shape == page.shape else triangle(small, page.shape[1], page.shape[0])


def radon_angle(page: np.ndarray, side: int = 800) -> float:
    """Degrees of the last of the best of 101 directions, by the black pixels of a copy of at most ``side`` pixels."""
    h, w = page.shape
    if max(h, w) > side:
        scale = side / max(h, w)
        page = nearest(page, max(int(w * scale), 1), max(int(h * scale), 1))
        h, w = page.shape
    if not page.size:
        return 0.0
    y, x = np.nonzero(page == 0)
    reach = math.sqrt(w * w + h * h) / 2
    bins = math.ceil(reach) * 2 + 1
    best = (-1, 0)
    for angle in range(-50, 51):
        turn = math.radians(angle * 0.1)
        r = (x - w / 2) * math.cos(turn) + (y - h / 2) * math.sin(turn)
        at = np.floor((r + reach) / (2 * reach) * (bins - 1) + 0.5).astype(np.int64)
        counts = np.bincount(at[(at >= 0) & (at < bins)], minlength=bins)
        best = max(best, (int((counts * counts).sum()), angle))
    return best[1] * 0.1


class Settings(NamedTuple):
    """How a page is cleaned; what a job doesn't name is off."""

    binarization: str = "otsu"
    fixed_threshold: int = 128
    denoise_level: int = 0
    deskew_mode: str = "disabled"

    @classmethod
    def of(cls, options: dict[str, str]) -> Settings:
        given = {k: type(cls._field_defaults[k])(v) for k, v in options.items() if k in cls._fields}
        made = cls(**given)
        for name, value, allowed in (("binarization", made.binarization, ("otsu", "bradley-roth", "fixed")), ("deskew_mode", made.deskew_mode, ("radon", "hough", "disabled"))):
            if value not in allowed:
                raise ValueError(f"unknown {name}: {value}")
        for name, value in (("fixed_threshold", made.fixed_threshold), ("denoise_level", made.denoise_level)):
            if not 0 <= value <= 255:
                raise ValueError(f"{name} out of range: {value}")
        return made


def _binarized(page: np.ndarray, how: Settings) -> np.ndarray:
    if how.binarization == "bradley-roth":
        return adaptive(page, adaptive_radius(how.denoise_level))
    return thresholded(page, how.fixed_threshold if how.binarization == "fixed" else otsu(page))


def _deskewed(page: np.ndarray, mode: str) -> np.ndarray:
    """Turned against the skew of the chosen measure; without one, or without lines, as it was."""
    angle = radon_angle(page) if mode == "radon" else lines.hough_angle(page) if mode == "hough" else None
    return page if angle is None else rotate(page, -angle)


def preprocessed(page: np.ndarray, how: Settings, fast: bool | None = None) -> tuple[np.ndarray, bool]:
    """The cleaned page, and whether it is black (0) and white (255) or, not binarizable, grey."""
    fast = fast_path(page) if fast is None else fast
    noisy = not fast and how.denoise_level > 0
    page = denoised(page, how.denoise_level) if noisy else page
    bitonal = binarizable(page, otsu(page))
    if bitonal:
        page = _binarized(page, how)
        page = morphology(page, how.denoise_level) if noisy else page
    page = page if fast else _deskewed(page, how.deskew_mode)
    return (thresholded(page, otsu(page)) if bitonal else page), bitonal
