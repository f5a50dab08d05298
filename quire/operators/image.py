"""Raster operators on small pages: pixel arrays stay in their row, nothing is shuffled.

Pages have ``width``, ``height`` and ``px`` (array<int>, row-major). Full-size rasters go through
:mod:`quire.operators.raster`, which holds the same rules on numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import raster

NEIGHBOURS = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
#: Share of dark pixels of a page worth binarizing, both ends included.
DARK_RANGE = (0.02, 0.70)


def let(values: list[Column], body: Callable[..., Column]) -> Column:
    """``body`` over values that are computed once a row.

    The optimizer may put a column's expression in every place that names it, lambdas included; a
    one-element transform binds it instead.
    """
    names = [f"v{i}" for i in range(len(values))]
    bound = F.array(F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True))))
    return F.get(F.transform(bound, lambda s: body(*(s[n] for n in names))), 0)


def _total(px: Column) -> Column:
    return F.aggregate(px, F.lit(0).cast("long"), lambda a, v: a + v)


def otsu_level(px: Column) -> Column:
    """The lowest threshold of greatest between-class variance; 0 for a page of one value.

    The variance changes only at values that occur, so those are the only candidates.
    """

    def level(px: Column, n: Column, total: Column) -> Column:
        def candidate(v: Column) -> Column:
            return let([F.filter(px, lambda p: p <= v)], lambda low: let([F.size(low), _total(low)], lambda w, s: loss(v, w, s)))

        def loss(v: Column, w: Column, s: Column) -> Column:
            gap = s.cast("double") / w - (total - s).cast("double") / (n - w)
            return F.struct((-F.when(w < n, w.cast("double") * (n - w).cast("double") * gap * gap).otherwise(0.0)).alias("loss"), v.alias("v"))

        return let([F.array_min(F.transform(F.array_distinct(px), candidate))], lambda best: F.when(best["loss"] < 0, best["v"]).otherwise(0))

    return let([px], lambda p: let([p, F.size(p), _total(p)], level)).cast("int")


def thresholded(px: Column, level: Column) -> Column:
    return let([px, level], lambda p, t: F.transform(p, lambda v: F.when(v > t, 255).otherwise(0)))


def dark_share(px: Column, level: Column) -> Column:
    return let([px, level], lambda p, t: F.when(F.size(p) > 0, F.size(F.filter(p, lambda v: v <= t)) / F.size(p)))


def binarizable(px: Column, level: Column) -> Column:
    return F.coalesce(dark_share(px, level).between(*DARK_RANGE), F.lit(False))


def brightness(px: Column, width: Column, height: Column) -> Column:
    """Mean value, floored by the width and then by the height."""
    return F.floor(F.floor(_total(px) / width) / height).cast("long")


def fast_path(px: Column, width: Column, height: Column) -> Column:
    return (F.greatest(width, height) > 2000) | (brightness(px, width, height) > 200)


def _morph(px: str, width: str, height: str, hit: int) -> Column:
    """Any of the 3x3 neighbourhood equal to ``hit`` gives ``hit``, else the other; the border stays."""

    def page(p: Column, w: Column, h: Column) -> Column:
        def cell(v: Column, i: Column) -> Column:
            x, y = i % w, F.floor(i / w)
            any_hit = F.exists(F.array(*[F.element_at(p, (i + dy * w + dx + 1).cast("int")) for dx, dy in NEIGHBOURS]), lambda q: q == hit)
            inside = (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)
            return F.when(inside, F.when(any_hit, hit).otherwise(255 - hit)).otherwise(v)

        return F.transform(p, cell)

    return let([F.col(px), F.col(width), F.col(height)], page)


def erode(df: DataFrame, px: str = "px", out: str = "px") -> DataFrame:
    return df.withColumn(out, _morph(px, "width", "height", 0))


def dilate(df: DataFrame, px: str = "px", out: str = "px") -> DataFrame:
    return df.withColumn(out, _morph(px, "width", "height", 255))


def open_close(df: DataFrame, px: str = "px") -> DataFrame:
    """Erode, dilate, then dilate, erode."""
    return erode(dilate(dilate(erode(df, px, px), px, px), px, px), px, px)


def morphology(df: DataFrame, level: int, px: str = "px") -> DataFrame:
    for _ in range(max(level // 2, 1)):
        df = open_close(df, px)
    return df


def packed_hex(px: Column, width: Column, height: Column) -> Column:
    """One bit a pixel, most significant first, rows padded to bytes, 1 for black; as hex."""

    def page(p: Column, w: Column, h: Column, stride: Column) -> Column:
        def byte(k: Column) -> Column:
            y, b = F.floor(k / stride).cast("int"), (k % stride).cast("int")
            bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when((b * 8 + j < w) & (F.get(p, (y * w + b * 8 + j).cast("int")) == 0), F.pow(F.lit(2), 7 - j).cast("int")).otherwise(0))
            return F.lpad(F.hex(F.aggregate(bits, F.lit(0), lambda a, v: a + v)), 2, "0")

        return F.when(stride * h > 0, F.array_join(F.transform(F.sequence(F.lit(0), (stride * h - 1).cast("int")), byte), "")).otherwise("")

    return let([px, width, height, F.floor((width + 7) / 8).cast("int")], page)


def unpacked(data_hex: Column, width: int, height: int) -> Column:
    """Pixels of one-bit rows: bit 1 is 255, missing bytes 0, padding bits dropped."""
    stride = (width + 7) // 8

    def bit(data: Column, i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        at = (y * stride + F.floor(x / 8)).cast("int")
        byte = F.coalesce(F.conv(F.substring(data, at * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.lit(0))
        return F.when(F.floor(byte / F.pow(F.lit(2), 7 - x % 8)) % 2 == 1, 255).otherwise(0)

    return let([data_hex], lambda data: F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: bit(data, i)))


def radon_angle(pages: DataFrame) -> DataFrame:
    """page_id, angle (tenths of a degree) of (page_id, width, height, px): the last of the best of 101 directions.

    +5.0 degrees for a page without black. Pages stay in their rows: each is projected on numpy, with a count
    of bins a direction, so its work is one pass a direction and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
            ends = ends - ends[0]
            shapes = zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            angles = [round(10 * raster.radon_angle(flat[start:end].reshape(height, width))) if height * width else 50 for height, width, start, end in shapes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(angles, pa.int32())], names=["page_id", "angle"])

    return pages.select(F.col("page_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), F.col("px").cast("array<int>")).mapInArrow(run, "page_id long, angle int")


def render_dpi(dpi: Column, width_pt: Column, height_pt: Column) -> Column:
    """At most 6000 pixels a side, at least 72 dpi, truncated."""
    return F.greatest(F.least(dpi.cast("double"), F.lit(6000.0 * 72) / F.greatest(width_pt, height_pt)), F.lit(72.0)).cast("int")


def pixel_side(points: Column, dpi: Column) -> Column:
    return F.floor(points * F.least(F.greatest(dpi, F.lit(72)), F.lit(1200)) / 72.0 + 0.5).cast("long")


def scaled_side(side: Column, longest: Column, limit: int) -> Column:
    """A side after shrinking the longest to ``limit``: floored, at least 1."""
    return F.when(longest <= limit, side).otherwise(F.greatest(F.floor(side * (F.lit(float(limit)) / longest)), F.lit(1))).cast("long")
