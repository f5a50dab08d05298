"""Image and stream-decoding queries, on the 8x8 pages that ``embeddings`` stand for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.adapters import PAGES_SQL, PIXELS_SQL, grey_pages, table
from quire.operators import image, raster
from quire.plans.registry import query

OTSU_SQL = PIXELS_SQL + """, hist AS (SELECT page_id, g, count(*) AS n FROM pix GROUP BY ALL),
cum AS (SELECT page_id, g, sum(n) OVER w AS wb, sum(n * g) OVER w AS sb, sum(n) OVER p AS t, sum(n * g) OVER p AS st FROM hist
  WINDOW w AS (PARTITION BY page_id ORDER BY g ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY page_id)),
vr AS (SELECT page_id, g, CASE WHEN wb < t THEN CAST(wb AS DOUBLE) * CAST(t - wb AS DOUBLE) * (CAST(sb AS DOUBLE) / wb - CAST(st - sb AS DOUBLE) / (t - wb)) * (CAST(sb AS DOUBLE) / wb - CAST(st - sb AS DOUBLE) / (t - wb)) ELSE 0 END AS v FROM cum),
otsu AS (SELECT page_id, CAST(CASE WHEN max(v) > 0 THEN arg_max(g, (v, -g)) ELSE 0 END AS INTEGER) AS level FROM vr GROUP BY page_id)"""
BIN_SQL = OTSU_SQL + ", bin AS (SELECT page_id, i, CASE WHEN g > level THEN 255 ELSE 0 END AS b FROM pix JOIN otsu USING (page_id))"


def _text(px: str) -> F.Column:
    return F.array_join(F.transform(px, lambda v: v.cast("string")), ",")


def with_level(spark: SparkSession, d: str) -> DataFrame:
    return grey_pages(spark, d).withColumn("level", image.otsu_level(F.col("px")))


def binarized(spark: SparkSession, d: str) -> DataFrame:
    return with_level(spark, d).withColumn("bin", image.thresholded(F.col("px"), F.col("level")))


def preprocessed(pages: DataFrame, options: dict[str, str]) -> DataFrame:
    """page_id, width, height, px, bitonal: the preprocess rule on whole pages; options as in :class:`raster.Settings`."""
    how = raster.Settings.of(options)
    schema = pa.schema([("page_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("px", pa.list_(pa.int32())), ("bitonal", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, width, height, px in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, bitonal = raster.preprocessed(np.array(px, np.uint8).reshape(height, width), how)
                rows.append((page_id, page.shape[1], page.shape[0], page.ravel().tolist(), bitonal))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "px").mapInArrow(run, "page_id long, width int, height int, px array<int>, bitonal boolean")


@query("img02_histogram", f"WITH {PIXELS_SQL} SELECT page_id, CAST(g AS INTEGER) AS g, count(*) AS n FROM pix GROUP BY ALL")
def _(spark, d):
    return grey_pages(spark, d).select("page_id", F.explode("px").alias("g")).groupBy("page_id", "g").agg(F.count("*").alias("n"))


@query("img03_otsu", f"WITH {OTSU_SQL} SELECT page_id, level FROM otsu")
def _(spark, d):
    return with_level(spark, d).select("page_id", "level")


@query("img04_threshold", f"WITH {BIN_SQL} SELECT page_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) AS px FROM bin GROUP BY page_id")
def _(spark, d):
    return binarized(spark, d).select("page_id", _text("bin").alias("px"))


@query("img05_fixed_threshold", f"WITH {PIXELS_SQL} SELECT page_id, string_agg(CASE WHEN g > 128 THEN '255' ELSE '0' END, ',' ORDER BY i) AS px FROM pix GROUP BY page_id")
def _(spark, d):
    return grey_pages(spark, d).select("page_id", _text(image.thresholded(F.col("px"), F.lit(128))).alias("px"))


@query("flt05_binarizable", f"WITH {BIN_SQL} SELECT page_id, avg(CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END) BETWEEN 0.02 AND 0.7 AS binarizable FROM bin GROUP BY page_id")
def _(spark, d):
    return with_level(spark, d).select("page_id", image.binarizable(F.col("px"), F.col("level")).alias("binarizable"))


@query("flt06_fast_path", f"WITH {PIXELS_SQL}, s AS (SELECT page_id, CAST(sum(CASE WHEN page_id % 2 = 1 THEN least(g + 80, 255) ELSE g END) AS BIGINT) AS s FROM pix GROUP BY page_id) SELECT page_id, s // 8 // 8 AS brightness, s // 8 // 8 > 200 AS fast FROM s")
def _(spark, d):
    p = grey_pages(spark, d).withColumn("px", F.when(F.col("page_id") % 2 == 1, F.transform("px", lambda v: F.least(v + 80, F.lit(255)))).otherwise(F.col("px")))
    args = F.col("px"), F.col("width"), F.col("height")
    return p.select("page_id", image.brightness(*args).alias("brightness"), image.fast_path(*args).alias("fast"))


@query("ag06_pixel_sums", f"WITH {PIXELS_SQL} SELECT page_id, CAST(sum(g) AS BIGINT) AS total, count(*) FILTER (g <= 100) AS dark FROM pix GROUP BY page_id")
def _(spark, d):
    return grey_pages(spark, d).select("page_id", F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.size(F.filter("px", lambda v: v <= 100)).cast("long").alias("dark"))


def _morph_sql(start: str, steps: list[str]) -> str:
    """Chained 3x3 steps over a CTE (page_id, i, b) named ``start``."""
    out, last = "", start
    for n, step in enumerate(steps):
        hit = 0 if step == "erode" else 255
        out += f""", m{n} AS (SELECT c.page_id, c.i, CASE WHEN c.i % 8 IN (0, 7) OR c.i // 8 IN (0, 7) THEN any_value(c.b)
          WHEN count(*) FILTER (o.b = {hit}) > 0 THEN {hit} ELSE {255 - hit} END AS b
          FROM {last} c JOIN {last} o ON o.page_id = c.page_id AND abs(o.i % 8 - c.i % 8) <= 1 AND abs(o.i // 8 - c.i // 8) <= 1 GROUP BY c.page_id, c.i)"""
        last = f"m{n}"
    return out + f" SELECT page_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) AS px FROM {last} GROUP BY page_id"


@query("img09_erode", f"WITH {BIN_SQL}" + _morph_sql("bin", ["erode"]))
def _(spark, d):
    return image.erode(binarized(spark, d), "bin", "bin").select("page_id", _text("bin").alias("px"))


@query("img10_dilate", f"WITH {BIN_SQL}" + _morph_sql("bin", ["dilate"]))
def _(spark, d):
    return image.dilate(binarized(spark, d), "bin", "bin").select("page_id", _text("bin").alias("px"))


@query("img11_open_close", f"WITH {BIN_SQL}" + _morph_sql("bin", ["erode", "dilate", "dilate", "erode"]))
def _(spark, d):
    return image.open_close(binarized(spark, d), "bin").select("page_id", _text("bin").alias("px"))


@query("img12_morphology", f"WITH {BIN_SQL}" + _morph_sql("bin", ["erode", "dilate", "dilate", "erode"] * 2))
def _(spark, d):
    return image.morphology(binarized(spark, d), 4, "bin").select("page_id", _text("bin").alias("px"))


@query("img14_radon_angle", f"""WITH {BIN_SQL}, k AS (SELECT page_id, i % 8 AS x, i // 8 AS y FROM bin WHERE b = 0),
s AS (SELECT k.*, a.a AS angle, radians(a.a * CAST(0.1 AS DOUBLE)) AS t FROM k, range(-50, 51) a(a)),
r AS (SELECT page_id, angle, CAST(floor((((x - 4.0) * cos(t) + (y - 4.0) * sin(t)) + sqrt(CAST(128 AS DOUBLE)) / 2) / (2 * (sqrt(CAST(128 AS DOUBLE)) / 2)) * 12 + 0.5) AS BIGINT) AS bin FROM s),
c AS (SELECT page_id, angle, bin, count(*) AS n FROM r WHERE bin BETWEEN 0 AND 12 GROUP BY ALL),
v AS (SELECT page_id, angle, sum(n * n) AS score FROM c GROUP BY ALL),
m AS (SELECT page_id, arg_max(angle, (score, angle)) AS angle FROM v GROUP BY page_id)
SELECT otsu.page_id, CAST(coalesce(angle, 50) AS INTEGER) AS angle FROM otsu LEFT JOIN m USING (page_id)""")
def _(spark, d):
    return image.radon_angle(binarized(spark, d).select("page_id", "width", "height", F.col("bin").alias("px")))


@query("img18_pack", f"""WITH {BIN_SQL}, br AS (SELECT page_id, i // 8 AS row_no, CAST(sum(CASE WHEN b = 0 THEN 1 << (7 - i % 8) ELSE 0 END) AS BIGINT) AS v FROM bin GROUP BY ALL)
SELECT page_id, string_agg(printf('%02X', v), '' ORDER BY row_no) AS bits_black1 FROM br GROUP BY page_id""")
def _(spark, d):
    return binarized(spark, d).select("page_id", image.packed_hex(F.col("bin"), F.col("width"), F.col("height")).alias("bits_black1"))


@query("dec07_expand", f"""WITH {BIN_SQL} SELECT page_id, string_agg(CAST(255 - b AS VARCHAR), ',' ORDER BY i) AS px FROM bin GROUP BY page_id""")
def _(spark, d):
    """Packing marks black with 1 and expansion paints 1 white, so the pair inverts."""
    hexed = binarized(spark, d).withColumn("hex", image.packed_hex(F.col("bin"), F.col("width"), F.col("height")))
    return hexed.select("page_id", _text(image.unpacked(F.col("hex"), 8, 8)).alias("px"))


@query("dec09_invert", f"WITH {PIXELS_SQL} SELECT page_id, string_agg(CAST(255 - g AS VARCHAR), ',' ORDER BY i) AS px FROM pix GROUP BY page_id")
def _(spark, d):
    return grey_pages(spark, d).select("page_id", _text(F.transform("px", lambda v: 255 - v)).alias("px"))


@query("dec08_needs_inversion", """SELECT p_partkey AS part, CASE WHEN p_size % 3 = 0 THEN TRUE ELSE coalesce(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END > CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END, FALSE) END AS invert, coalesce(CASE WHEN p_size % 5 = 0 THEN 1 END, 8) AS bits FROM part""")
def _(spark, d):
    mask = F.col("p_size") % 3 == 0
    decode = F.when(F.col("p_size") % 4 == 0, F.array(F.lit(1), F.lit(0))).when(F.col("p_size") % 4 == 1, F.array(F.lit(0), F.lit(1)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), (mask | F.coalesce(F.get(decode, 0) > F.get(decode, 1), F.lit(False))).alias("invert"), F.coalesce(F.when(F.col("p_size") % 5 == 0, 1), F.lit(8)).alias("bits"))


FILTERS = ("FlateDecode", "DCTDecode", "CCITTFaxDecode", "JBIG2Decode", "LZWDecode", "")


@query("dec06_filter_dispatch", """WITH f AS (SELECT p_partkey AS part, ['FlateDecode','DCTDecode','CCITTFaxDecode','JBIG2Decode','LZWDecode',''][p_size % 6 + 1] AS filter FROM part)
SELECT part, CASE filter WHEN '' THEN 'raw' WHEN 'FlateDecode' THEN 'flate' WHEN 'DCTDecode' THEN 'jpeg' WHEN 'CCITTFaxDecode' THEN 'ccitt' WHEN 'JBIG2Decode' THEN 'jbig2' END AS codec,
CASE WHEN filter = 'LZWDecode' THEN concat('unsupported image filter: ', filter) END AS error FROM f""")
def _(spark, d):
    name = F.element_at(F.lit(list(FILTERS)), F.col("p_size") % 6 + 1)
    codec = F.create_map(*[F.lit(x) for x in ("", "raw", "FlateDecode", "flate", "DCTDecode", "jpeg", "CCITTFaxDecode", "ccitt", "JBIG2Decode", "jbig2")])[F.col("filter")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), name.alias("filter")).select("part", codec.alias("codec"), F.when(codec.isNull(), F.concat(F.lit("unsupported image filter: "), "filter")).alias("error"))


SIZE_SQL = "sz AS (SELECT p_partkey AS part, CAST(p_size * 61 + 20 AS DOUBLE) AS w, CAST(p_partkey % 2000 + 50 AS DOUBLE) AS h, (p_partkey * 7) % 900 AS dpi FROM part)"


def _sizes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") * 61 + 20).cast("double").alias("w"), (F.col("p_partkey") % 2000 + 50).cast("double").alias("h"), ((F.col("p_partkey") * 7) % 900).alias("dpi"))


@query("img20_render_dpi", f"WITH {SIZE_SQL} SELECT part, CAST(trunc(greatest(least(CAST(dpi AS DOUBLE), 432000.0 / greatest(w, h)), 72.0)) AS INTEGER) AS dpi FROM sz")
def _(spark, d):
    return _sizes(spark, d).select("part", image.render_dpi(F.col("dpi"), F.col("w"), F.col("h")).alias("dpi"))


@query("img21_pixel_size", f"WITH {SIZE_SQL} SELECT part, CAST(floor(w * least(greatest(dpi, 72), 1200) / CAST(72 AS DOUBLE) + 0.5) AS BIGINT) AS width_px, CAST(floor(h * least(greatest(dpi, 72), 1200) / CAST(72 AS DOUBLE) + 0.5) AS BIGINT) AS height_px FROM sz")
def _(spark, d):
    return _sizes(spark, d).select("part", image.pixel_side(F.col("w"), F.col("dpi")).alias("width_px"), image.pixel_side(F.col("h"), F.col("dpi")).alias("height_px"))


@query("img08_downscale_size", f"WITH {SIZE_SQL} SELECT part, CAST(CASE WHEN greatest(w, h) <= 1200 THEN w ELSE greatest(floor(w * (CAST(1200 AS DOUBLE) / greatest(w, h))), 1) END AS BIGINT) AS width_px, CAST(CASE WHEN greatest(w, h) <= 1200 THEN h ELSE greatest(floor(h * (CAST(1200 AS DOUBLE) / greatest(w, h))), 1) END AS BIGINT) AS height_px FROM sz")
def _(spark, d):
    longest = F.greatest("w", "h")
    return _sizes(spark, d).select("part", image.scaled_side(F.col("w"), longest, 1200).alias("width_px"), image.scaled_side(F.col("h"), longest, 1200).alias("height_px"))


@query("img15_radon_size", f"WITH {SIZE_SQL} SELECT part, CAST(CASE WHEN greatest(w, h) <= 800 THEN w ELSE greatest(floor(w * (CAST(800 AS DOUBLE) / greatest(w, h))), 1) END AS BIGINT) AS width_px FROM sz")
def _(spark, d):
    return _sizes(spark, d).select("part", image.scaled_side(F.col("w"), F.greatest("w", "h"), 800).alias("width_px"))


@query("img19_dpi_size", f"""WITH {SIZE_SQL}, k AS (SELECT *, least(greatest(dpi / CAST(300 AS DOUBLE), 0.25), 4.0) AS s FROM sz)
SELECT part, CAST(CASE WHEN abs(s - 1) < 0.01 THEN w ELSE greatest(floor(w * s), 1) END AS BIGINT) AS width_px FROM k""")
def _(spark, d):
    s = F.least(F.greatest(F.col("dpi") / 300.0, F.lit(0.25)), F.lit(4.0))
    return _sizes(spark, d).select("part", F.when(F.abs(s - 1) < 0.01, F.col("w")).otherwise(F.greatest(F.floor(F.col("w") * s), F.lit(1))).cast("long").alias("width_px"))


@query("src09_default_size", f"WITH {SIZE_SQL}, n AS (SELECT part, CASE WHEN part % 4 > 0 THEN w END AS w, CASE WHEN part % 4 > 0 THEN h END AS h FROM sz) SELECT part, coalesce(w, 612.0) AS raster_w, coalesce(h, 792.0) AS raster_h, coalesce(w, 595.0) AS text_w, coalesce(h, 842.0) AS text_h FROM n")
def _(spark, d):
    known = [F.when(F.col("part") % 4 > 0, F.col(c)) for c in ("w", "h")]
    fallback = {"raster": (612.0, 792.0), "text": (595.0, 842.0)}
    return _sizes(spark, d).select("part", *(F.coalesce(k, F.lit(v)).alias(f"{use}_{c}") for use, vs in fallback.items() for k, v, c in zip(known, vs, "wh", strict=True)))


@query("img01_preprocess", f"""WITH {BIN_SQL}, k AS (SELECT page_id, avg(CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END) BETWEEN 0.02 AND 0.7 AS ok FROM bin GROUP BY page_id)
SELECT page_id, CASE WHEN ok THEN string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) ELSE string_agg(CAST(g AS VARCHAR), ',' ORDER BY i) END AS px, ok AS bitonal FROM bin JOIN k USING (page_id) JOIN pix USING (page_id, i) GROUP BY page_id, ok""")
def _(spark, d):
    """Level 0, deskew off: the level decides, and only binarizable pages become bitonal."""
    return preprocessed(grey_pages(spark, d), {}).select("page_id", _text("px").alias("px"), "bitonal")


@query("wn01_prefix_sums", f"WITH {PIXELS_SQL}, hist AS (SELECT page_id, g, count(*) AS n FROM pix GROUP BY ALL) SELECT page_id, CAST(g AS INTEGER) AS g, CAST(sum(n) OVER w AS BIGINT) AS weight, CAST(sum(n * g) OVER w AS BIGINT) AS total FROM hist WINDOW w AS (PARTITION BY page_id ORDER BY g ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    from pyspark.sql import Window

    hist = grey_pages(spark, d).select("page_id", F.explode("px").alias("g")).groupBy("page_id", "g").agg(F.count("*").alias("n"))
    w = Window.partitionBy("page_id").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("page_id", "g", F.sum("n").over(w).alias("weight"), F.sum(F.col("n") * F.col("g")).over(w).cast("long").alias("total"))
