"""Queries on PDF files that are made from the 8x8 pages: four pages a document.

Each document is written, read again and, in some queries, edited between; so a query's oracle is the
SQL of what went in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.adapters import PAGES_SQL, PIXELS_SQL, SIDE, grey_pages
from quire.operators import documents, lines, pdf, raster
from quire.plans.images import BIN_SQL, binarized
from quire.plans.registry import query

PATH_SQL = "concat('/in/', page_id // 4, '.pdf') AS path, CAST(page_id % 4 + 1 AS INTEGER) AS page_number"
#: Documents of this remainder by 11 are junk, of this one by 13 encrypted.
JUNK, LOCKED = 4, 5
BROKEN_SQL = f"(page_id // 4 % 11 = {JUNK} OR page_id // 4 % 13 = {LOCKED})"


def _as_pages(px: DataFrame) -> DataFrame:
    """path, page_number, width, height, data of (page_id, px)."""
    path = F.concat(F.lit("/in/"), F.expr("page_id div 4"), F.lit(".pdf"))
    data = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return px.select("page_id", path.alias("path"), (F.col("page_id") % 4 + 1).cast("int").alias("page_number"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), data.alias("data"))


def made(pages: DataFrame, codec: str = "flate") -> DataFrame:
    """path, content: a document of each path's pages, of 144 points more than their pixels and page_id % 7."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sheets = []
                for p in sorted(row["sheets"], key=lambda p: p["page_id"]):
                    grey = np.frombuffer(p["data"], np.uint8).reshape(SIDE, SIDE)
                    sheets.append((SIDE + 144 + p["page_id"] % 7, SIDE + 144, pdf.image_stream(grey, codec), b"(x) Tj" if p["page_id"] % 3 == 0 else b"q (x Tj) pop Q"))
                content, doc = pdf.save(pdf.new_document(sheets)), row["sheets"][0]["page_id"] // 4
                content = b"junk" if doc % 11 == JUNK else content.replace(b"trailer\n<<", b"trailer\n<</Encrypt<<>> ") if doc % 13 == LOCKED else content
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "content": content}])

    return pages.groupBy("path").agg(F.collect_list(F.struct("page_id", "data")).alias("sheets")).mapInArrow(run, "path string, content binary")


def _greys(spark: SparkSession, d: str) -> DataFrame:
    return _as_pages(grey_pages(spark, d))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return made(_greys(spark, d))


def _shown(rasters: DataFrame) -> DataFrame:
    """Pixels as the text that the SQL has: data's bytes, comma-joined."""
    at = F.transform(F.sequence(F.lit(0), F.length("data") - 1), lambda i: F.conv(F.hex(F.substring("data", i + 1, F.lit(1))), 16, 10))
    return rasters.filter("data IS NOT NULL").select("path", "page_number", F.array_join(at, ",").alias("px"))


@query("src04_load", f"SELECT path, CAST(count(CASE WHEN error IS NULL THEN 1 END) AS BIGINT) AS pages, max(error) AS error FROM (SELECT {PATH_SQL}, CASE WHEN page_id // 4 % 11 = {JUNK} THEN 'not a PDF file' WHEN page_id // 4 % 13 = {LOCKED} THEN 'password required' END AS error FROM (SELECT vec_id AS page_id FROM embeddings)) GROUP BY path")
def _(spark, d):
    return documents.document_pages(_files(spark, d)).groupBy("path").agg(F.count("page_number").alias("pages"), F.max("error").alias("error"))


@query("src08_media_box", f"SELECT {PATH_SQL}, CAST(152 + page_id % 7 AS DOUBLE) AS width_pt, CAST(152 AS DOUBLE) AS height_pt, page_id % 3 = 0 AS has_text, 1 AS images FROM (SELECT vec_id AS page_id FROM embeddings) WHERE NOT {BROKEN_SQL}")
def _(spark, d):
    return documents.document_pages(_files(spark, d)).filter("page_number IS NOT NULL").drop("error")


@query("src11_embedded_image", f"WITH {PAGES_SQL} SELECT {PATH_SQL}, array_to_string(px, ',') AS px FROM pg WHERE NOT {BROKEN_SQL}")
def _(spark, d):
    return _shown(documents.page_rasters(_files(spark, d)))


def _first_page(_: bytes, number: int, __: int) -> np.ndarray | None:
    if number == 3:
        raise RuntimeError("no renderer")
    return np.full((2, 2), 7, np.uint8) if number == 1 else None


@query("src13_fallback", f"WITH {PAGES_SQL} SELECT {PATH_SQL}, CASE WHEN page_id % 4 = 0 THEN '7,7,7,7' ELSE array_to_string(px, ',') END AS px FROM pg WHERE NOT {BROKEN_SQL}")
def _(spark, d):
    return _shown(documents.page_rasters(_files(spark, d), render=_first_page))


@query("src12_all_images", f"WITH {PAGES_SQL} SELECT {PATH_SQL}, 'Im0' AS name, 8 AS width, 8 AS height, 'FlateDecode' AS filter, array_to_string(px, ',') AS px FROM pg WHERE NOT {BROKEN_SQL}")
def _(spark, d):
    rows = documents.document_images(_files(spark, d)).filter("page_number IS NOT NULL")
    at = F.transform(F.sequence(F.lit(0), F.length("data") - 1), lambda i: F.conv(F.hex(F.substring("data", i + 1, F.lit(1))), 16, 10))
    return rows.select("path", "page_number", "name", "width", "height", "filter", F.array_join(at, ",").alias("px"))


#: Content streams, and whether they show text.
CONTENTS = ((b"BT (x) Tj ET", True), (b"[(x) 3 (y)] TJ", True), (b"(x) '", True), (b"q (x Tj) pop Q", False), (b"% (x) Tj\nq Q", False), (b"BI /W 1 /H 1 ID (x) Tj EI Q", False), (b"/Tj gs <547a> pop", False), (b'1 2 (x) "', True), (b"", False))


@query("flt02_has_text", f"SELECT vec_id AS page_id, vec_id % {len(CONTENTS)} IN ({', '.join(str(i) for i, (_, shows) in enumerate(CONTENTS) if shows)}) AS has_text FROM embeddings")
def _(spark, d):
    """The predicate of content streams, on streams with every operator that shows text and with its look-alikes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shows = [pdf.has_text(CONTENTS[i % len(CONTENTS)][0]) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shows)], names=["page_id", "has_text"])

    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("page_id")).mapInArrow(run, "page_id long, has_text boolean")


@query("img16_hough_angle", "SELECT p_partkey AS part, CASE WHEN p_size % 3 = 0 THEN CAST(0 AS DOUBLE) END AS angle FROM part")
def _(spark, d):
    """Pages of 140x120 pixels: upright strokes, level ones (which lean too far), and blank ones. A page a size, as parts share them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, angles = batch.column(0).to_pylist(), []
            for size in sizes:
                page = np.full((140, 120), 255, np.uint8)
                if size % 3 == 0:
                    page[:, 20 + size % 30 :: 25] = 0
                elif size % 3 == 1:
                    page[20 + size % 30 :: 25] = 0
                angles.append(lines.hough_angle(page))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(angles, pa.float64())], names=["p_size", "angle"])

    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("part"), "p_size")
    return part.join(part.select("p_size").distinct().mapInArrow(run, "p_size int, angle double"), "p_size").select("part", "angle")


@query("dec05_ccitt", f"WITH {BIN_SQL} SELECT {PATH_SQL}, string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) AS px FROM bin WHERE NOT {BROKEN_SQL} GROUP BY page_id")
def _(spark, d):
    return _shown(documents.page_rasters(made(_as_pages(binarized(spark, d).select("page_id", F.col("bin").alias("px"))), "ccitt")))


@query("snk08_replace_image", f"WITH {PAGES_SQL}, {BIN_SQL[len(PAGES_SQL) + 2:]}, bw AS (SELECT page_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) AS bw FROM bin GROUP BY page_id) SELECT {PATH_SQL}, CASE WHEN page_id % 5 < 2 THEN bw ELSE array_to_string(px, ',') END AS px FROM pg JOIN bw USING (page_id) WHERE NOT {BROKEN_SQL}")
def _(spark, d):
    new = _as_pages(binarized(spark, d).filter("page_id % 5 < 2").select("page_id", F.col("bin").alias("px")))
    return _shown(documents.page_rasters(documents.edited_documents(_files(spark, d), images=documents.encoded_images(new))))


@query("snk10_layer_in_file", f"SELECT {PATH_SQL}, page_id % 3 = 0 OR page_id % 5 = 0 AS has_text FROM (SELECT vec_id AS page_id FROM embeddings) WHERE NOT {BROKEN_SQL}")
def _(spark, d):
    layers = _greys(spark, d).filter("page_id % 5 = 0").select("path", "page_number", F.concat(F.lit("BT /Helvetica 8 Tf 3 Tr 1 0 0 1 10 20 Tm ("), "page_id", F.lit(") Tj ET")).alias("operators"))
    return documents.document_pages(documents.edited_documents(_files(spark, d), layers=layers, archive=True)).filter("page_number IS NOT NULL").select("path", "page_number", "has_text")


@query("img06_adaptive", f"WITH {PIXELS_SQL}, xy AS (SELECT page_id, g, i, i % 8 AS x, i // 8 AS y FROM pix), m AS (SELECT a.page_id, a.i, a.g, CAST(sum(b.g) AS BIGINT) // count(*) AS mean FROM xy a JOIN xy b ON a.page_id = b.page_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL) SELECT page_id, string_agg(CASE WHEN g >= mean THEN '255' ELSE '0' END, ',' ORDER BY i) AS px FROM m GROUP BY page_id")
def _(spark, d):
    return _ruled(spark, d, lambda p: raster.adaptive(p, 2))


@query("img07_median", f"WITH {PIXELS_SQL}, xy AS (SELECT page_id, g, i % 8 AS x, i // 8 AS y FROM pix), o AS (SELECT page_id, x0, y0, least(greatest(x0 + dx, 0), 7) AS x, least(greatest(y0 + dy, 0), 7) AS y FROM (SELECT page_id, x AS x0, y AS y0 FROM xy), range(-3, 4) a(dx), range(-3, 4) b(dy)), m AS (SELECT o.page_id, y0 * 8 + x0 AS i, quantile_disc(g, 0.5) AS g FROM o JOIN xy USING (page_id, x, y) GROUP BY ALL) SELECT page_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY i) AS px FROM m GROUP BY page_id")
def _(spark, d):
    return _ruled(spark, d, lambda p: raster.denoised(p, 1))


@query("img17_rotate", f"WITH {PIXELS_SQL}, t AS (SELECT page_id, g, (8 - i // 8) * 8 + 8 - i % 8 AS i FROM pix WHERE i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6), s AS (SELECT page_id, i, coalesce(t.g, 255) AS g FROM pix LEFT JOIN t USING (page_id, i)) SELECT page_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY i) AS px FROM s GROUP BY page_id")
def _(spark, d):
    return _ruled(spark, d, lambda p: raster.rotate(p, 180))


def _ruled(spark: SparkSession, d: str, rule) -> DataFrame:
    """page_id, px after a rule over whole pages."""
    shown = raster.over_pages(_greys(spark, d).select("page_id", "width", "height", "data"), rule)
    return _shown(shown.withColumn("path", F.col("page_id")).withColumn("page_number", F.lit(1))).select(F.col("path").alias("page_id"), "px")
