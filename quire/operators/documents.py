"""PDF files as DataFrames: documents to pages and rasters, and edits back into documents.

A file is parsed inside one task (it is at most 512 MiB); what leaves a task are page rows, one at a
time. Edits are encoded before they are shuffled, so rasters stay where they were made, and a
document's edits meet in its own row only.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pdf, raster, recognition

#: Renders (file, page number from 1, dots an inch) to grey pixels, or None where it can't.
Renderer = Callable[[bytes, int, int], np.ndarray | None]

PAGES = "path string, page_number int, width_pt double, height_pt double, has_text boolean, images int, error string"
RASTERS = "path string, page_number int, width int, height int, data binary, source string, error string"
ENCODED = "path string, page_number int, codec string, width int, height int, data binary, error string"
SAVED = "path string, content binary, error string"
IMAGES = "path string, page_number int, name string, width int, height int, bits int, filter string, data binary, error string"
#: Page images with the words that were recognised on them.
CLEANED = f"{ENCODED}, page_w double, page_h double, words array<struct<text:string,left:int,top:int,right:int,bottom:int,confidence:double>>"


def read_documents(spark: SparkSession, where: str) -> DataFrame:
    """path, length, content of the ``.pdf`` files below ``where``; too large ones are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(where)
    return files.filter(F.col("length") <= pdf.MAX_FILE).select("path", "length", "content")


def _map(df: DataFrame, columns: list[str], schema: str, rule: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``rule`` makes rows of a row's ``columns``; each row leaves in a batch of its own."""
    names = [part.split()[0] for part in schema.split(", ")]
    words = pa.list_(pa.struct([("text", pa.string()), *((c, pa.int32()) for c in ("left", "top", "right", "bottom")), ("confidence", pa.float64())]))
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), CLEANED.rsplit(" ", 1)[1]: words}
    shape = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                for row in rule(*(c[at].as_py() for c in batch.columns)):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=shape)

    return df.select(*columns).mapInArrow(run, schema)


def _locked(docs: DataFrame) -> DataFrame:
    """``docs`` with a password column, null where it has none."""
    return docs if "password" in docs.columns else docs.withColumn("password", F.lit(None).cast("string"))


def document_pages(docs: DataFrame) -> DataFrame:
    """The pages of (path, content[, password]), as ``PAGES``: number, box (null without one), text, count of images.

    A file that can't be read, or null content, gives one row with a null page number and the reason.
    A document without pages gives no row.
    """

    def rule(path: str, content: bytes | None, password: str | None) -> Iterator[tuple]:
        try:
            doc = pdf.load(bytes(content or b""), password)
        except pdf.PdfError as e:
            yield path, None, None, None, None, None, str(e)
            return
        for number, (page, box, resources) in enumerate(doc.pages(), 1):
            width, height = (box[2] - box[0], box[3] - box[1]) if box else (None, None)
            yield path, number, width, height, pdf.has_text(doc.content(page)), len(pdf.images(doc, resources or {})), None

    return _map(_locked(docs), ["path", "content", "password"], PAGES, rule)


def document_images(docs: DataFrame) -> DataFrame:
    """Every image object of every page of (path, content[, password]), as ``IMAGES``: grey pixels, or why there are none.

    An image that several pages show is given for each. A file that can't be read has one row with the reason.
    """

    def rule(path: str, content: bytes | None, password: str | None) -> Iterator[tuple]:
        try:
            doc = pdf.load(bytes(content or b""), password)
        except pdf.PdfError as e:
            yield path, *[None] * 7, str(e)
            return
        for number, (_, _, resources) in enumerate(doc.pages(), 1):
            for name, _, stream in pdf.images(doc, resources or {}):
                bits = doc.get(stream.entries.get("BitsPerComponent"))
                facts = path, number, name, doc.get(stream.entries["Width"]), doc.get(stream.entries["Height"]), bits if isinstance(bits, int) else None, (doc.filters(stream) or [None])[0]
                try:
                    yield *facts, pdf.pixels(doc, stream).tobytes(), None
                except pdf.BROKEN as e:
                    yield *facts, None, str(e)

    return _map(_locked(docs), ["path", "content", "password"], IMAGES, rule)


#: Seconds that a renderer may take for a page, and the resolutions that it is asked for.
RENDER_SECONDS, RENDER_DPI = 30, (72, 1200)


def _rendered(render: Renderer, content: bytes, number: int, dpi: int) -> np.ndarray | None:
    """What the renderer gives within its time; one that hangs is left behind in a thread of its own."""
    out: list = []

    def work() -> None:
        try:
            out.append((render(content, number, max(RENDER_DPI[0], min(RENDER_DPI[1], dpi))), None))
        except Exception as e:  # told to the waiting task
            out.append((None, e))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(RENDER_SECONDS)
    if not out:
        raise TimeoutError(f"no page within {RENDER_SECONDS} seconds")
    made, failed = out[0]
    if failed is not None:
        raise failed
    return made if made is not None and made.size else None


def _raster(doc: pdf.Document, content: bytes, number: int, resources: dict | None, render: Renderer | None, dpi: int) -> tuple[np.ndarray | None, str | None, str | None]:
    made, source, error = None, "rendered", None
    if render is not None:
        try:
            made = _rendered(render, content, number, dpi)
        except Exception as e:  # a renderer's failure must not cost the page
            error = f"render: {e}"
    if made is None:
        try:
            found = pdf.images(doc, resources)
            made, source = (pdf.pixels(doc, found[0][2]), "embedded") if found else (None, None)
            error = None if found else error or "no image"
        except pdf.BROKEN as e:
            source, error = None, str(e)
    return made, source, error


def page_rasters(docs: DataFrame, render: Renderer | None = None, dpi: int = 300) -> DataFrame:
    """Each page's grey pixels as ``RASTERS``: what ``render`` gives, else the page's first image.

    A page without either, or with an image that can't be decoded, keeps its row with the reason.
    """

    def rule(path: str, content: bytes | None, password: str | None) -> Iterator[tuple]:
        try:
            doc = pdf.load(bytes(content or b""), password)
        except pdf.PdfError as e:
            yield path, None, None, None, None, None, str(e)
            return
        for number, (_, _, resources) in enumerate(doc.pages(), 1):
            made, source, error = _raster(doc, content, number, resources, render, dpi)
            size = (None, None, None) if made is None else (made.shape[1], made.shape[0], made.tobytes())
            yield path, number, *size, source, error

    return _map(_locked(docs), ["path", "content", "password"], RASTERS, rule)


def encoded_images(rasters: DataFrame, codec: str = "ccitt") -> DataFrame:
    """Image streams of (path, page_number, width, height, data) as ``ENCODED``: ``ccitt`` (0 is black) or ``flate``."""

    def rule(path: str, number: int, width: int, height: int, data: bytes | None) -> Iterator[tuple]:
        try:
            page = np.frombuffer(data or b"", np.uint8).reshape(height, width)
            yield path, number, codec, width, height, pdf.image_stream(page, codec).data, None
        except (ValueError, TypeError) as e:
            yield path, number, codec, width, height, None, str(e)

    return _map(rasters, ["path", "page_number", "width", "height", "data"], ENCODED, rule)


def cleaned_images(docs: DataFrame, render: Renderer | None = None, dpi: int = 300, recogniser: recognition.Factory | None = None) -> DataFrame:
    """Page images of (path, content, options[, password]) as ``CLEANED``, preprocessed as the options say.

    Bitonal pages are ``ccitt``, those not worth binarizing ``flate`` with their greys. Pages with text are left
    out where ``existing_text`` is skip, and pages without pixels. With a recogniser (``options`` languages, psm) the words of
    the cleaned page come along. A page that preprocessing or recognition refuses has a row with the
    reason; with ``continue_on_error`` only where no page of its document could be cleaned.
    """

    def rule(path: str, content: bytes | None, options: list[tuple[str, str]] | None, password: str | None) -> Iterator[tuple]:
        options = dict(options or ())
        try:
            doc = pdf.load(bytes(content or b""), password)
        except pdf.PdfError:  # edited_documents says why
            return
        failed, done = [], 0
        for number, (page, box, resources) in enumerate(doc.pages(), 1):
            if options.get("existing_text") == "skip" and pdf.has_text(doc.content(page)):
                continue
            made, _, _ = _raster(doc, content, number, resources, render, dpi)
            if made is None:
                continue
            box = box or list(pdf.DEFAULT_BOX)
            try:
                made, bitonal = raster.preprocessed(made, raster.Settings.of(options))
                words = None if recogniser is None else recognition.recognised(made, recogniser, recognition.languages_of(options.get("languages")), int(options.get("psm", 3)), dpi)
                codec = "ccitt" if bitonal else "flate"
                yield path, number, codec, made.shape[1], made.shape[0], pdf.image_stream(made, codec).data, None, float(box[2] - box[0]), float(box[3] - box[1]), None if words is None else [w._asdict() for w in words]
                done += 1
            except (ValueError, TypeError) as e:
                failed.append((path, number, None, None, None, None, str(e), None, None, None))
        if options.get("continue_on_error", "").lower() != "true" or not done:
            yield from failed

    return _map(_locked(docs), ["path", "content", "options", "password"], CLEANED, rule)


def recognised_words(cleaned: DataFrame) -> DataFrame:
    """The words of ``CLEANED`` pages, one a row, with the sizes that :func:`recognition.layers` needs."""
    sizes = (F.col("width").alias("image_w"), F.col("height").alias("image_h"), "page_w", "page_h")
    return cleaned.select("path", "page_number", *sizes, F.posexplode("words").alias("idx", "w")).select("path", "page_number", "page_w", "page_h", "image_w", "image_h", "idx", "w.*")


def _as_stream(codec: str, width: int, height: int, data: bytes) -> pdf.Stream:
    shell = pdf.image_stream(np.full((1, 1), 255, np.uint8), codec)
    entries = shell.entries | {"Width": width, "Height": height}
    if "DecodeParms" in entries:
        entries["DecodeParms"] = entries["DecodeParms"] | {"Columns": width, "Rows": height}
    return pdf.Stream(entries, data)


def edited_documents(docs: DataFrame, images: DataFrame | None = None, layers: DataFrame | None = None, archive: bool = False, strict: bool = False) -> DataFrame:
    """(path, content[, password]) with page images replaced, text layers added and, if ``archive``, PDF/A metadata.

    A file that was encrypted is written without encryption.

    ``images`` is what :func:`encoded_images` gives, ``layers`` (path, page_number, operators string).
    Edits of pages that a document doesn't have are ignored, as are null ones. A document that can't be
    read, or has a page to replace without image resources, has null content and the reason; if ``strict``
    also one with an image that has an error.
    """

    def by_path(df: DataFrame | None, *columns: str) -> DataFrame:
        df = docs.select("path").limit(0).select("path", *(F.lit(None).cast(t).alias(n) for n, t in zip(columns, ["int", *["string"] * 5]))) if df is None else df
        return df.filter(F.col(columns[-1]).isNotNull() | (F.col("error").isNotNull() if strict and "error" in columns else F.lit(False))).groupBy("path").agg(F.collect_list(F.struct(*columns)).alias("edits"))

    wanted = _locked(docs).select("path", "content", "password")
    wanted = wanted.join(by_path(images, "page_number", "codec", "width", "height", "error", "data").withColumnRenamed("edits", "images"), "path", "left")
    wanted = wanted.join(by_path(layers, "page_number", "operators").withColumnRenamed("edits", "layers"), "path", "left")

    def rule(path: str, content: bytes | None, password: str | None, images: list[dict] | None, layers: list[dict] | None) -> Iterator[tuple]:
        try:
            doc = pdf.load(bytes(content or b""), password)
            broken = sorted((e["page_number"], e["error"]) for e in images or () if e["data"] is None)
            if broken:
                yield path, None, "page {}: {}".format(*broken[0])
                return
            pages = dict(enumerate(doc.pages(), 1))
            for e in images or ():
                if e["page_number"] in pages:
                    pdf.replace_image(doc, pages[e["page_number"]][2], _as_stream(e["codec"], e["width"], e["height"], e["data"]))
            for e in sorted(layers or (), key=lambda e: (e["page_number"], e["operators"])):
                if e["page_number"] in pages:
                    page, _, resources = pages[e["page_number"]]
                    pdf.add_layer(doc, page, page.get("Resources") and doc.get(page["Resources"]) or resources, e["operators"].encode())
            if archive:
                pdf.add_archive_metadata(doc)
            yield path, pdf.save(doc), None
        except pdf.BROKEN as e:
            yield path, None, str(e)

    return _map(wanted, ["path", "content", "password", "images", "layers"], SAVED, rule)


def save_documents(docs: DataFrame) -> DataFrame:
    """Writes (output_path, content) and returns output_path, bytes, error; the folder must exist.

    Paths must be in a folder that all executors mount. A file appears by a rename, so a task that
    runs again after its executor was lost leaves the same file and no part of one.
    """

    def rule(path: str, content: bytes | None) -> Iterator[tuple]:
        if content is None:
            yield path, None, "no content"
            return
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as f:
                f.write(content)
            os.replace(part, path)
            yield path, os.path.getsize(path), None
        except OSError as e:
            yield path, None, str(e)

    return _map(docs, ["output_path", "content"], "output_path string, bytes long, error string", rule)
