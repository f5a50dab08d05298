"""Scalar functions as columns: rounding, formats, paths, PDF strings, bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Advance widths by ASCII character, in thousandths of an em; any other byte is 500 wide.
GLYPH_WIDTHS = {
    " !\".,/:;I[\\]ft": 278,
    "'()-`r": 333,
    "#": 355,
    "$%0123456789?L_abdeghnopqu": 556,
    "&": 889,
    "*": 389,
    "+<=>~": 584,
    "@": 1015,
    "ABEHPSKV": 667,
    "CDGOQRUXYNw": 722,
    "FTZ": 611,
    "Mm": 833,
    "W": 944,
    "^": 469,
    "ijl": 222,
    "{}": 334,
    "|": 260,
}
OTHER_WIDTH = 500


def round_half_up(x: Column) -> Column:
    """Half away from zero for values that aren't negative."""
    return F.floor(x + 0.5)


_BYTE_WIDTHS = np.full(256, OTHER_WIDTH, np.int64)
for _characters, _width in GLYPH_WIDTHS.items():
    _BYTE_WIDTHS[list(_characters.encode())] = _width


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts, and the last one ends, in the bytes of all; those bytes."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return ends - ends[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _widths(texts: pa.Array) -> pa.Array:
    """One look-up a byte: widths summed up over all texts of a batch, and what lies between a text's ends."""
    ends, data = utf8(texts)
    sums = np.concatenate(([0], np.cumsum(_BYTE_WIDTHS[data])))
    return pa.array(np.diff(sums[ends]), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


_word_width = F.arrow_udf(_widths, LongType())


def word_width(text: Column) -> Column:
    """Sum of glyph widths over the UTF-8 bytes of a word."""
    return _word_width(text)


def escaped(text: Column) -> Column:
    """Backslash before ( ) and backslash."""
    for c in "\\()":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def pdf_number(x: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    x = x.cast("double")
    return F.when(x == F.floor(x), F.format_string("%d", F.floor(x))).otherwise(F.format_string("%.2f", x))


def quarters(n: Column) -> Column:
    """What :func:`pdf_number` makes of a whole number of quarters, without a formatter."""
    size = F.abs(n)
    part = F.when(size % 4 == 1, ".25").when(size % 4 == 2, ".50").when(size % 4 == 3, ".75").otherwise("")
    return F.concat(F.when(n < 0, "-").otherwise(""), F.shiftright(size, 2).cast("string"), part)


def font_size(left: Column, right: Column, top: Column, bottom: Column, width: Column, page_w: Column, page_h: Column, image_w: Column, image_h: Column) -> Column:
    """From the word's width where its glyphs have one, else from its height; at least 1."""
    by_width = (right - left) * page_w / F.greatest(image_w, F.lit(1)) / (width / 1000.0)
    by_height = (bottom - top) * page_h / F.greatest(image_h, F.lit(1))
    return F.greatest(F.when(width > 0, by_width).otherwise(by_height), F.lit(1.0))


def duration_text(ms: Column) -> Column:
    s = ms.cast("double") / 1000
    minutes, tenths = F.floor(s / 60), F.floor((ms + 50) / 100).cast("long")
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))).otherwise(F.format_string("%dm %ds", minutes, round_half_up(s - minutes * 60)))


def size_text(n: Column) -> Column:
    """B, KB below 1000 KB, else MB; one decimal, a trailing zero dropped."""
    kb = n.cast("double") / 1024

    def one(x: Column, unit: str) -> Column:
        tenths = round_half_up(x * 10).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit(unit))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(kb < 1000, one(kb, " KB")).otherwise(one(kb / 1024, " MB"))


def base_name(path: Column) -> Column:
    """The last segment after turning backslashes; the whole path if that is empty."""
    last = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(last == "", path).otherwise(last)


def stem(path: Column) -> Column:
    """The file name without its last extension; ``document`` for none."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    cut = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    return F.when(cut == "", "document").otherwise(cut)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def release_channel(version: Column) -> Column:
    """The pre-release tag up to its first dot; empty for a release."""
    return F.regexp_extract(version, r"^[^-]*-([^.]*)", 1)


def names_encryption(message: Column) -> Column:
    return F.lower(message).rlike("encrypt|password")
