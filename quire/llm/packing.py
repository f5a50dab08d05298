"""Bounded-space online best-fit packing of token sequences.

Every document becomes its token ids and an end id; longer ones are cut into full sequences and a
rest. Pieces are dealt by a hash of their row into groups of a fixed expected size, and each group is
packed on its own, in the order in which its pieces arrive, each placed at once and for good: a bit of
one integer stands for each amount of free space, so the tightest bin that fits is the lowest set bit
at or above the piece's length. ``OPEN_BINS`` bins are open, far fewer than a group fills; when one too
many is, the fullest (lowest set bit) closes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import rows_of, slices, stash
from quire.llm.tokens import default_tokenizer_path, encoder

SEQUENCE = 2048
OPEN_BINS = 256
#: Pieces expected in a group.
GROUP = 50_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PLACED = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut(ids: bytes, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids) of packed 32-bit ids, ``size`` ids a piece."""
    for piece, at in enumerate(range(0, len(ids), 4 * size)):
        part = ids[at : at + 4 * size]
        yield piece, at // 4, len(part) // 4, part


def token_pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (binary, or null with ``with_ids=False``) of (doc_id, text)."""
    path, end = tokenizer or default_tokenizer_path(), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_all
        for batch in slices(batches):
            out: list[list] = [[] for _ in PIECES]
            for doc, made in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                for piece, start, length, ids in cut(made + end, sequence):
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(ids), ids if with_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECES, strict=True)], schema=PIECES)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return rows_of(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best-fit. ``place`` gives (bin, offset) at once; bins never reopen."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit, self.open, self.made = capacity, open_bins, 0, 0
        self.mask, self.at = 0, defaultdict(list)

    def _take(self, free: int) -> int:
        stack = self.at[free]
        found = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            where = self._take(free)
        else:
            free, where = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.at[left].append(where)
            self.mask |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return where, self.capacity - free


def pack(pieces: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """Places pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id and offset.

    ``pieces`` is read twice (a count, then the packing), so pass a written table: its row order is the
    order of arrival, which a task that runs again meets again. Equal rows are packed as often as they
    occur, and dealt to all groups alike.
    """
    groups = max(1, -(-pieces.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fit = None, None
        for batch in slices(batches, 10_000):
            places: list[tuple[int, int]] = []
            for its, length in zip(batch.column("_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if its != now:
                    now, fit = its, BestFit(sequence, open_bins)
                where, offset = fit.place(length)
                places.append(((its << 40) + where, offset))
            columns = [batch.column(f.name) for f in list(PLACED)[:5]] + [pa.array([p[k] for p in places], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=PLACED)

    arrived = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("_row", F.monotonically_increasing_id())
    dealt = arrived.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).repartition(groups, "_group").sortWithinPartitions("_group", "_row")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Tokenise and pack whole documents (doc_id, text).

    Null and empty texts are the end id alone; a null doc_id is packed like any other; repeated rows
    are packed as often as they occur; very long texts are cut; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    return pack(stash(token_pieces(docs, tokenizer, sequence, end_id, with_ids=False).drop("ids"), "pieces"), sequence)
