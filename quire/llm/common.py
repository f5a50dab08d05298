"""Shared pieces of the corpus operators: scratch tables, bounded memo tables, id filters.

Cluster rules kept here so that the operators need not repeat them:

* intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which every executor
  can read, so a lost executor costs a re-read and never a recomputation of the whole lineage;
* the only broadcast is :func:`_bits`, whose size is fixed by ``FILTER_WORDS``.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import files

#: Words of 64 bits in an id filter: 131,072 rows of 16 bytes, 2 MB, whatever the input's size.
FILTER_WORDS = 1 << 17

#: Rows turned into Python objects at a time, and handed over at a time; they bound a worker's memory on long texts.
SLICE, BATCH, BATCH_SETTING = 256, 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster. Only where driver and executors are one process (tests) is a local one made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stash_path = path
    return back


def release(*stashed: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more, neither what is computed nor what is still to be."""
    for df in stashed:
        files.remove(df.sparkSession, df.stash_path)


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand rows to Python in batches of ``BATCH``, unless the session asks for its own number.

    The default of 10,000 texts a batch is held in buffers on both sides, in every task at once.
    """
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH))


def rows_of(df: DataFrame, **columns: Any) -> DataFrame:
    """Only the columns an operator works on, under its own names: clashing extras fall away."""
    small_batches(df.sparkSession)
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


class Memo(dict):
    """A memo table bounded in bytes: ``memo[key]`` computes on a miss.

    Keys longer than ``LONGEST`` aren't kept, and a full table starts anew, so it never takes more than
    ``most`` bytes, whatever the texts. Bound to a worker process: its later tasks find it filled.
    """

    LONGEST = 64
    #: What an entry takes beside its key and value.
    ENTRY = 64

    def __init__(self, make: Callable[[Any], Any], most: int) -> None:
        super().__init__()
        self.make, self.most, self.room = make, most, most

    def __missing__(self, key: Any) -> Any:
        value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key: Any, value: Any) -> None:
        if len(key) > self.LONGEST:
            return
        self.room -= self.ENTRY + sys.getsizeof(key) + sys.getsizeof(value)
        if self.room < 0:
            self.clear()
            self.room = self.most - self.ENTRY - sys.getsizeof(key) - sys.getsizeof(value)
        self[key] = value


_tool: tuple[Hashable, Any] | None = None


def tool(name: Hashable, make: Callable[[], Any]) -> Any:
    """A large helper (tokenizer, automaton, memo table) of a worker process, made once.

    A worker keeps one: asking for another drops the one before and gives its memory back, so that the
    stages of a pipeline, which share workers, don't add up.
    """
    global _tool
    if _tool is None or _tool[0] != name:
        _tool = None
        give_back()
        _tool = name, make()
    return _tool[1]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _slot(keys: list[str]) -> Any:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_WORDS * 64))


def _bits(ids: DataFrame, keys: list[str]) -> DataFrame:
    """A one-hash Bloom filter of ``ids`` as at most FILTER_WORDS rows (word, bits)."""
    slot = _slot(keys)
    return (
        ids.select(F.shiftright(slot, 6).cast("int").alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("__bit"))
        .groupBy("__word")
        .agg(F.bit_or("__bit").alias("__bits"))
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def marked(df: DataFrame, ids: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``df`` with a further column, last, and that column: false where a fixed-size filter rules out that its keys are in ``ids``."""
    word, bits = free_name(df, "__word"), free_name(df, "__bits")
    hit = free_name(df, "__hit")
    slot = _slot(keys)
    found = F.coalesce(F.getbit(bits, F.pmod(slot, F.lit(64)).cast("int")) == 1, F.lit(False))
    filtered = df.withColumn(word, F.shiftright(slot, 6).cast("int")).join(F.broadcast(_bits(ids, keys).toDF(word, bits)), word, "left")
    return filtered.withColumn(hit, found).select(*(F.col(f"`{c}`") for c in df.columns), hit), F.col(hit)


def keep_ids(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``ids``: a fixed-size filter spares the shuffle of most others."""
    both, hit = marked(df, ids, keys)
    return both.filter(hit).drop(hit).join(ids.select(*keys), keys, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))


def drop_ids(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys aren't in ``ids`` (null keys stay).

    Only what a fixed-size filter can't rule out is shuffled for the exact anti-join; a fuller
    filter sends more rows that way, never other results.
    """
    both, hit = marked(df, ids, keys)
    sure = both.filter(~hit).drop(hit)
    rest = both.filter(hit).drop(hit).join(ids.select(*keys), keys, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    return sure.unionByName(rest)


def append_columns(df: DataFrame, column: str, make: Callable[[list[str]], list[list[Any]]], fields: list[tuple[str, pa.DataType, str]], replace: bool = False) -> DataFrame:
    """``df`` with columns computed from one text column, batch by batch, all others passed through.

    ``make`` gets texts (null: empty) and returns one list a field; a field is (name, Arrow type,
    Spark type). With ``replace`` the first field takes the place of ``column`` (null stays null).
    """
    small_batches(df.sparkSession)
    at = df.columns.index(column)
    added = fields[1:] if replace else fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {t}" for n, _, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            made = [pa.array(values, kind) for values, (_, kind, _) in zip(make([t or "" for t in texts]), fields, strict=True)]
            arrays = list(batch.columns)
            if replace:
                first = made.pop(0)
                arrays[at] = pa.array([None if old is None else new for old, new in zip(texts, first.to_pylist(), strict=True)], fields[0][1])
            yield pa.RecordBatch.from_arrays(arrays + made, names=[*batch.schema.names, *(n for n, _, _ in added)])

    return df.mapInArrow(run, schema)
