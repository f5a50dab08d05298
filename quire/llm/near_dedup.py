"""Near-duplicate groups by MinHash bands, Odd sketches and exact confirmation.

1. One pass reads every whole text and makes, of its set of word shingles, a 128-bit key, its size,
   MinHash band keys and an Odd sketch (the MinHash samples folded into a parity bitmap).
2. Documents with equal sets become one class; only its least doc_id takes part below, so a group of
   exact copies costs one row a task.
3. Classes that share a band key are candidates. Round one compares each with the least of its
   bucket. After it, what of a bucket lies outside the bucket's largest component is compared with one
   pivot of that component, another one for every bucket, and in the last round with all members of other
   components, by longer Odd sketches made for those buckets alone. No round writes the pairs of a
   bucket: the population count of the XOR of two sketches is part of the join condition, and in the
   last round a pair counts in its first common band only. Large buckets are dealt in salted parts.
4. Candidates are confirmed on their full shingle sets, read again from the texts.
5. Links give components; later rounds only contract those of the round before.

With 45 bands of 6 rows a pair at similarity 0.8 meets in no band with probability 1.2e-6, and the
sketch limits lie five standard deviations beyond what similarity 0.8 gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, drop_ids, keep_ids, release, rows_of, slices, stash, tool, utf8
from quire.llm.components import components

BANDS, ROWS, SKETCH_WORDS = 45, 6, 8
#: Differing bits of two Odd sketches of 512 bits beyond which a pair at similarity 0.8 isn't met.
SKETCH_LIMIT = 150
#: Least similarity that bands and limits are laid out for.
LEAST_PERCENT = 80
#: The longer sketches of the last round: samples, 64-bit words and the like limit.
LONG_SAMPLES, LONG_WORDS, LONG_LIMIT = 2048, 128, 905
#: Members of a bucket that one part of it is expected to hold in the last round.
PART = 4096
#: Bytes of the memo table of a worker.
MEMO_BYTES = 40 << 20

U = np.uint64
M1, M2, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def _words() -> Memo:
    return tool("words", lambda: Memo(xxhash.xxh3_64_intdigest, MEMO_BYTES))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a UTF-8 text, A-Z lower-cased.

    Words are what lies between ASCII white space. Fewer than k words make one shingle, none make none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(_words().__getitem__, words), U, n)
    width = min(k, n)
    out = np.full(n - width + 1, U(width))
    for i in range(width):
        out = mix(out * STEP + h[i : i + len(out)])
    return np.unique(out)


@lru_cache(maxsize=2)
def _family(samples: int) -> tuple[np.ndarray, np.ndarray]:
    ks = np.arange(1, samples + 1, dtype=U)
    return (mix(ks * STEP) >> U(32)).astype(np.uint32) | np.uint32(1), (mix(ks * STEP + U(77)) >> U(32)).astype(np.uint32)


def minhashes(hashes: np.ndarray, samples: int = BANDS * ROWS, block: int = 2048) -> np.ndarray:
    """MinHash samples of a non-empty set, by multiply-add permutations of 32-bit words."""
    a, b = _family(samples)
    h = (hashes >> U(32)).astype(np.uint32)
    best = None
    for at in range(0, len(h), block):
        part = np.multiply.outer(h[at : at + block], a)
        part += b
        low = part.min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.astype(U).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=U) * STEP
    for r in range(ROWS):
        out = mix(out + rows[:, r] * M1)
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity of how many (place, sample) pairs hash to each of 64 * words bits."""
    at = mix(samples.astype(U) + (np.arange(1, len(samples) + 1, dtype=U) << U(32))) % U(64 * words)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set_key, n, bands, sketch of (doc_id, text); set_key is null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for text in utf8(batch.column(1)):
                s = shingles(text or b"", k)
                if len(s):
                    samples = minhashes(s)
                    row = xxhash.xxh3_128_digest(s.tobytes()), len(s), band_keys(samples), odd_sketch(samples)
                else:
                    row = None, 0, None, None
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, set_key binary, n long, bands array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None
        for batch in slices(batches):
            keep = []
            for a, b in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if a != last_text:
                    last_text, last = a, shingles(a, k)
                other = shingles(b, k)
                both = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last) + len(other) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    with_v = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    with_u = with_v.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    return with_u.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def long_sketches(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, long (array of LONG_WORDS) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [odd_sketch(minhashes(shingles(t, k), LONG_SAMPLES), LONG_WORDS) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "long"])

    return texts.mapInArrow(run, "doc_id long, long array<long>")


def _sizes(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")


def _close(a: str, b: str) -> F.Column:
    """The Odd-sketch filter for two aliased class rows."""
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return differ <= SKETCH_LIMIT


def _close_long(a: str, b: str) -> F.Column:
    differ = F.aggregate(F.zip_with(f"{a}.long", f"{b}.long", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return differ <= LONG_LIMIT


def _first_common_band(a: str, b: str) -> F.Column:
    """The band at ``a.at`` is the first that both have."""
    return ~F.exists(F.sequence(F.lit(1), F.col(f"{a}.at")), lambda i: (i < F.col(f"{a}.at")) & (F.element_at(f"{a}.bands", i) == F.element_at(f"{b}.bands", i)))


def _apart(placed: DataFrame) -> DataFrame:
    """(band, at, node, root) with top, pivot and size of their bucket, where it holds more than one component.

    ``top`` is the component with most members there, ``pivot`` one of its members, another one for each band.
    """
    parts = placed.groupBy("band", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "band").alias("h"), F.col("node"))).alias("least"))
    largest = F.max(F.struct("n", (-F.col("root")).alias("r"), F.col("least.node").alias("pivot"))).alias("largest")
    whole = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), largest).filter("parts > 1")
    whole = stash(whole.select("band", (-F.col("largest.r")).alias("top"), "largest.pivot", "size"), "apart")
    return placed.select("band", "at", "node", "root").join(whole, "band")


def _moved(roots: DataFrame, links: DataFrame, column: str = "root") -> DataFrame | None:
    """(root, to) for those of the components ``roots`` (node, root) that ``links`` (u, v) join; None without any."""
    ends = links.join(roots.withColumnsRenamed({"node": "u", "root": "ru"}), "u", "left").join(roots.withColumnsRenamed({"node": "v", "root": "rv"}), "v", "left")
    pairs = stash(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).filter("u <> v").distinct(), "joined")
    if pairs.isEmpty():
        return None
    return stash(components(pairs).select(F.col("node").alias(column), F.col("root").alias("to")), "moved")


def _after(rows: DataFrame, moved: DataFrame | None) -> DataFrame:
    """``rows`` with their root brought up to date; a node without one stands for itself."""
    if moved is None:
        return rows
    return rows.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to").select(*rows.columns)


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    ``component_id`` is the least doc_id reachable over links of ``percent`` similarity of k-word
    shingle sets; ``kept`` marks it. ``percent`` below 80 raises, as bands and sketch limits are laid out
    for that. Texts that are null or without words have an empty set and no links. Rows that repeat a
    doc_id are one document: its links are those of all of its rows. A null doc_id takes no part:
    component_id null, kept true. Other columns are ignored, whatever their names; very long texts are
    read whole. An empty table gives an empty result.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"similarities below {LEAST_PERCENT} percent need other bands and sketch limits")
    docs = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"))
    sig = stash(signatures(docs, k), "signatures")
    usable = sig.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")

    sketch = [F.first(F.col("sketch")[i]).alias(f"s{i}") for i in range(SKETCH_WORDS)]
    classes = stash(usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), *sketch), "classes")
    facts = classes.drop("bands", "set_key")

    bands = classes.select("node", F.posexplode("bands").alias("at", "band"))
    shared = stash(bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("top")).filter("low < top").drop("top"), "shared")
    members = stash(bands.join(shared, "band").select("band", F.expr("at + 1").alias("at"), "node", "low"), "members")
    texts = stash(keep_ids(docs, members.select(F.col("node").alias("doc_id")).distinct(), ["doc_id"]), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among pairs (u < v), by size, Odd sketch and then the texts."""
        p = pairs.distinct().alias("p")
        met = p.join(facts.alias("b"), F.col("p.v") == F.col("b.node")).join(facts.alias("a"), F.col("p.u") == F.col("a.node"))
        return confirmed(met.filter(_sizes("a", "b", percent) & _close("a", "b")).select("p.u", "p.v"), texts, k, percent)

    # Round one: against the least node of each bucket. Rows that repeat a doc_id with different texts tie their classes together.
    links = linked(members.filter("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v")))
    of_row = usable.select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
    twice = of_row.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("top")).filter("u < top")
    links = links.union(of_row.join(twice, "doc_id").filter("node <> u").select("u", F.col("node").alias("v")))
    roots = stash(components(stash(links, "links")), "roots")

    # Round two: what is outside the largest component of its bucket against a pivot of that.
    placed = members.select("band", "at", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stash(_apart(placed.select("band", "at", "node", "root")), "placed")
    star = placed.filter("root <> top").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
    moved = _moved(roots, linked(star))
    if moved is not None:
        placed = stash(_apart(_after(placed, moved)), "placed")
        roots = stash(_after(roots, moved).union(moved.select(F.col("root").alias("node"), F.col("to").alias("root")).join(roots, "node", "left_anti")), "roots")

    # Last round: against every member of the other components.
    nodes = stash(placed.select("node").distinct(), "nodes")
    sketched = long_sketches(texts.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select("doc_id", "text"), k).withColumnRenamed("doc_id", "node")
    full = stash(placed.drop("pivot").join(stash(nodes.join(classes.drop("set_key"), "node").join(sketched, "node"), "sketches"), "node"), "full")
    parts = F.ceil(F.col("size") / PART).cast("int")
    a = full.filter("root <> top").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("a")
    b = full.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).alias("b")
    other = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.top")) | (F.col("a.node") < F.col("b.node")))
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & other
    rest = a.join(b, same & _sizes("a", "b", percent) & _close("a", "b") & _close_long("a", "b") & _first_common_band("a", "b"))
    pairs = stash(rest.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")), "pairs")
    release(full)
    moved = _moved(roots, confirmed(pairs, texts, k, percent))
    release(shared, members, texts, placed, nodes, pairs)

    found = _after(classes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root")), moved)
    least = F.coalesce("root", "doc_id")
    return sig.select("doc_id", "set_key", F.col("n").alias("n_shingles")).join(found, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), least).alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that of the least doc_id.

    All columns stay, whatever their names. Rows that repeat a doc_id are one document and stay or go together;
    null ids, null and empty texts stay; an empty table comes back empty.
    """
    groups = near_groups(docs, k, percent).filter("NOT kept").select("doc_id").distinct()
    return drop_ids(docs, stash(groups, "dropped"), ["doc_id"])
