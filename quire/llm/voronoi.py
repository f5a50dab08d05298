"""Exact top-k by inner product as a Voronoi kNN join.

Queries and data are grouped by their nearest pivot; there are as many pivots as half the root of the
rows. Each query is first solved within its own cell, which gives every query cell a floor: the least
score that is k-th best there. From the cells' summaries alone (pivot, radius, greatest norm, count)
follow upper bounds on any inner product between a query cell and a data cell, by Cauchy-Schwarz and by
the triangle inequality; data cells whose bound stays below the floor aren't sent there. What is sent is
dealt in blocks of bounded size on both sides, solved block by block, and the best of each query merged.

Query cells that need more than half of the rows are solved together, so that those rows are sent once
and not once a cell. On vectors without clusters, where no bound excludes anything, that is all of them.

Components become floor(1024 * x); scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import slices, stash

SCALE = 1024
#: Most pivots, which bounds what is collected and broadcast; rows expected in a block of data and in one of queries.
MOST_PIVOTS, CHUNK, QUERY_BLOCK = 1024, 8192, 8192
#: The group of the query cells that need more than this share of the rows.
COMMON, COMMON_SHARE = -1, 0.5


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two int64 matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    raise OverflowError("a score may not fit a 64-bit integer")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(row, vec_id, v, is_query) with the vector packed and padded, its cell, distance to the cell's pivot and norm, rounded up."""
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("is_query", pa.bool_()), ("packed", pa.binary()), ("cell", pa.int32()), ("far", pa.float64()), ("norm", pa.float64())])
    centre, width = pivots.astype(np.float64), pivots.shape[1]
    squares = (centre**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            v = np.zeros((batch.num_rows, width), np.int64)
            for at, vector in enumerate(batch.column(2).to_pylist()):
                v[at, : len(vector)] = vector
            real = v.astype(np.float64)
            cell = (squares - 2 * real @ centre.T).argmin(1)
            up = lambda x: x * (1 + 1e-9) + 1e-6
            far, norm = up(np.sqrt(((real - centre[cell]) ** 2).sum(1))), up(np.sqrt((real**2).sum(1)))
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("row", "vec_id", "v", "is_query").mapInArrow(run, "row long, vec_id long, is_query boolean, packed binary, cell int, far double, norm double")


@dataclass
class Cell:
    """What is known of a cell: how many rows and queries, how far they reach, and the queries' floor."""

    rows: int
    far: float
    norm: float
    queries: int = 0
    query_far: float = 0.0
    query_norm: float = 0.0
    floor: float = -np.inf


def needed_cells(pivots: np.ndarray, cells: dict[int, Cell]) -> dict[int, list[int]]:
    """Query cell → other data cells that may hold one of its queries' k best, by the floors and bounds."""
    p = pivots.astype(np.float64)
    length = np.sqrt((p**2).sum(1))
    js = np.array(sorted(cells))
    far, norm = (np.array([getattr(cells[j], f) for j in js]) for f in ("far", "norm"))
    out: dict[int, list[int]] = {}
    for i, c in cells.items():
        if not c.queries:
            continue
        dots = p[js] @ p[i]
        cauchy = dots + c.query_far * length[js] + np.minimum(length[i] + c.query_far, c.query_norm) * far
        apart = np.maximum(0.0, np.sqrt(np.maximum(0.0, length[js] ** 2 + length[i] ** 2 - 2 * dots)) - c.query_far - far)
        triangle = (c.query_norm**2 + norm**2 - apart**2) / 2
        bound = np.minimum(np.minimum(cauchy, triangle), c.query_norm * norm)
        rounding = 1e-6 * (1 + np.abs(dots) + c.query_norm**2 + norm**2)
        out[i] = [int(j) for j in js[bound + rounding >= c.floor] if j != i]
    return out


def _solved(asked: DataFrame, data: DataFrame, k: int, width: int, own: bool) -> DataFrame:
    """(row, query_id, cell, vec_id, other, score): the k best of a block for each query of a block.

    Both sides have group, part and chunk. With ``own`` rows of the query's own cell count, else only those of other cells.
    """

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ids, of = (right.column(c).to_numpy() for c in ("row", "vec_id", "cell"))
        q_rows, q_ids, q_cells = (left.column(c).to_numpy() for c in ("row", "vec_id", "cell"))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(rows) and len(q_rows):
            matrix = _matrix(right.column("packed"), width)
            for start in range(0, len(q_rows), 256):
                table = products(_matrix(left.column("packed").slice(start, 256), width), matrix)
                for at, score in enumerate(table, start):
                    able = np.flatnonzero(rows != q_rows[at] if own else of != q_cells[at])
                    s = score[able]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        able = able[s >= least]
                        s = s[s >= least]
                    best = np.lexsort((rows[able], ids[able], -s))[:k]
                    found.append((at, able[best], s[best]))
        at = np.concatenate([np.full(len(a), q) for q, a, _ in found]).astype(int) if found else np.empty(0, int)
        of_data = np.concatenate([a for _, a, _ in found]) if found else np.empty(0, int)
        score = np.concatenate([s for _, _, s in found]) if found else np.empty(0, np.int64)
        columns = [q_rows[at], q_ids[at], q_cells[at], ids[of_data], rows[of_data], score]
        return pa.table({n: pa.array(c, t) for (n, t), c in zip((("row", pa.int64()), ("query_id", pa.int64()), ("cell", pa.int32()), ("vec_id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())), columns, strict=True)})

    keys = ["group", "part", "chunk"]
    return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "row long, query_id long, cell int, vec_id long, other long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _met(placed: DataFrame, sends: list[tuple[int, int]], asks: dict[int, int], cells: dict[int, Cell]) -> tuple[DataFrame, DataFrame]:
    """Queries and data by group, part (a block of queries) and chunk (a block of data).

    ``sends`` has (data cell, group), ``asks`` the group of each query cell. Both go to the rows as a table of at most
    MOST_PIVOTS**2 / 2 small rows.
    """
    spark = placed.sparkSession
    rows, queries = dict.fromkeys(asks.values(), 0), dict.fromkeys(asks.values(), 0)
    for j, group in sends:
        rows[group] += cells[j].rows
    for i, group in asks.items():
        queries[group] += cells[i].queries
    size = lambda group: (max(1, ceil(queries[group] / QUERY_BLOCK)), max(1, ceil(rows[group] / CHUNK)))
    of = "cell int, group int, parts int, chunks int"
    to = spark.createDataFrame([(j, group, *size(group)) for j, group in sends], of)
    at = spark.createDataFrame([(i, group, *size(group)) for i, group in asks.items()], of)
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = [F.col(c).alias(c) for c in ("row", "vec_id", "cell", "packed", "group", "part", "chunk")]  # new columns: both sides come of one table
    data = placed.join(F.broadcast(to), "cell").withColumn("chunk", deal("chunks", 1)).withColumn("part", every("parts")).select(*kept)
    asked = placed.filter("is_query").join(F.broadcast(at), "cell").withColumn("part", deal("parts", 2)).withColumn("chunk", every("chunks")).select(*kept)
    return asked, data


@dataclass
class Prepared:
    """Rows in their cells, the best within each query's own cell, and which other cells each query cell needs."""

    placed: DataFrame
    own: DataFrame
    cells: dict[int, Cell]
    needed: dict[int, list[int]]
    width: int


def prepare(embeddings: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> Prepared:
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = stash(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", quantised(F.col("v")).alias("v"), "is_query"), "vectors")
    whole = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width, wanted = whole["width"] or 1, max(1, min(MOST_PIVOTS, isqrt(whole["n"]) // 2))
    pivots = np.zeros((wanted, width), np.int64)
    for at, r in enumerate(rows.orderBy(F.xxhash64("row"), "row").limit(wanted).select("v").collect()):
        pivots[at, : len(r["v"])] = r["v"]

    placed = stash(_cells(rows, pivots), "cells")
    asked = F.col("is_query")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"), F.count(F.when(asked, 1)).alias("q"), F.max(F.when(asked, F.col("far"))).alias("qf"), F.max(F.when(asked, F.col("norm"))).alias("qn")).collect()
    cells = {s["cell"]: Cell(s["n"], s["far"], s["norm"], s["q"], s["qf"] or 0.0, s["qn"] or 0.0) for s in summary}
    home = {i: i for i, c in cells.items() if c.queries}
    own = stash(_best(_solved(*_met(placed, list(home.items()), home, cells), k, width, own=True), k).drop("rank"), "own")
    worst = own.groupBy("cell", "row").agg(F.count("*").alias("n"), F.min("score").alias("s")).groupBy("cell").agg(F.min("n").alias("n"), F.min("s").alias("s"), F.count("*").alias("q")).collect()
    for w in worst:
        if w["n"] == k and w["q"] == cells[w["cell"]].queries:  # each query of the cell has k rows there
            cells[w["cell"]].floor = float(w["s"])
    return Prepared(placed, own, cells, needed_cells(pivots, cells), width)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores, ties to smaller vec_id.

    Candidates are all rows but the query's own row; rows that repeat a vec_id are each a candidate, and
    each a query of its own. Vectors that are null, empty or hold null or non-finite components, and null
    ids, take no part; shorter vectors count as padded with zeros. Other columns are ignored, whatever
    their names. Fewer than k candidates give all; empty tables none.
    """
    ready = prepare(embeddings, is_query, k, vec_id, vector)
    total = sum(c.rows for c in ready.cells.values())
    groups = {i: COMMON if sum(ready.cells[j].rows for j in js) > COMMON_SHARE * total else i for i, js in ready.needed.items()}
    sends = sorted({(j, groups[i]) for i, js in ready.needed.items() for j in js})
    rest = _solved(*_met(ready.placed, sends, groups, ready.cells), k, ready.width, own=False)
    return _best(ready.own.unionByName(rest), k).select("query_id", F.col("rank"), "vec_id", "score")
