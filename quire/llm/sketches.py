"""Threshold-scaled document fingerprints, in DataFrame functions only.

A fingerprint keeps the hash of every two-word shingle that lies below a fixed fraction of the hash
range, and the least hash besides, so that no text with words has an empty one. Two fingerprints merge
by union (the least of the leasts stays, others above the threshold go), and containment or likeness
of two texts is estimated on the hashes alone, however unequal their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import keep_ids, rows_of, stash

#: A quarter of the signed 64-bit range lies below this.
THRESHOLD = -(1 << 62)
#: Documents expected in a range of ids, and at most so many ranges with bounds of their own.
RANGE_ROWS, CELLS = 2000, 1024


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def shingle_hashes(word: Column) -> Column:
    """Hashes of adjacent word pairs of a word array; a lone word counts alone."""
    pairs = F.zip_with(word, F.slice(word, F.lit(2), F.size(word)), lambda a, b: F.xxhash64(a, b))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(word) - 1, F.lit(1)))


def scaled(hashes: Column) -> Column:
    below = F.filter(hashes, lambda h: h < THRESHOLD)
    return F.sort_array(F.array_distinct(F.when(F.size(below) > 0, below).otherwise(F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull()))))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text column as a sorted array of longs."""
    return df.withColumn("__words", words(F.coalesce(text, F.lit("")))).withColumn("__hashes", shingle_hashes(F.col("__words"))).withColumn(name, scaled(F.col("__hashes"))).drop("__words", "__hashes")


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' shingles together (but for the pair across their border)."""
    return scaled(F.array_union(a, b))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all, 0 to 1; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's hashes that b has, 0 to 1; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _ranges(ids: DataFrame) -> Column:
    """The range of a row (key, tie): cells between approximate quantiles of the keys, each cut evenly where rows are very many.

    A key that several quantiles share holds as many cells, and its rows are dealt to them by their tie, the
    hash of their text: a document that repeats a million times isn't one range.
    """
    n = ids.count()
    cells = max(1, min(CELLS, -(-n // RANGE_ROWS)))
    cuts = max(1, -(-n // (cells * RANGE_ROWS)))
    if cells == 1:
        return F.lit(0).cast("long")
    least, *bounds, most = sorted(ids.agg(F.percentile_approx("key", [i / cells for i in range(cells + 1)], 10 * cells).alias("b")).first()["b"])
    below = F.size(F.filter(F.lit(bounds), lambda b: b < F.col("key"))).cast("long")
    shared = F.size(F.filter(F.lit(bounds), lambda b: b == F.col("key")))
    place = (F.shiftright("tie", 32).cast("double") + 2.0**31) / 2.0**32 * shared  # 0 to the number of cells that the key holds
    cell = F.when(shared > 0, below + 1 + F.least(F.floor(place), shared - 1)).otherwise(below)
    if cuts == 1:
        return cell
    distinct = sorted(set(bounds))
    low, high = F.lit([least, *distinct]), F.lit([*distinct, most])
    at = (F.size(F.filter(F.lit(distinct), lambda b: b <= F.col("key"))) + 1).cast("int")
    width = F.element_at(high, at).cast("double") - F.element_at(low, at).cast("double")
    by_key = F.floor((F.col("key").cast("double") - F.element_at(low, at).cast("double")) / F.greatest(width, F.lit(1.0)) * cuts)
    # Behind a key that holds several cells, later keys go on in the last of them: they come after all of its parts.
    part = F.when(shared > 1, F.floor((place - F.floor(place)) * cuts)).when(shared == 1, F.lit(0)).otherwise(F.greatest(by_key, F.lit(0)) + cuts)
    return cell * (1 << 32) + F.least(part, F.lit(2 * cuts - 1)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """(key, tie, text) with next_text, the text that follows in descending key and tie (after the last: the first).

    Each range of rows is one window, and the first row of the following range is sent to it as a
    guest, so texts are shuffled once. Adds __range, __guest; guests stay as rows for later windows.
    """
    placed = docs.withColumn("__range", _ranges(docs.select("key", "tie")))
    heads = placed.groupBy("__range").agg(F.max(F.struct("key", "tie")).alias("h"))
    order = Window.orderBy(F.desc("h"))  # one row a range: a few thousandths of the documents, 24 bytes each
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = stash(heads.select("__range", F.coalesce(F.lead("h").over(order), F.max("h").over(everything)).alias("h")).select("__range", F.col("h.key").alias("key"), F.col("h.tie").alias("tie")), "heads")
    guests = keep_ids(docs, heads.select("key", "tie").distinct(), ["key", "tie"]).dropDuplicates(["key", "tie"]).join(heads, ["key", "tie"]).withColumn("__guest", F.lit(1))
    return placed.withColumn("__guest", F.lit(0)).unionByName(guests.select(*placed.columns, "__guest"))


def following() -> Window:
    return Window.partitionBy("__range").orderBy("__guest", F.desc("key"), F.desc("tie"), "text")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the first half of the next document's. A null text is
    empty; a null doc_id comes last in descending order; rows that repeat a doc_id follow each other by
    a hash of their text; very long texts are read whole; other columns are ignored, whatever their names; the only document of a table is its own next one; an empty table gives an empty result.
    """
    base = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = base.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("tie", F.xxhash64("text"))
    rows = with_fingerprint(with_next(base).withColumn("__next", F.lead("text").over(following())), "text", "fp")
    rows = rows.withColumn("__next_fp", F.lead("fp").over(following())).filter("__guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("__next", F.lit("")), F.lit(1), half))).withColumn("n_chars", n.cast("long"))
    rows = with_fingerprint(rows.drop("text", "__next"), "__edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.coalesce("__next_fp", F.col("fp"))).alias("near_next"),
    )
