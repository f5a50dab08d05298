"""Queue, history and event operators: every rule is keyed by id and totally ordered, never positional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_LIMIT, LOG_LIMIT, THROTTLE_MS = 100, 500, 50

#: The built-in profiles, in the order in which they are matched.
PROFILE_FIELDS = "name string, ord int, memory_pages int, binarization string, fixed_threshold int, deskew string, denoise_level int, existing_text string, psm string, compression string, resolution string, archive boolean, languages array<string>, safe_mode boolean, continue_on_error boolean"
PROFILES = [
    ("balanced", 0, 30, "otsu", 128, "radon", 2, "skip", "auto", "flate", "300", False, ["eng", "spa"], False, False),
    ("max-compression", 1, 15, "otsu", 128, "radon", 4, "rasterize", "auto", "ccitt", "150", False, ["eng", "spa"], False, False),
    ("high-fidelity", 2, 50, "fixed", 128, "radon", 0, "skip", "auto", "flate", "600", True, ["eng", "spa"], False, False),
]


def profiles(spark) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_FIELDS)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; ``order`` must be total within a key. Combined before its shuffle."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = df.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in (*order, *rest)))


def output_names(df: DataFrame, stem: str, order: str, taken: DataFrame) -> DataFrame:
    """Adds output_name: <stem>_cleaned.pdf, then _1, _2, …; names in ``taken`` (output_name) are skipped.

    Unique within the batch too. The n-th job of a stem gets the n-th free number.
    """
    base = F.concat(F.col(stem), F.lit("_cleaned"))
    used = taken.select(F.regexp_extract("output_name", r"^(.*_cleaned)(?:_(\d+))?\.pdf$", 1).alias("__base"), F.coalesce(F.nullif(F.regexp_extract("output_name", r"^(.*_cleaned)(?:_(\d+))?\.pdf$", 2), F.lit("")), F.lit("0")).cast("long").alias("__n")).filter("__base <> ''").distinct()
    used = used.groupBy("__base").agg(F.array_sort(F.collect_set("__n")).alias("__used"))
    nth = F.row_number().over(Window.partitionBy(stem).orderBy(order)) - 1
    rows = df.withColumn("__base", base).withColumn("__nth", nth.cast("long")).join(used, "__base", "left")
    # The n-th number outside a sorted list: every used number at or below the answer pushes it up by one.
    free = F.aggregate(F.coalesce("__used", F.array().cast("array<long>")), F.col("__nth"), lambda acc, u: F.when(u <= acc, acc + 1).otherwise(acc))
    return rows.withColumn("output_name", F.concat("__base", F.when(free > 0, F.concat(F.lit("_"), free.cast("string"))).otherwise(""), F.lit(".pdf"))).drop("__base", "__nth", "__used")


def throttled(df: DataFrame, key: str, at: str, order: str, gap_ms: int = THROTTLE_MS) -> DataFrame:
    """Keeps an event if it comes ``gap_ms`` or more after the last one kept of its key.

    The rule is sequential, so each key is folded in order, in bounded memory, by sorted Arrow batches.
    """
    import pyarrow as pa

    names = df.columns

    def run(batches):
        now, last = None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index(at)).to_pylist(), strict=True):
                if k != now:
                    now, last = k, None
                keep.append(last is None or t - last >= gap_ms)
                if keep[-1]:
                    last = t
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(key).sortWithinPartitions(key, at, order).mapInArrow(run, df.schema)


def status_label(status: Column) -> Column:
    """Backend status → list status."""
    return F.when(status == "running", "processing").when(status == "completed", "complete").when(status == "failed", "error").when(status == "cancelled", "paused").otherwise("pending")


def percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100.0 * current / total + 0.5)).otherwise(0).cast("long")


def error_kind(message: Column) -> Column:
    return F.when(message.isNull(), None).when(F.lower(message).rlike("encrypt|password"), "encrypted").otherwise("pipeline")
