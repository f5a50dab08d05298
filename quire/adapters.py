"""How the driver's tables stand in for pages, words, jobs and events.

These adapters are choices of this library: ``embeddings`` are 8x8 grey pages, ``documents`` pages of
words, ``orders`` jobs, ``lineitem`` their pages, ``events`` progress events. Each has a SQL twin in
``*_SQL`` (a CTE body) that the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grey_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, width, height, px (array<int>, row-major, 0 to 255)."""
    px = F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), px.alias("px"))


PAGES_SQL = "pg AS (SELECT vec_id AS page_id, list_transform(embedding, lambda v: CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.5) * 255), 0), 255) AS INTEGER)) AS px FROM embeddings)"
PIXELS_SQL = PAGES_SQL + ", pix AS (SELECT page_id, unnest(px) AS g, generate_subscripts(px, 1) - 1 AS i FROM pg)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, idx, text, line, x0, confidence: the words of each document."""
    lines = F.transform(F.split("text", "\n"), lambda line, at: F.transform(F.split(line, " "), lambda word, pos: F.struct(at.alias("line"), pos.alias("pos"), word.alias("text"))))
    numbered = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.flatten(lines)).alias("idx", "w"))
    return numbered.select("page_id", "w.line", "w.pos", "w.text", "idx", ((F.col("page_id") * 31 + F.col("idx") * 17) % 101).cast("long").alias("confidence"))


WORDS_SQL = """ln AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
wd0 AS (SELECT page_id, line, unnest(string_split(line_text, ' ')) AS text, generate_subscripts(string_split(line_text, ' '), 1) - 1 AS pos FROM ln),
wd1 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line, pos) - 1 AS idx FROM wd0),
wd AS MATERIALIZED (SELECT page_id, line, pos, text, idx, CAST((page_id * 31 + idx * 17) % 101 AS BIGINT) AS confidence FROM wd1)"""

BOX = {"x_px": 7, "word_px": 9, "line_px": 22, "image_w": 1275, "image_h": 1650}


def boxed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with pixel boxes laid out by place in line and line number."""
    w = words(spark, sf_dir)
    return w.withColumns({
        "left": (F.col("pos") * 60 % BOX["image_w"]).cast("long"),
        "right": (F.col("pos") * 60 % BOX["image_w"] + F.length("text") * BOX["word_px"]).cast("long"),
        "top": (F.col("line") * BOX["line_px"] % BOX["image_h"]).cast("long"),
        "bottom": (F.col("line") * BOX["line_px"] % BOX["image_h"] + 16).cast("long"),
    })


BOXED_SQL = WORDS_SQL + ", bw AS (SELECT *, CAST(pos * 60 % 1275 AS BIGINT) AS left_, CAST(pos * 60 % 1275 + length(text) * 9 AS BIGINT) AS right_, CAST(line * 22 % 1650 AS BIGINT) AS top_, CAST(line * 22 % 1650 + 16 AS BIGINT) AS bottom_ FROM wd)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, seq, input_path, status, started_at, finished_at (ms), priority."""
    o = table(spark, sf_dir, "orders")
    status = F.create_map(*[F.lit(x) for x in ("F", "completed", "O", "queued", "P", "running")])[F.col("o_orderstatus")]
    day = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("/in/Batch "), F.col("o_custkey") % 7, F.lit("/"), F.concat(F.lit("scan"), F.col("o_custkey")), F.when(F.col("o_orderkey") % 5 == 0, ".PDF").when(F.col("o_orderkey") % 11 == 0, ".txt").otherwise(".pdf")).alias("input_path"),
        status.alias("status"),
        day.alias("started_at"),
        (day + F.floor("o_totalprice").cast("long")).alias("finished_at"),
        F.col("o_orderpriority").alias("priority"),
    )


JOBS_SQL = """jb AS (SELECT o_orderkey AS job_id, o_orderkey AS seq,
  concat('/in/Batch ', o_custkey % 7, '/scan', o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN '.PDF' WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.pdf' END) AS input_path,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' END AS status,
  CAST(epoch_ms(o_orderdate) AS BIGINT) AS started_at, CAST(epoch_ms(o_orderdate) + CAST(floor(o_totalprice) AS BIGINT) AS BIGINT) AS finished_at, o_orderpriority AS priority FROM orders)"""


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, page_number (from 1), page_ms, has_text, message (an error on some pages)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    page = F.row_number().over(w)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        page.alias("page_number"),
        F.col("l_quantity").cast("long").alias("page_ms"),
        (F.col("l_returnflag") == "R").alias("has_text"),
        F.when(F.col("l_partkey") % 13 == 0, F.concat(F.lit("no image in part "), F.col("l_partkey"))).alias("message"),
    )


JOB_PAGES_SQL = """jp AS (SELECT l_orderkey AS job_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS page_number,
  CAST(l_quantity AS BIGINT) AS page_ms, l_returnflag = 'R' AS has_text, CASE WHEN l_partkey % 13 = 0 THEN concat('no image in part ', l_partkey) END AS message FROM lineitem)"""


def as_job_events(e: DataFrame) -> DataFrame:
    """event_id, job_id, at_ms, status, current_page, message of a table or stream of events."""
    status = F.create_map(*[F.lit(x) for x in ("signup", "queued", "view", "processing", "click", "ocr", "purchase", "completed", "error", "failed")])[F.col("event_type")]
    return e.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        status.alias("status"),
        F.get_json_object("props", "$.k").cast("long").alias("current_page"),
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "Password required").when(F.col("event_id") % 3 == 1, "file is ENCRYPTED").otherwise("broken xref")).alias("message"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "events"))


EVENTS_SQL = """ev AS (SELECT event_id, user_id AS job_id, CAST(epoch_ms(ts) AS BIGINT) AS at_ms,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'ocr' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS current_page,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Password required' WHEN 1 THEN 'file is ENCRYPTED' ELSE 'broken xref' END END AS message FROM events)"""
