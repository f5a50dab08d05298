"""The command surface: a queue of jobs over PDF files, run as DataFrames, with a history.

Jobs are versions of one Parquet table under the engine's folder, keyed by id; a command writes the
next version whole, so a failed command leaves the one before. Only the history, of at most 100
entries, comes to the driver.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import documents, pdf, queue, recognition
from quire.sources import files
from quire.sources.scratch import scratch_path
from quire.streaming import events

JOBS = "id string, seq long, input_path string, output_path string, status string, percent int, started_at long, finished_at long, options map<string,string>, error_message string"

#: From (id, input_path, output_path, options, password) to (id, error): what is done with each job; a null error is success.
Process = Callable[[DataFrame], DataFrame]


#: Gives the data of a language ("fast" or "standard" kind), or None where it can't be had.
Fetch = Callable[[str, str], bytes | None]
#: Bytes that a language's data has at least.
LEAST_PACK = 100
#: How failures of a document's work are told, by their kind. Fixed values.
PREFIXES = {"io": "I/O error: ", "parse": "PDF parse error: ", "recognition": "OCR FFI error: ", "channel": "Channel error: ", "panic": "Recovered panic: ", "cancelled": "Cancelled", "render": "PDFium error: ", "encrypted": "Encrypted PDF: "}


class EngineError(ValueError):
    """``kind`` is validation, io, queue, history or pipeline."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def failure(error: Column) -> Column:
    """A reason from :mod:`documents` as it is told: with the prefix of its kind."""
    lower = F.lower(error)
    kind = F.when(lower.rlike("password|encrypt"), "encrypted").when(lower.startswith("recognition"), "recognition").when(lower.startswith("render"), "render").when(lower.rlike("^no such|errno|permission"), "io").otherwise("parse")
    return F.concat(F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])[kind], error)


#: Versions of the jobs table that stay: the one before the current may still be read.
KEPT_VERSIONS = 3


def default_concurrency(cores: int) -> int:
    return min(max(cores // 2, 1), 4)


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.cancelled = spark, folder.rstrip("/"), False
        self.events_path = f"{self.folder}/events"
        #: Passwords live here only: never in the jobs table, the history or a log.
        self.passwords: dict[str, str] = {}
        known = files.names(spark, f"{self.folder}/jobs") if files.exists(spark, f"{self.folder}/jobs") else []
        whole = (int(n.rpartition("=")[2]) for n in known if files.exists(spark, f"{self.folder}/jobs/{n}/_SUCCESS"))
        self.version = max(whole, default=-1)

    def _at(self, version: int) -> str:
        return f"{self.folder}/jobs/version={version}"

    def _put(self, jobs: DataFrame) -> None:
        jobs.select(*(part.split()[0] for part in JOBS.split(", "))).write.mode("overwrite").parquet(self._at(self.version + 1))
        self.version += 1
        if self.version >= KEPT_VERSIONS:
            files.remove(self.spark, self._at(self.version - KEPT_VERSIONS))
        self._tell("queueState", self.get_status().select("id", F.to_json(F.struct("id", "input_path", "output_path", "status", "percent")).alias("payload")))

    def _tell(self, channel: str, of: DataFrame) -> None:
        """Adds an event for each row (id, payload) to the event table, which streams read (:func:`events.event_stream`)."""
        at = int(time.time() * 1000)
        of.select(F.lit(channel).alias("channel"), F.lit(at).alias("at_ms"), F.col("id").alias("job_id"), "payload").write.mode("append").parquet(self.events_path)

    def events(self) -> DataFrame:
        """channel, at_ms, job_id, payload (JSON): what commands and jobs have told so far."""
        return self.spark.read.schema(events.ENGINE_EVENTS).parquet(self.events_path) if files.exists(self.spark, self.events_path) else self.spark.createDataFrame([], events.ENGINE_EVENTS)

    @property
    def history_path(self) -> str:
        return f"{self.folder}/history.json"

    def get_status(self) -> DataFrame:
        """All jobs in the order of their arrival."""
        jobs = self.spark.read.schema(JOBS).parquet(self._at(self.version)) if self.version >= 0 else self.spark.createDataFrame([], JOBS)
        return jobs.orderBy("seq")

    def get_file_metadata(self, where: str | list[str]) -> DataFrame:
        """path, name, size of files, without opening them."""
        found = self.spark.read.format("binaryFile").load(where)
        return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))

    def check_file_encrypted(self, path: str) -> bool:
        """Whether a file asks for a password; one that can't be read for another reason raises."""
        row = documents.document_pages(self.spark.read.format("binaryFile").load(path)).agg(F.max("error").alias("e")).first()
        if row["e"] is not None and not any(w in row["e"].lower() for w in ("encrypt", "password")):
            raise EngineError("pipeline", row["e"])
        return row["e"] is not None

    def enqueue(self, paths: list[str], output_folder: str, options: dict[str, Any] | None = None) -> DataFrame:
        """Adds a job a path and returns the new jobs; one bad path refuses them all.

        Output names are unique in the folder, among jobs and within the call.
        """
        if not files.exists(self.spark, output_folder, folder=True):
            raise EngineError("validation", f"no such folder: {output_folder}")
        for path in paths:
            if not files.exists(self.spark, path):
                raise EngineError("validation", f"no such file: {path}")
            if files.exists(self.spark, path, folder=True):
                raise EngineError("validation", f"not a file: {path}")
            if not path.lower().endswith(".pdf"):
                raise EngineError("validation", f"not a PDF file: {path}")
        options = {k: str(v) for k, v in (options or {}).items() if v is not None}
        password = options.pop("password", None)
        jobs, names = self.get_status(), [p.rsplit("/", 1)[1].rsplit(".", 1)[0] or "document" for p in paths]
        first = (jobs.agg(F.max("seq")).first()[0] or 0) + 1
        new = [(str(uuid.uuid4()), first + i, p, n) for i, (p, n) in enumerate(zip(paths, names, strict=True))]
        if password is not None:
            self.passwords |= {job[0]: password for job in new}
        table = self.spark.createDataFrame(new, "id string, seq long, input_path string, stem string")
        on_disk = self.spark.createDataFrame([(n,) for n in files.names(self.spark, output_folder)], "output_name string")
        taken = jobs.select(F.element_at(F.split("output_path", "/"), -1).alias("output_name")).union(on_disk)
        table = queue.output_names(table, "stem", "seq", taken).withColumn("output_path", F.concat(F.lit(output_folder.rstrip("/") + "/"), "output_name"))
        pairs = F.map_from_arrays(F.array(*map(F.lit, options)).cast("array<string>"), F.array(*map(F.lit, options.values())).cast("array<string>"))
        blank = {"status": F.lit("queued"), "percent": F.lit(0), "started_at": F.lit(None).cast("long"), "finished_at": F.lit(None).cast("long"), "options": pairs, "error_message": F.lit(None).cast("string")}
        self._put(jobs.unionByName(table.withColumns(blank).drop("stem", "output_name")))
        return self.get_status().filter(F.col("seq") >= first)

    def remove_job(self, job_id: str) -> None:
        """Only queued and cancelled jobs can go."""
        jobs = self.get_status()
        row = jobs.filter(F.col("id") == job_id).select("status").first()
        if row is None or row["status"] not in ("queued", "cancelled"):
            raise EngineError("queue", f"can't remove job {job_id}: {row['status'] if row else 'no such job'}")
        self._put(jobs.filter(F.col("id") != job_id))
        self.passwords.pop(job_id, None)

    def clear_queue(self) -> None:
        self._put(self.spark.createDataFrame([], JOBS))
        self.passwords.clear()

    def pause_queue(self) -> None:
        """Running jobs become cancelled when the stage they are in ends; queued ones stay."""
        self.cancelled = True

    def start_queue(self, process: Process, at_once: int | None = None) -> int:
        """Runs queued jobs, ``at_once`` in a step (all, if None), until none is queued or :meth:`pause_queue`.

        Returns how many ran. Each step marks its jobs as running, processes them in one Spark job, and
        writes their outcomes; finished ones enter the history, cancelled ones don't.
        """
        self.cancelled, ran = False, 0
        while not self.cancelled:
            jobs = self.get_status()
            head = jobs.filter("status = 'queued'").select("id", "seq")
            head = head if at_once is None else head.orderBy("seq").limit(at_once)
            started, chosen = int(time.time() * 1000), F.col("__h").isNotNull()
            self._put(jobs.join(head.select("id", F.lit(True).alias("__h")), "id", "left").withColumn("status", F.when(chosen, "running").otherwise(F.col("status"))).withColumn("started_at", F.when(chosen, started).otherwise(F.col("started_at"))))
            running = self.get_status().filter((F.col("status") == "running") & (F.col("started_at") == started))
            n = running.count()
            if not n:
                return ran
            self._tell("pipelineProgress", running.select("id", F.to_json(F.struct(F.lit("processing").alias("status"), F.lit(0).alias("percent"))).alias("payload")))
            secret = self.spark.createDataFrame(list(self.passwords.items()), "id string, password string")
            given = running.select("id", "input_path", "output_path", "options").join(F.broadcast(secret), "id", "left")  # as many as were given to enqueue
            outcome = process(given).groupBy("id").agg(F.max("error").alias("__e"), F.lit(True).alias("__done"))
            outcome = outcome.withColumnRenamed("id", "__id")
            at = f"{self.folder}/outcomes/{uuid.uuid4().hex}"
            outcome.write.parquet(at)
            self._settle(self.spark.read.schema(outcome.schema).parquet(at), started)
            ran += n
        return ran

    def _settle(self, outcome: DataFrame, started: int) -> None:
        jobs, now = self.get_status(), int(time.time() * 1000)
        mine = (F.col("status") == "running") & (F.col("started_at") == started)
        error = F.when(F.col("__done").isNull(), "the job gave no outcome").otherwise(F.col("__e"))
        status = F.when(F.lit(self.cancelled), "cancelled").when(error.isNull(), "completed").otherwise("failed")
        done = jobs.join(outcome, F.col("id") == F.col("__id"), "left").withColumn("__mine", mine)
        done = done.withColumn("error_message", F.when(~F.col("__mine"), F.col("error_message")).when(F.lit(self.cancelled), None).otherwise(error))
        done = done.withColumn("finished_at", F.when(F.col("__mine"), now).otherwise(F.col("finished_at")))
        done = done.withColumn("status", F.when(F.col("__mine"), status).otherwise(F.col("status")))
        done = done.withColumn("percent", F.when(F.col("__mine") & (F.col("status") == "completed"), 100).otherwise(F.col("percent")))
        self._put(done)
        ended = self.get_status().filter((F.col("started_at") == started) & F.col("finished_at").isNotNull())
        for channel in ("jobProgress", "jobFinished"):
            self._tell(channel, ended.select("id", F.to_json(F.struct("status", "percent", "error_message")).alias("payload")))
        for job in [j for j in self.passwords if j in {r["id"] for r in ended.filter(F.col("id").isin(list(self.passwords))).select("id").collect()}]:
            del self.passwords[job]
        if not self.cancelled:
            new = self.get_status().filter((F.col("started_at") == started) & F.col("status").isin("completed", "failed")).orderBy(F.desc("seq")).limit(queue.HISTORY_LIMIT).collect()
            entries = [{k: r[k] for k in ("id", "input_path", "output_path", "status", "started_at", "finished_at", "options")} | {"duration_ms": max(r["finished_at"] - r["started_at"], 0)} for r in new]
            files.save_history(self.spark, self.history_path, [*entries, *files.load_history(self.spark, self.history_path)][: queue.HISTORY_LIMIT])
            self._tell("historyUpdated", self.spark.createDataFrame([(e["id"], None) for e in entries], "id string, payload string"))

    def get_history(self) -> list[dict]:
        """The newest 100 finished jobs, newest first."""
        return files.load_history(self.spark, self.history_path)

    def clear_history(self) -> None:
        files.save_history(self.spark, self.history_path, [])

    def ensure_language_packs(self, languages: list[str], folder: str, fetch: Fetch | None = None) -> dict[str, Any]:
        """downloaded, skipped (already there) and errors (language: reason) of language data in a folder.

        There is no network here: ``fetch`` brings the data, the fast kind before the standard one. What has
        fewer than 100 bytes is no language data.
        """
        out: dict[str, Any] = {"downloaded": [], "skipped": [], "errors": {}}
        if not languages:
            return out
        files.make_folder(self.spark, folder)
        for code in dict.fromkeys(languages):
            path = f"{folder.rstrip('/')}/{code}.traineddata"
            if not re.fullmatch(r"[A-Za-z0-9_]+", code):
                out["errors"][code] = "not a language code"
            elif files.exists(self.spark, path):
                out["skipped"].append(code)
            else:
                try:
                    data = next((d for kind in ("fast", "standard") if fetch and (d := fetch(code, kind)) and len(d) >= LEAST_PACK), None)
                except OSError as e:
                    data, out["errors"][code] = None, str(e)
                if data:
                    files.write_bytes(self.spark, path, data)
                    out["downloaded"].append(code)
                else:
                    out["errors"].setdefault(code, "no source has this language")
        return out

    def write_log_file(self, path: str, lines: list[str]) -> None:
        files.save_log(self.spark, path, lines)


def clean_documents(jobs: DataFrame, recogniser: recognition.Factory | None = None, render: documents.Renderer | None = None) -> DataFrame:
    """A :data:`Process`: page images cleaned where ``options.compression`` is ccitt, others as they were.

    ``options`` are those of :class:`raster.Settings`, ``existing_text`` (skip leaves pages with text alone),
    ``languages``, ``psm`` and ``continue_on_error``; bitonal pages become Group 4, grey ones Flate. With a recogniser each
    cleaned page gets an invisible layer of its words. A page that can't be cleaned fails its job.
    With ``options.archive`` the file carries PDF/A metadata. All files go to folders that executors mount.
    """
    spark = jobs.sparkSession
    read = jobs.select("id", "output_path", "options", "password", F.col("input_path").alias("given"))
    # The reader wants its file names from the driver: as many as one enqueue call and one step of the queue hold.
    where = [r["given"] for r in read.select("given").distinct().toLocalIterator()]
    names = spark.createDataFrame([(p, files.qualified(spark, p)) for p in where], "given string, path string")
    content = spark.read.format("binaryFile").load(where).filter(F.col("length") <= pdf.MAX_FILE).select("path", "content").join(F.broadcast(names), "path").drop("path")
    loaded = read.join(content, "given", "left").withColumn("path", F.col("id"))
    made = []
    for flag, want in ((True, "options['archive'] = 'True'"), (False, "coalesce(options['archive'], '') <> 'True'")):
        mine = loaded.filter(want)
        images, layers = documents.cleaned_images(mine.filter("options['compression'] = 'ccitt'"), render, recogniser=recogniser), None
        if recogniser is not None:  # images and words of one pass over the pages
            at = scratch_path(spark, "cleaned")
            images.write.parquet(at)
            images = spark.read.schema(images.schema).parquet(at)
            layers = recognition.layers(documents.recognised_words(images))
        made.append(documents.edited_documents(mine.select("path", "content", "password"), images.drop("words", "page_w", "page_h"), layers, archive=flag, strict=True))
    edited = made[0].union(made[1])
    out = edited.join(read.select(F.col("id").alias("path"), "output_path"), "path")
    failed = out.filter("content IS NULL").select(F.col("path").alias("id"), "error")
    saved = documents.save_documents(out.filter("content IS NOT NULL")).join(read.select("id", "output_path"), "output_path").select("id", "error")
    return failed.union(saved)


def with_recogniser(recogniser: recognition.Factory, render: documents.Renderer | None = None) -> Process:
    """:func:`clean_documents` with text layers."""
    return lambda jobs: clean_documents(jobs, recogniser, render)
