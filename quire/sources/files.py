"""Small files of the driver (history, logs) in whatever store Spark reads, replaced in one step."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    fs, p = _store(spark, path)
    return fs.exists(p) and (not folder or fs.getFileStatus(p).isDirectory())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's file readers give it, with its scheme and store."""
    fs, p = _store(spark, path)
    return fs.makeQualified(p).toString()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _store(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; false where there was none."""
    fs, p = _store(spark, path)
    return fs.delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Written beside ``path``, then renamed to it: readers see the old file or the new one."""
    part = f"{path}.part"
    fs, p = _store(spark, part)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    move(spark, part, path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, those of empty files too, which Spark's readers leave out."""
    fs, p = _store(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)]


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    fs, p = _store(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
    finally:
        stream.close()


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _store(spark, path)
    target = _store(spark, to)[1]
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(p, target):
        raise OSError(f"can't rename {path} to {to}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside ``path``, then renamed to it: readers see the old file or the new one."""
    write_bytes(spark, path, text.encode())


def load_history(spark: SparkSession, path: str) -> list[dict]:
    """The entries of a history file. A missing one is empty; a broken one is put aside as ``.corrupted``."""
    text = read_text(spark, path)
    if text is None:
        return []
    try:
        entries = json.loads(text)
        if not isinstance(entries, list) or not all(isinstance(e, dict) and "id" in e for e in entries):
            raise ValueError("no list of entries")
    except ValueError:
        move(spark, path, f"{path}.corrupted")
        return []
    return entries


def save_history(spark: SparkSession, path: str, entries: list[dict]) -> None:
    write_text(spark, path, json.dumps(entries, indent=2, ensure_ascii=False))


def save_log(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Exports log lines to an absolute ``.log`` path whose folder exists."""
    folder, _, name = path.rpartition("/")
    if not re.match(r"(?:[a-z]+:)?/", path) or not name.lower().endswith(".log"):
        raise ValueError(f"not an absolute .log path: {path}")
    if not exists(spark, folder or "/", folder=True):
        raise ValueError(f"no such folder: {folder}")
    write_text(spark, path, "\n".join(lines))
