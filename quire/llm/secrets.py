"""Secret scans over a content-addressed ledger of blobs.

Every historical version of every path is addressed by the SHA-256 of its text. The ledger holds one
row for each (blob, rule version) pair ever scanned; only pairs that aren't in it are scanned, each
once, and its findings are joined back to all paths whose versions have that content.

The texts themselves hardly move: addresses (40 bytes a version) are grouped to find one owner of each
unseen blob, and a fixed-size filter lets owners be scanned where they are read. A :class:`Ledger` is a
table that is only appended to; what a failed run leaves out of it is scanned again by the next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import drop_ids, marked, rows_of, scratch_dir, slices, stash
from quire.sources import files

RULE_VERSION = "3"
#: The setting that names the ledger's folder.
LEDGER_SETTING = "quire.secrets.ledger"

#: The base kinds in their order, then the kinds that this method adds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is found as by [0-9a-f]+, shorter ones drop
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ADDED = {
    "private_key": ("-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    "forge_token": ("gh", re.compile(r"\bgh[oprsu]_[A-Za-z0-9]{30,}")),
    "chat_token": ("xox", re.compile(r"\bxox[abeprs]-[A-Za-z0-9-]{10,}")),
    "url_login": ("://", re.compile(r"\b[a-z][a-z0-9+.-]{0,30}://[^\s/@:]{1,64}:[^\s/@:]{3,128}@")),
}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *ADDED)

FOUND = pa.schema([("blob", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
FOUND_SCHEMA = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
NOTHING = hashlib.sha256(b"").hexdigest()


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret of a whole text, in order; kind is a place in KINDS."""
    out: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for kind, (hint, pattern) in enumerate(ADDED.values(), len(BASE)):
        if hint in text:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return sorted(out)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def _scan(texts: DataFrame) -> DataFrame:
    """(blob, text) → a ledger row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(1).to_pylist():
                found = spans(text)
                base = [f for f in found if f[1] < len(BASE)]
                row = *(sum(f[1] == k for f in base) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(found)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(FOUND)[1:], strict=True))], schema=FOUND)

    return texts.mapInArrow(run, FOUND_SCHEMA)


class Ledger:
    """The kept table of scanned (blob, rule version) pairs and their findings, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """All pairs so far, for any rule version; None for a new ledger. Runs at the same time may have added a pair twice."""
        if not files.exists(self.spark, self.path):
            return None
        return self.spark.read.schema(f"{FOUND_SCHEMA}, rule_version string").parquet(self.path)

    def append(self, fresh: DataFrame) -> None:
        fresh.write.mode("append").partitionBy("rule_version").parquet(self.path)


def ledger_of(spark: SparkSession, table: str) -> Ledger:
    """The ledger that ``quire.secrets.ledger`` names, else one for this table in the cluster's shared folder."""
    named = spark.conf.get(LEDGER_SETTING, None)
    return Ledger(spark, named or f"{scratch_dir(spark).rstrip('/')}/quire/secret-ledger-{hashlib.sha256(table.encode()).hexdigest()[:24]}")


def scan_with(ledger: Ledger, versions: DataFrame, path: str, text: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """The findings of :func:`scan_history` against a kept ledger, to which the new pairs are added."""
    findings, fresh = scan_history(versions, path, text, ledger.rows(), rule_version)
    ledger.append(fresh)
    return findings


def scan_history(versions: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) of versions (path, text).

    findings has a row for each version: path, blob, n_assign, n_access, n_hex, base_sha256, spans. The
    new rows hold only what wasn't in ``ledger`` for this rule version; append them to it. A null text
    is the empty one; null paths are reported like others; rows that repeat path and text are each
    reported, and scanned where they lie. Very long texts are scanned whole, in time linear in them.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    texts = rows_of(versions, path=path, text=F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("blob", F.sha2("text", 256))
    address = stash(texts.select("path", "blob"), "addresses")
    shared = stash(address.groupBy("blob").agg(F.min("path").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared-blobs")
    skip = address.join(shared, "blob").filter("path <> owner").select("path", "blob")
    known = None
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).drop("rule_version")
        skip = skip.union(address.join(known.select("blob"), "blob", "left_semi").select("path", "blob"))
    fresh = stash(_scan(drop_ids(texts, stash(skip.distinct(), "skipped"), ["path", "blob"]).select("blob", "text")).dropDuplicates(["blob"]), "scanned")
    rows = fresh if known is None else fresh.unionByName(known.select(*fresh.columns))
    found = stash(rows.filter("spans <> ''").dropDuplicates(["blob"]), "found")
    # Most versions hold nothing: only those that a fixed-size filter can't rule out are shuffled to meet their blob's findings.
    near, hit = marked(address, found.select("blob"), ["blob"])
    hits = near.filter(hit).join(found, "blob", "left")
    none = near.filter(~hit)
    filled = [*(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE), F.coalesce("base_sha256", F.lit(NOTHING)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")]
    empty = [*(F.lit(0).cast("long").alias(f"n_{k}") for k in BASE), F.lit(NOTHING).alias("base_sha256"), F.lit("").alias("spans")]
    findings = hits.select("path", "blob", *filled).unionByName(none.select("path", "blob", *empty))
    return findings, fresh.withColumn("rule_version", F.lit(rule_version))
