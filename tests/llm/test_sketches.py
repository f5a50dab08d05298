from __future__ import annotations

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import sketches as sk


def by_hand(rows):
    """{position: (n_chars, edited text, next position)} in descending doc_id, null last, then descending hash of the text."""
    tie = lambda text: (h := xxhash.xxh64_intdigest((text or "").encode(), 42)) - (h >> 63 << 64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0), -tie(rows[i][1])))
    out = {}
    for at, i in enumerate(order):
        j = order[(at + 1) % len(order)]
        text, nxt = rows[i][1] or "", rows[j][1] or ""
        half = len(text) // 2
        out[i] = (len(text), text[: len(text) - half] + nxt[:half], j)
    return out


def check(rows, got):
    want = by_hand(rows)
    assert len(got) == len(rows)
    expected = sorted((-1 if rows[i][0] is None else rows[i][0], n, hashlib.sha256(e.encode()).hexdigest()) for i, (n, e, _) in want.items())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    same = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        text = next(t for d, t in rows if d == r.doc_id)
        assert same.setdefault(text or "", r.fingerprint) == r.fingerprint or [d for d, _ in rows].count(r.doc_id) > 1
    return {r.doc_id: r for r in got}


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(sk, "RANGE_ROWS", 37)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = check(rows, sk.fingerprint_report(docs).collect())
    want = by_hand(rows)

    def jaccard(a, b):
        x, y = ({tuple(w[i : i + 2]) for i in range(len(w) - 1)} or {tuple(w)} for w in (a.lower().split(), b.lower().split()))
        return len(x & y) / len(x | y)

    big = [(jaccard(rows[i][1], e), got[rows[i][0]].near_edited) for i, (n, e, _) in want.items() if n > 2000]
    assert sum(abs(a - b) for a, b in big) / len(big) < 0.08


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    check(rows, sk.fingerprint_report(odd_documents).collect())
    assert sk.fingerprint_report(no_documents).count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    (r,) = sk.fingerprint_report(one).collect()
    assert r.near_next == 1 and r.n_chars == 7 and r.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


def test_many_ranges_and_cuts(spark, monkeypatch):
    monkeypatch.setattr(sk, "RANGE_ROWS", 10)
    monkeypatch.setattr(sk, "CELLS", 4)
    rows = [(i * i - 500, f"text {i} of many words {i % 7}") for i in range(200)]
    check(rows, sk.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())


@pytest.mark.parametrize(("cells", "rows_a_range"), [(8, 20), (4, 7)])
def test_a_hot_document_is_several_ranges(spark, monkeypatch, cells, rows_a_range):
    monkeypatch.setattr(sk, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(sk, "CELLS", cells)
    rows = [(50, f"text {i} of the hot one {i % 5}") for i in range(90)] + [(50, "the same words")] * 20 + [(i, f"text {i} of many words") for i in range(40, 90) if i != 50]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sk.fingerprint_report(docs).collect())
    base = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie"), "text")
    sizes = [r["count"] for r in base.withColumn("r", sk._ranges(base.select("key", "tie"))).filter("key = 50").groupBy("r").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 60


def test_merge_and_containment(spark):
    small, large = "a b c d e f g h i j k l m n o p", "z y x w v u t s r q " * 3 + "a b c d e f g h i j k l m n o p"
    df = sk.with_fingerprint(sk.with_fingerprint(spark.createDataFrame([(small, large)], "s string, l string"), "s", "fs"), "l", "fl")
    r = df.select(sk.containment(F.col("fs"), F.col("fl")).alias("c"), (sk.merged(F.col("fs"), F.col("fl")) == F.col("fl")).alias("m")).first()
    assert r.c == 1.0 and r.m
