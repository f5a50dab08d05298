from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import urls, voronoi


def brute(rows, k, step):
    clean = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            clean[i] = np.array([math.floor(1024 * float(np.float32(x))) for x in v], dtype=np.int64)
    out = []
    for q in sorted(i for i in clean if i % step == 0):
        best = sorted((-int(clean[q] @ v), i) for i, v in clean.items() if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("clusters", [0, 5])
def test_top_k_equals_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 8)
    monkeypatch.setattr(voronoi, "CHUNK", 100)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 6)) * 9 if clusters else np.zeros((1, 6))
    rows = [(i, (centres[i % len(centres)] + rng.normal(size=6)).round(1).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(None, rows[1][1]), (900, None), (901, [1.0] * 5 + [None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("cell", F.lit("x"))
    got = sorted(tuple(r) for r in voronoi.top_k(df, F.col("vec_id") % 5 == 0, 10).collect())
    assert got == brute(rows, 10, 5)


def test_a_hot_vector_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 16)
    monkeypatch.setattr(voronoi, "CHUNK", 50)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(400)]
    got = sorted(tuple(r) for r in voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 4 == 0, 10).collect())
    assert got == brute(rows, 10, 4)


def test_repeated_ids_and_other_lengths_take_part(spark):
    rows = [(0, [1.0, 1.0]), (1, [5.0, 0.0]), (1, [1.0, 0.0]), (2, [9.0])]
    got = sorted(tuple(r) for r in voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 10).collect())
    m = 1024 * 1024
    assert got == [(0, 1, 2, 9 * m), (0, 2, 1, 5 * m), (0, 3, 1, m)]


def pruned(ready):
    """(query cell, data cell) pairs that the bounds ruled out, and all of them."""
    return sum(len(ready.cells) - 1 - len(js) for js in ready.needed.values()), sum(len(ready.cells) - 1 for _ in ready.needed)


def test_bounds_rule_out_far_groups(spark, sf_small):
    """Real rows pulled into clusters are ruled out, mostly; as they are, over all directions alike, none can be."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    asked = F.col("vec_id") % 100 == 0
    out, every = pruned(voronoi.prepare(table, asked))
    assert every > 0 and out == 0
    near = table.withColumn("embedding", F.transform("embedding", lambda x, i: x + F.when(i == F.pmod(F.col("vec_id"), F.lit(8)), 9.0).otherwise(0.0)))
    out, every = pruned(voronoi.prepare(near, asked))
    assert out > 0.7 * every


def test_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in voronoi.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 11 * 1024 * 1024)]
    assert voronoi.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


ODD = [None, "", "no scheme", "http://", "HTTP://Www.NET/x", "http://net", "http://a.net?x=/", "http://xnet/", "https://example.net/en/1", "http://A.Example.NET/de/", "http://b.example.com/de/x#y", "http://w.org/fr/a?b://c", "ftp://É.org/fr/", "a://b://net/", "http://u.net/" + "p" * 50_000]


def test_urls_equal_the_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(ODD)] + [(None, "http://x.net/"), (10_001, "")], "page_id long, url string")
    both = pages.union(odd).withColumn("host", F.lit("clash"))
    rows = urls.judge(both).collect()
    assert len(rows) == both.count()
    source = {}
    for p in both.collect():
        source.setdefault(p.page_id, p.url)
    learned = []
    for r in rows:
        host, path = parts(source[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        if verdict and r.score is not None and r.page_id is not None and r.page_id < 10_000:
            learned.append((r.score > 0) == (verdict == "block"))
    assert sum(learned) / len(learned) > 0.9
    assert urls.judge(both.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(both.filter("url LIKE '%zzz%' OR url IS NULL")).collect()} == {"allow"}


def test_probabilities_add_up(spark):
    rng = random.Random(1)
    labelled = spark.createDataFrame([("http://" + "".join(rng.choice("abc./") for _ in range(12)), rng.choice(["allow", "block"])) for _ in range(50)], "url string, verdict string")
    m = urls.model(labelled)
    assert m.count() == urls.BASE**3 and m.filter("ratio IS NULL OR isnan(ratio)").count() == 0
