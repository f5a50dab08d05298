from __future__ import annotations

import random

import pytest

from quire.llm import components as cc
from quire.llm import near_dedup as nd


def words_of(text: str) -> list[str]:
    return (text or "").encode().lower().split()


def brute(rows: list[tuple[int, str]], k: int, percent: int) -> dict[int, int]:
    sets = {}
    for doc, text in rows:
        w = words_of(text)
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    index: dict = {}
    for d in ids:
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    pairs = {(a, b) for ds in index.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_groups_equal_brute_force(spark, sf_small, k):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(k)
    base = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3).split()
    for i in range(30):  # a chain of small edits
        at = rng.randrange(len(base))
        base[at] = f"w{i}"
        rows.append((10_000 + i, " ".join(base)))
    got = {r.doc_id: r.component_id for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, 80).collect()}
    assert got == brute(rows, k, 80)


def test_exact_threshold(spark):
    # 100 * intersection == 80 * union links, one less doesn't
    a = [f"a{i}" for i in range(11)]  # 10 two-word shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:9]))]  # 8 of 10 shared
    got = {r.doc_id: r.component_id for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {1: 1, 2: 1}
    rows = [(1, " ".join(a)), (2, " ".join(a[:8]))]
    got = {r.doc_id: r.component_id for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {1: 1, 2: 2}


def test_odd_rows(spark, odd_documents, no_documents):
    got = {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in nd.near_groups(odd_documents, 2).collect()}
    assert (1, 1, 6, True) in got and (4, 1, 6, False) in got
    assert (2, 2, 0, True) in got and (3, 3, 0, True) in got and (5, 5, 0, True) in got
    assert (None, None, 5, True) in got
    assert nd.near_groups(odd_documents, 2).count() == odd_documents.count()
    kept = nd.near_dedup(odd_documents, 5)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 7, 8]
    assert nd.near_groups(no_documents).count() == 0 and nd.near_dedup(no_documents).count() == 0


def test_repeated_id_ties_its_texts(spark):
    one, two = "a b c d e f g h i j", "p q r s t u v w x y"
    rows = [(5, one), (5, two), (7, two), (9, one), (11, "other words entirely")]
    got = {(r.doc_id, r.component_id) for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11)}


def differing(x, y) -> int:
    return sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y)


def test_sketch_limit_keeps_similar_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    worst = worst_long = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 20, dtype=np.uint64)]) for _ in range(2))
        x, y = (nd.odd_sketch(nd.minhashes(s)) for s in (a, b))
        worst = max(worst, differing(x, y))
        x, y = (nd.odd_sketch(nd.minhashes(s, nd.LONG_SAMPLES), nd.LONG_WORDS) for s in (a, b))
        worst_long = max(worst_long, differing(x, y))
    assert worst <= nd.SKETCH_LIMIT and worst_long <= nd.LONG_LIMIT


def test_components_of_chain_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200, 202: 200}
    assert got == want


def test_large_group_of_unequal_copies(spark):
    """Copies with more or fewer edits: some link only to a few others, some to none."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(250):
        w = list(base)
        for at in rng.sample(range(90), rng.randint(0, 12)):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute(rows, 2, 80)
    assert len(set(got.values())) > 5
