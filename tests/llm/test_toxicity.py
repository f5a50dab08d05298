from __future__ import annotations

import math
import random
import zlib

import pytest

from quire.llm import toxicity as tx


def edits_within_one(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
    return row[-1]


def brute(terms: list[str], word: str) -> set[int]:
    """Edits (0 or 1) with which any term matches."""
    out = set()
    for t in terms:
        bare = t.rstrip("$")
        ends = [len(word)] if t.endswith("$") else range(len(word) + 1)
        best = min(edits_within_one(bare, word[:n]) for n in ends)
        if best == 0 or best == 1 and len(bare) >= tx.FUZZY_FROM:
            out.add(best)
    return out


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["idiot$", "moron$", "loser$", "scum$", "lowei", "vequ", "trash$", "trasher"]
    lexicon = tx.FuzzyLexicon(terms)
    words = ["idiot", "idiott", "idot", "xdiot", "scun", "loweix", "loewi", "veque", "vequ", "", "trashe", "trasherx", "trashers"]
    for _ in range(4000):
        w = list(rng.choice(terms).rstrip("$") + rng.choice(["", "", "s", "abc"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e", "x"])
        words.append("".join(w))
    for w in words:
        hit = lexicon.match(w)
        want = brute(terms, w)
        assert bool(hit) == bool(want), w
        if hit:
            assert (hit - 1) % 2 == min(want), w


def test_context_and_lookalikes():
    assert tx.terms_of("1d10t!!") == ["idiot"] and tx.terms_of("idiot###") == ["idiot"] and tx.terms_of("...") == []
    plain = "you are an idiot here".split()
    quoted = 'he wrote “you are an idiot” there'.split()
    assert tx.context(plain, 3) == 1 and tx.context(quoted, 5) == tx.QUOTED
    assert tx.context("she said you idiot".split(), 3) == tx.REPORTED


@pytest.fixture
def corpus(spark):
    rng = random.Random(5)
    filler = [f"{a}{b}" for a in ("the", "an", "or", "in", "re", "st") for b in ("ing", "ed", "er", "ly", "tion")]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(filler) for _ in range(40)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["idiot", "moron", "worthless"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_scores(model, texts):
    """Scores from their definition: every word against every term, the words of a term counted, contexts by hand."""
    known = {}

    def hit(word):
        """(term, edits) of the first that holds: the word itself, its shortest exact stem, a near match."""
        if word not in known:
            best = []
            for i, t in enumerate(model.terms):
                bare = t.rstrip("$")
                if t.endswith("$") and word == bare:
                    best.append((0, 0, i, 0))
                elif not t.endswith("$") and word.startswith(bare):
                    best.append((1, len(bare), i, 0))
            if not best:
                near = tx.FuzzyLexicon(model.terms).match(word)
                assert bool(near) == bool(brute(model.terms, word))
                best = [(2, 0, (near - 1) // 2, 1)] if near else []
            known[word] = min(best)[2:] if best else None
        return known[word]

    out = []
    for text in texts:
        chunks, words, factors = text.split(), {}, {}
        for at, chunk in enumerate(chunks):
            found = [h for w in tx.terms_of(chunk) if (h := hit(w))]
            if found:
                first = min(found, key=lambda h: (h[1], h[0]))
                words.setdefault(first, set()).add(tuple(tx.terms_of(chunk)))
                factors[first] = max(factors.get(first, 0), tx.context(chunks, at))
        x = model.bias + model.slope * sum(f * model.weights[tx.LEVELS * (2 * t + e) + min(tx.LEVELS, len(words[t, e])) - 1] for (t, e), f in factors.items())
        out.append(1 / (1 + math.exp(-x)))
    return out


def test_scores_equal_their_definition(spark):
    """The whole query, on documents with their own labels and model."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in tx.judge(docs, labels).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r, score in zip(rows, plain_scores(tx.train(docs, labels), [r.text or "" for r in rows]), strict=True):
        assert abs(got[r.doc_id].score - score) < 1e-9
        assert got[r.doc_id].predicted == (score >= 0.3) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_a_stem_that_recurs_tells_more(spark):
    """A stem that innocent texts hold once, and toxic ones in several words, weighs by their number."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice(['ling', 'ren', 'tos'])}" for _ in range(30)]
        toxic = i % 9 == 0
        for _ in range(4 if toxic else i % 11 == 0):
            words[rng.randrange(30)] = "vrekk" + rng.choice(["a", "on", "ist", "um", "ef", "or"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tx.judge(docs, known).filter("held_out").collect()
    assert sum(r.predicted for r in got if r.doc_id % 9 == 0) >= 0.9 * sum(r.doc_id % 9 == 0 for r in got)
    assert sum(r.predicted for r in got if r.doc_id % 9) <= 0.02 * len(got)


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in tx.judge(docs, labels).collect()}
    assert {d for d, r in got.items() if r.held_out} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in got.values() if r.held_out]
    assert all(r.predicted == int(r.doc_id % 8 == 0) for r in held)


def test_misspelling_and_quotation(spark, corpus):
    model = tx.train(*corpus)
    plain, near, quote, clean = tx.scores(model, ["the ed idiot moron inly", "the ed idiiot morron inly", 'he wrote "the idiot moron" inly', "the ed inly"])
    assert plain > quote > clean and plain >= near > clean


def test_odd_rows(spark, corpus, odd_documents, no_documents):
    _, labels = corpus
    got = tx.judge(odd_documents, labels)
    assert got.count() == odd_documents.count() and got.filter("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert tx.judge(no_documents, labels).count() == 0
    assert tx.judge(odd_documents, labels.limit(0)).filter("predicted = 0").count() == odd_documents.count()
    assert tx.drop_toxic(odd_documents, labels).columns == odd_documents.columns
    nulls = spark.createDataFrame([(None, None), (1, None), (None, 1)], "doc_id long, toxic int")
    assert tx.judge(odd_documents, nulls).count() == odd_documents.count()


def test_fit_of_classes_that_do_not_overlap():
    import numpy as np

    bias, slope = tx._logistic(np.array([0.0] * 900 + [8.0, 20.0, 40.0] * 33 + [60.0]), np.array([0.0] * 900 + [1.0] * 100))
    p = [1 / (1 + np.exp(-(bias + slope * x))) for x in (0, 8, 20, 60)]
    assert p[0] < 0.1 and min(p[1:]) > 0.8 and 0 < slope < 5


def test_accuracy_on_test_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = tx.judge(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got)
    caught = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    kept = sum(not r.predicted for r in got if not r.toxic) / sum(not r.toxic for r in got)
    assert right / len(got) > 0.97 and caught >= 0.9 and kept > 0.99
