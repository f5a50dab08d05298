from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pieces as pc


@pytest.fixture(scope="module")
def model():
    return pc.pieces(pc.default_model_path())


def brute(model, text):
    """Best score by trying every piece at every place."""
    by_text = {p: model.score[i] for i, p in model.piece.items()}
    longest = max(map(len, by_text))
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = max([best[end - 1] + model.unknown, *(best[at] + by_text[text[at:end]] for at in range(max(0, end - longest), end) if text[at:end] in by_text)])
    return best[-1]


def test_viterbi_is_optimal(model):
    rng = random.Random(4)
    texts = ["▁the", "▁▁▁of", "aaaaaaa", "é单x", *("".join(rng.choice("▁theaourngi.") for _ in range(rng.randint(1, 25))) for _ in range(200))]
    for t in texts:
        ids, score = model.viterbi(t)
        assert score == pytest.approx(brute(model, t))
        assert "".join(model.piece.get(i, "") for i in ids) == "".join(c for c in t if any(model.piece.get(i) == c for i in model.piece)) or any(i in model.byte_of for i in ids) or "".join(model.piece[i] for i in ids) == t


def test_words_one_by_one_equal_the_whole_text(model, spark, sf_small):
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").limit(25).collect():
        whole = model.viterbi(pc.MARK + r.text.replace(" ", pc.MARK))
        mine = model.encode(r.text).tolist()
        assert mine == whole[0]


def test_equals_the_library_as_a_unigram_model(model, tmp_path):
    """The same pieces and scores in a unigram model give the same best score."""
    import sentencepiece

    raw = open(pc.default_model_path(), "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in ("the house", "of and the", "estion"):
        assert model.decode(model.encode(t).tolist()) == sp.decode(sp.encode(t)) == t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    m = pc.pieces(pc.default_model_path())
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert m.decode(m.encode(text).tolist()) == text


def test_rows(spark, odd_documents, no_documents):
    rows = pc.round_trip(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r.lossless and r.n_ids == len(r.ids) for r in rows)
    encoded = pc.encode(odd_documents)
    texts = {(r.doc_id, r.text) for r in pc.decode(encoded).collect()}
    assert texts == {(r.doc_id, r.text or "") for r in odd_documents.collect()}
    assert pc.round_trip(no_documents).count() == 0
