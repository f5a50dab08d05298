from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_tokenizer_path())


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_of_documents_equal_the_tokenizer(spark, sf_small, tokenizer):
    enc = tokens.encoder(tokens.default_tokenizer_path())
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect():
        assert enc.encode(r.text) == np.array(tokenizer.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("İıſKΣς́​ \x1c\x85<|endoftext|> '")), max_size=40))
def test_ids_of_any_text_equal_the_tokenizer(text):
    enc = tokens.encoder(tokens.default_tokenizer_path())
    assert enc.encode(text) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packed(rows, docs, tokenizer):
    """Pieces cover every document; sequences are gapless and within the limit."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        want = ids(tokenizer, text)
        got = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc]})
        assert got == [(k, k * 2048, len(part := want[k * 2048 : (k + 1) * 2048]), zlib.crc32(np.array(part, "<u4").tobytes())) for k in range(math.ceil(len(want) / 2048))]
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(sequences)


def test_packing_of_documents(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    n = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert n <= math.ceil(1.015 * sum(r.length for r in rows) / 2048) + 1


def test_the_bound_on_open_bins_acts_and_costs_little():
    rng = random.Random(1)
    lengths = [min(2048, int(rng.lognormvariate(6.4, 0.9)) + 1) for _ in range(packing.GROUP)]
    low = math.ceil(sum(lengths) / 2048)
    few, many = packing.BestFit(2048, 16), packing.BestFit(2048, packing.OPEN_BINS)
    for fit in (few, many):
        for n in lengths:
            fit.place(n)
            assert fit.open <= fit.limit
    assert packing.OPEN_BINS < low / 20 and many.made <= few.made <= 1.05 * low and many.made <= 1.02 * low


def test_a_hot_document_is_dealt_to_all_groups(spark, tokenizer):
    docs = [(1, "one and the same text")] * 300 + [(i, f"text {i}") for i in range(2, 300)]
    pieces = packing.token_pieces(spark.createDataFrame(docs, "doc_id long, text string"), with_ids=False).drop("ids")
    path = "pieces"
    rows = packing.pack(packing.stash(pieces, path), group=100).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence_id >> 40, []).append(r)
    assert len(rows) == len(docs) and len(groups) == 6 and max(map(len, groups.values())) < 200


def test_odd_rows(spark, odd_documents, no_documents, tokenizer):
    rows = packing.pack_documents(odd_documents).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in odd_documents.collect()], tokenizer)
    assert sum(r.doc_id == 7 for r in rows) == 2
    assert packing.pack_documents(no_documents).count() == 0


def naive(lengths, capacity, limit):
    bins, placed = [], []
    for n in lengths:
        fits = [b for b in bins if b[1] and capacity - b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: capacity - b[0])
        else:
            b = [0, True]
            bins.append(b)
        placed.append(b[0])
        b[0] += n
        if b[0] == capacity:
            b[1] = False
        while sum(b[1] for b in bins) > limit:
            max((b for b in bins if b[1]), key=lambda b: b[0])[1] = False
    return len(bins), placed


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_best_fit_equals_a_naive_one(limit):
    rng = random.Random(limit)
    lengths = [rng.randint(1, 40) for _ in range(400)]
    fit = packing.BestFit(40, limit)
    places = [fit.place(n) for n in lengths]
    bins, offsets = naive(lengths, 40, limit)
    assert fit.made == bins and [p[1] for p in places] == offsets
