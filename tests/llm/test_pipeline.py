"""Every stage of the corpus pipeline against brute force, on documents and on odd rows."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import pii, tokens, toxicity
from quire.llm.common import stash
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check_packed
from tests.llm.test_toxicity import plain_scores


def stages(spark, sf_dir, monkeypatch):
    """(name, rows in, rows out) of each stage, as run() chains them, and the model of the first."""
    models = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: models.append(train(*a)) or models[-1])
    spark.conf.set(pii.KEY_SETTING, "k")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    try:
        for name, stage in corpus_pipeline.STAGES:
            made = stash(stage(spark, docs, sf_dir), f"test-{name}")
            out.append((name, docs, made))
            docs = made
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    return out, models[0]


def whole(row):
    return tuple(row[c] for c in sorted(row.asDict()))


def check(spark, sf_dir, monkeypatch):
    done, model = stages(spark, sf_dir, monkeypatch)
    assert [n for n, *_ in done] == ["toxicity", "near_dedup", "pii", "packing"]
    rows = {n: (i.collect(), o.collect()) for n, i, o in done}
    for name, before, after in done[:3]:
        assert after.columns == before.columns, name

    before, after = rows["toxicity"]
    scores = plain_scores(model, [r.text or "" for r in before])
    assert sorted(map(repr, map(whole, after))) == sorted(repr(whole(r)) for r, s in zip(before, scores, strict=True) if s < 0.3)

    before, after = rows["near_dedup"]
    ids = [r for r in before if r.doc_id is not None]
    groups = brute([(r.doc_id, r.text) for r in {r.doc_id: r for r in ids}.values()], 5, 80)
    want = [r for r in before if r.doc_id is None or groups[r.doc_id] == r.doc_id]
    assert sorted(map(repr, map(whole, after))) == sorted(map(repr, map(whole, want)))

    before, after = rows["pii"]
    apply = pii.Pseudonymiser(b"k").apply
    changed = [(r.doc_id, None if r.text is None else apply(r.text)[0]) for r in before]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in after))) == sorted(map(repr, changed))
    assert all(r.text is None or r.n_chars == len(r.text) for r in after)

    before, after = rows["packing"]
    check_packed(after, [(r.doc_id, r.text) for r in before], Tokenizer.from_file(tokens.default_tokenizer_path()))
    return done


def test_stages_on_documents(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.01"
    done = check(spark, sf_dir, monkeypatch)
    counts = [o.count() for _, _, o in done]
    assert 0 < counts[1] < counts[0] < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("labels", ["some", "none", "repeated"])
def test_stages_on_odd_rows(spark, odd_documents, monkeypatch, tmp_path, labels):
    extra = odd_documents.withColumns({"score": F.lit("x"), "__toxicity": F.lit(1.5), "length": F.lit("y"), "node": F.lit(1)})
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    of = {"some": [(1, 1, 0), (2, 1, 0), (None, 1, 1), (6, None, None)], "none": [], "repeated": [(1, 1, 0), (1, 1, 1), (4, 1, 0), (4, 1, 0)]}[labels]
    spark.createDataFrame(of, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    done = check(spark, str(tmp_path), monkeypatch)
    assert {r.doc_id for r in done[-1][2].collect()} >= {None, 2, 3, 5, 8}


def test_empty_tables(spark, no_documents, tmp_path):
    no_documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
