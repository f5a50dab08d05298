from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions import scalars as fn
from quire.operators import recognition
from quire.plans import text
from quire.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def width_by_hand(word):
    return None if word is None else sum(next((w for chars, w in fn.GLYPH_WIDTHS.items() if chr(b) in chars), fn.OTHER_WIDTH) for b in word.encode())


def test_width_is_one_look_up_a_byte(spark):
    words = ["", None, "Mmm,", "naïve", "日本", "\x00\x7f", *map(chr, range(1, 200)), "a" * 5000]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string").select("i", "w", fn.word_width(F.col("w")).alias("width"))
    assert "translate(" not in plan_of(df)
    got = {r.i: r.width for r in df.collect()}
    assert [got[i] for i in range(len(words))] == [width_by_hand(w) for w in words]


@pytest.mark.parametrize("name", ["txt02_word_width", "txt03_font_size", "txt04_coordinates", "snk09_text_layer"])
def test_no_word_is_shuffled_or_translated(spark, sf_small, name):
    plan = plan_of(QUERIES[name](spark, sf_small))
    assert "Exchange" not in plan and "translate(" not in plan


def test_quarters_print_like_numbers(spark):
    n = spark.range(-45, 400).withColumn("n", F.col("id"))
    assert n.filter(fn.quarters(F.col("n")) != fn.pdf_number(F.col("n") / 4.0)).count() == 0


def test_escapes(spark):
    got = spark.createDataFrame([(r"a(b)\c\(",), ("",), ("plain",)], "t string").select(fn.escaped(F.col("t")).alias("e"))
    assert [r.e for r in got.collect()] == [r"a\(b\)\\c\\\(", "", "plain"]


def test_layers_of_pages_that_run_over_batches(spark):
    pages = {7: ["a"], 3: [f"word{i} é" for i in range(10)], 9: ["x", "y", "z"], 4: ["t"] * 6}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        for parts in (1, 3):
            df = spark.createDataFrame([(p, pages[p]) for p in pages], "page_id long, ops array<string>").coalesce(parts).select("page_id", F.explode("ops").alias("op"))
            got = [tuple(r) for r in recognition.layer_digests(df).collect()]
            assert sorted(got) == sorted((p, hashlib.md5("".join(ops).encode()).hexdigest(), len(ops)) for p, ops in pages.items())
        assert recognition.layer_digests(df.filter("page_id < 0")).count() == 0
    finally:
        spark.conf.set(key, before)


def test_layer_of_odd_pages(spark, tmp_path):
    """No text, blank text and words of little confidence make no page."""
    docs = [(1, None), (2, ""), (3, " \n  \n"), (5, "one (two)\n\nthree  four\\"), (6, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = {(r.page_id, r.text) for r in text.kept_words(spark, str(tmp_path)).collect()}
    got = {r.page_id: r.words for r in QUERIES["snk09_text_layer"](spark, str(tmp_path)).collect()}
    assert sum(got.values()) == len(kept) and set(got) == {p for p, _ in kept}
