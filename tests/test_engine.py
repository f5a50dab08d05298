from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import engine
from quire.operators import pdf
from quire.sources import files

GREY = np.where(np.arange(60).reshape(6, 10) % 7 < 3, 0, 255).astype(np.uint8)


@pytest.fixture
def place(tmp_path):
    for name, content in {"in/a.pdf": pdf.save(pdf.new_document([(20, 10, pdf.image_stream(GREY), b"")])), "in/sub/a.PDF": pdf.save(pdf.new_document([])), "in/b.pdf": b"junk", "out/a_cleaned.pdf": b"", "in/c.txt": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_queue_commands(spark, place):
    e = engine.Engine(spark, f"{place}/engine")
    assert e.get_status().count() == 0 and e.get_history() == []
    for paths, out, kind in (([f"{place}/in/none.pdf"], "out", "no such file"), ([f"{place}/in/c.txt"], "out", "not a PDF"), ([f"{place}/in"], "out", "not a file"), ([f"{place}/in/a.pdf"], "nowhere", "no such folder")):
        with pytest.raises(engine.EngineError, match=kind):
            e.enqueue(paths, f"{place}/{out}")
    new = e.enqueue([f"{place}/in/a.pdf", f"{place}/in/sub/a.PDF", f"{place}/in/b.pdf"], f"{place}/out", {"compression": "ccitt", "password": "hidden"}).collect()
    assert [r.output_path.rsplit("/", 1)[1] for r in new] == ["a_cleaned_1.pdf", "a_cleaned_2.pdf", "b_cleaned.pdf"]
    assert all(r.status == "queued" and r.options == {"compression": "ccitt"} for r in new) and set(e.passwords.values()) == {"hidden"}
    again = engine.Engine(spark, f"{place}/engine")  # another session finds the same jobs
    assert again.start_queue(engine.clean_documents, at_once=2) == 3
    done = {r.output_path.rsplit("/", 1)[1]: r for r in again.get_status().collect()}
    assert [done[k].status for k in sorted(done)] == ["completed", "completed", "failed"]
    assert done["b_cleaned.pdf"].error_message == "not a PDF file" and done["a_cleaned_1.pdf"].percent == 100
    doc = pdf.load((place / "out/a_cleaned_1.pdf").read_bytes())
    stream = pdf.images(doc, doc.pages()[0][2])[0][2]
    assert stream.entries["Filter"] == "CCITTFaxDecode"
    assert len(again.get_history()) == 3 and "hidden" not in (place / "engine/history.json").read_text()
    with pytest.raises(engine.EngineError, match="completed"):
        again.remove_job(done["a_cleaned_1.pdf"].id)
    job = again.enqueue([f"{place}/in/b.pdf"], f"{place}/out").first().id
    again.remove_job(job)
    with pytest.raises(engine.EngineError, match="no such job"):
        again.remove_job(job)
    again.clear_queue()
    again.clear_history()
    assert again.get_status().count() == 0 and again.get_history() == []


def test_pause(spark, place):
    e = engine.Engine(spark, f"{place}/engine")
    e.enqueue([f"{place}/in/a.pdf", f"{place}/in/b.pdf"], f"{place}/out")

    def process(jobs):
        e.pause_queue()
        return jobs.select("id", F.lit(None).cast("string").alias("error"))

    assert e.start_queue(process, at_once=1) == 1
    assert [r.status for r in e.get_status().collect()] == ["cancelled", "queued"]
    assert e.get_history() == []


def test_files(spark, place):
    e = engine.Engine(spark, f"{place}/engine")
    got = e.get_file_metadata(f"{place}/in/b.pdf").first()
    assert (got["name"], got["size"]) == ("b.pdf", 4)
    assert not e.check_file_encrypted(f"{place}/in/a.pdf")
    with pytest.raises(engine.EngineError, match="not a PDF"):
        e.check_file_encrypted(f"{place}/in/b.pdf")
    e.write_log_file(f"{place}/x.log", ["[10:00:00] [INFO ] é"])
    assert (place / "x.log").read_text() == "[10:00:00] [INFO ] é"
    for bad in ("x.log", f"{place}/x.txt", f"{place}/none/x.log"):
        with pytest.raises(ValueError):
            e.write_log_file(bad, [])
    history = place / "history.json"
    assert files.load_history(spark, str(history)) == []
    for broken in ("{", '{"id": 1}', "[1]"):
        history.write_text(broken)
        assert files.load_history(spark, str(history)) == [] and not history.exists()
        assert (place / "history.json.corrupted").read_text() == broken
    files.save_history(spark, str(history), [{"id": "é"}])
    assert json.loads(history.read_text()) == files.load_history(spark, str(history)) == [{"id": "é"}]


def test_default_concurrency():
    assert [engine.default_concurrency(c) for c in (1, 2, 5, 8, 64)] == [1, 1, 2, 4, 4]
