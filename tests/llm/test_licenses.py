from __future__ import annotations

import random

import numpy as np

from quire.llm import licenses as lc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_equals_common_subsequence_within_its_band():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abcdef") for _ in range(rng.randint(1, 10))]
        b = [rng.choice("abcdef") for _ in range(rng.randint(0, 12))]
        matched, first, last = lc.align(a, b, 0, band=14)
        assert matched == lcs(a, b)
        if matched:
            assert 0 <= first <= last < len(b) and last - first + 1 >= matched


def test_winnowing_keeps_one_in_every_window():
    hashes = np.array([5, 3, 9, 3, 7, 8, 1, 4], np.uint64)
    kept = lc.winnow(hashes, 3)
    assert all(any(i <= k < i + 3 for k in kept) for i in range(len(hashes) - 2))


def test_notices_and_texts():
    scan = lc.scanner().scan
    text = "Some words é here.\nReleased under the MIT License. More words."
    (name, _, coverage, matched, start, end), = scan(text)
    assert (name, coverage, matched, text[start:end]) == ("MIT", 1.0, 5, "Released under the MIT License")
    assert [f[0] for f in scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert [f[0] for f in scan("Licensed under the Apache License, Version 2.0.")] == ["Apache-2.0"]
    assert scan("the license of the house was under review") == [] and scan("") == []
    words = lc.TEMPLATES["BSD-3-Clause"][0].split()
    del words[10:14], words[40]
    words[20:20] = ["some", "added", "words"]
    (name, _, coverage, *_), = scan("x " * 50 + " ".join(words) + " y" * 50)
    assert name == "BSD-3-Clause" and 0.9 < coverage < 1


def test_rows(spark, odd_documents, no_documents, sf_small):
    assert lc.scan_licenses(odd_documents).count() == 0 and lc.scan_licenses(no_documents).count() == 0
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = {r.doc_id for r in lc.scan_licenses(docs).collect()}
    want = {r.doc_id for r in docs.collect() if any(n in r.text for n in ("Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3.", "Released under the MIT License."))}
    assert got == want


def test_interrupted_texts_are_joined():
    scan = lc.scanner().scan
    words = lc.TEMPLATES["MIT"][0].split()
    half = next(i for i, w in enumerate(words) if w == "The" and words[i + 1] == "above")
    for added in (0, 12, 13, 60, 400):
        split = words[:half] + [f"w{i}" for i in range(added)] + words[half:]
        text = "x " * 40 + " ".join(split) + " y" * 40
        (name, _, coverage, _, start, end), = scan(text)
        assert (name, coverage) == ("MIT", 1.0) and text[start:].startswith("Permission") and text[:end].endswith("NONINFRINGEMENT")
    twice = [*words[:half], *["v"] * 30, *words[half:], *["z"] * 50]
    assert [f[:3] for f in scan(" ".join(twice * 2))] == [("MIT", 0, 1.0)] * 2
    assert scan(" ".join(words[half:] + ["w"] * 30 + words[:half])) == []  # not in the template's order
    assert scan(" ".join(words[:half] + ["w"] * 30 + words[:half])) == []  # the same half twice


def test_notices_of_siblings():
    scan = lc.scanner().scan
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        assert [f[:3] for f in scan(f"Licensed under CC {kind} 4.0.")] == [(f"CC-{kind}-4.0", 0, 1.0)]
    assert scan("Licensed under CC BY-XY 4.0.") == [] and scan("Released under the old MIT License.") == []
    for name in ("GPL-3.0", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause"):
        assert [f[0] for f in scan(lc.TEMPLATES[name][0])] == [name]


def plain_scan(text):
    """Finds from their definition: short notices word by word, long templates by the common subsequence with each stretch of the text."""
    words = lc.WORD.findall(text.lower())
    found = []
    for name, n, template in lc.scanner().templates:
        size = len(template)
        if size <= lc.SHORT:
            found += [(size, 1.0, name, n, at, at + size - 1) for at in range(len(words) - size + 1) if words[at : at + size] == template]
        elif len(set(template) & set(words)) >= 0.6 * len(set(template)):
            reach = size + lc.BAND
            best = max((lcs(template, words[at : at + reach]), -at) for at in range(max(1, len(words) - reach + 1)))
            if best[0] >= lc.LEAST_COVERAGE * size:
                found.append((best[0], best[0] / size, name, n, None, None))
    return found


def test_the_query_equals_a_plain_scan(spark):
    """All documents of a table with notices and whole templates put in: short finds with spans, long ones with coverage."""
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i, (name, texts) in enumerate(lc.TEMPLATES.items()):
        words = texts[0].split()
        for _ in range(len(words) // 30):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100_000 + i, f"Some words before. {' '.join(words)} And after {name.lower()[:2]}zz."))
    got = {}
    for r in lc.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = 0
    for doc, text in rows:
        want, mine = plain_scan(text or ""), got.get(doc, [])
        long = {(f[2], f[3]): f for f in want if f[4] is None}
        short = [f for f in want if f[4] is not None]
        places = [m.span() for m in lc.WORD.finditer(text or "")]
        for r in mine:
            seen += 1
            if (r.license, r.template) in long:
                assert r.matched_words >= long[r.license, r.template][0] - 2 and r.coverage == r.matched_words / len(next(t for n, k, t in lc.scanner().templates if (n, k) == (r.license, r.template)))
            else:
                assert (r.license, r.template, r.span_start, r.span_end) in {(f[2], f[3], places[f[4]][0], places[f[5]][1]) for f in short}
        best = sorted(want, key=lambda f: (-f[0], -f[1]))[:1]
        assert bool(mine) == bool(want) and (not best or any(r.matched_words >= best[0][0] - 2 for r in mine))
    assert seen > len(lc.TEMPLATES)
