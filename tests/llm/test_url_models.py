from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quire.llm import urls


def spelt(url):
    plain = "".join("0" if "0" <= c <= "9" else c for c in url.split("://", 1)[1].lower())
    nibble = str.maketrans("0123456789abcdef", "abcdefghijklmnop")
    return "".join(c if c in urls.SYMBOLS[:-3] else "~" + c.encode().hex().translate(nibble) for c in plain) + "$"


def brute(pages):
    """Scores by Witten-Bell interpolation of every order, from plain dictionaries."""
    counts = {c: [defaultdict(Counter) for _ in range(urls.MAX_ORDER + 1)] for c in ("block", "allow")}
    for url, ruled in pages:
        text = "^" * urls.MAX_ORDER + spelt(url)
        for i in range(urls.MAX_ORDER, len(text)):
            for k in range(urls.MAX_ORDER + 1 if ruled else 0):
                counts[ruled][k][text[i - k : i]][text[i]] += 1

    def p(c, text, i, less):
        out = 1 / urls.BASE
        for k in range(urls.MAX_ORDER + 1):
            seen = counts[c][k].get(text[i - k : i], Counter())
            own = less and k > 2
            n, total = seen[text[i]] - own, sum(seen.values()) - own
            kinds = sum(v > 0 for v in seen.values()) - (own and n == 0) if k else urls.BASE
            out = (n + kinds * out) / (total + kinds) if total > 0 else out
        return out

    scores = {}
    for url, ruled in pages:
        text = "^" * urls.MAX_ORDER + spelt(url)
        places = range(urls.MAX_ORDER, len(text))
        scores[url] = sum(math.log(p("block", text, i, ruled == "block")) - math.log(p("allow", text, i, ruled == "allow")) for i in places) / len(places)
    return scores


def judged(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    return {pages[r.page_id]: r for r in urls.judge(df).collect()}


def test_scores_equal_brute_force(spark, monkeypatch):
    pages = [f"http://{w}{i % 7}.{t}/{p}{i * 37}" for i, w in enumerate(["free-bets", "école", "news", "a+b", "日本", "x"] * 4) for t, p in (("net", "x/"), ("org", "fr/"), ("com", "y?q="))]
    pages += pages[:9]
    want = brute([(u, "block" if ".net/" in u else "allow" if ".org/fr/" in u else None) for u in pages])
    for hot in (urls.HOT, 40):
        monkeypatch.setattr(urls, "HOT", hot)
        got = judged(spark, pages)
        assert all(abs(got[u].score - want[u]) < 1e-9 for u in pages)


def test_evidence_longer_than_three_symbols(spark):
    """Both classes have the same triples in their host words; only what is four symbols before tells."""
    words = {"block": ["aaaaccccd", "bbbbcccce"], "allow": ["aaaacccce", "bbbbccccd"]}
    end = {"block": ".net/fr/", "allow": ".org/fr/"}
    pages = [f"http://{w}{end[c]}{i}" for c, ws in words.items() for w in ws for i in range(30)]
    probes = {f"http://{w}.com/": c for c, ws in words.items() for w in ws}
    got = judged(spark, [*pages, *probes])
    assert min(got[u].score for u, c in probes.items() if c == "block") > max(got[u].score for u, c in probes.items() if c == "allow") + 0.01


def test_long_contexts_grow_with_the_input(spark):
    few, more = (spark.range(n).select(F.concat(F.lit("http://"), F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789", "ghijklmnop"), F.lit(".net/")).alias("url"), F.lit("block").alias("ruled"), F.lit(1).alias("rows")) for n in (100, 2000))
    assert urls.gram_counts(more).count() > 15 * urls.gram_counts(few).count() and urls.gram_counts(more).count() > urls.BASE**3
