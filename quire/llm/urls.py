"""URL filter: rules first, then a ratio of character models, in DataFrame functions only.

Two smoothed variable-order Markov models are counted, over the URLs that rules accept and over those
that they reject. The order varies by context: Witten-Bell interpolation gives a context of up to
``MAX_ORDER`` symbols the more weight the more often it was seen, else falls back to a shorter one,
down to all symbols alike. The filter is the mean log-likelihood difference a character, cut at a point
calibrated on both classes; URLs with a rule are scored without their own counts of longer contexts.

URLs are spelt in 40 symbols (digits become 0; what is none of them is spelt by its bytes). Contexts of up to
two symbols make a dense table. Longer ones are gathered as the input has them, counted once a
different gram and joined by gram; only grams that make up a fixed share of all are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import rows_of, stash
from quire.operators.image import let

#: Fixed values: (verdict, host, path), and the symbols of the models (digits become 0, others ~ and their bytes).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-_?=&%:#~^$"
BASE = len(SYMBOLS)
#: Symbols of a context at most; a gram is one more, and BASE**9 fits a long.
MAX_ORDER = 8
#: Grams that are at least one in so many of all positions are broadcast: so many rows at most.
HOT = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path of ``url``: both empty without ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    pages = pages.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.substring(F.col("__rest"), F.length("__host") + 1, F.length("__rest")), r"^[^?#]*", 0)
    return pages.withColumn("host", F.translate("__host", UPPER, LOWER)).withColumn("path", path).drop("__rest", "__host")


def matched_rule(what: int, rules: tuple = RULES) -> Column:
    """The longest fitting rule: its text (what=0) or its verdict (what=1); null without one."""
    out = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit((host + path, verdict)[what])).otherwise(out)
    return out


def symbol_grams(url: Column) -> Column:
    """Ids of the grams of MAX_ORDER + 1 symbols of a URL, scheme left out, one for each symbol and the end mark."""

    def chained(head: Column, tail: Column, at: int, symbols: int) -> Column:
        both = F.zip_with(head, F.slice(tail, F.lit(at + 1), F.size(tail)), lambda a, b: a * F.lit(BASE**symbols) + b)
        return F.filter(both, lambda g: g.isNotNull())

    plain = F.regexp_replace(F.lower(F.regexp_replace(url, r"(?s)^.*?://", "")), "[0-9]", "0")
    parts = F.transform(F.split(plain, ""), lambda c: F.when(c.rlike(r"^[a-z0./\-_?=&%:#]?$"), c).otherwise(F.concat(F.lit("~"), F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "abcdefghijklmnop"))))
    spelt = F.concat(F.lit("^" * MAX_ORDER), F.array_join(parts, ""), F.lit("$"))
    codes = F.transform(F.filter(F.split(spelt, ""), lambda c: c != ""), lambda c: (F.call_function("instr", F.lit(SYMBOLS), c) - 1).cast("long"))
    return let([codes], lambda c: let([chained(c, c, 1, 1)], lambda two: let([chained(two, two, 2, 2)], lambda four: let([chained(four, four, 4, 4)], lambda eight: chained(eight, c, 8, 1)))))


def _p(n: str) -> Column:
    """p(c | a, b) by Witten-Bell interpolation, from counts ``n`` of all triples (a, b, c)."""

    def total(*by: str) -> Column:
        return F.sum(n).over(Window.partitionBy(*by))

    lowest = 1.0 / BASE
    one = (total("c") + BASE * lowest) / (total("all") + BASE)
    seen_b = F.sum(F.when(F.col(f"first_bc_{n}") & (F.col(f"bc_{n}") > 0), 1).otherwise(0)).over(Window.partitionBy("b"))
    two = F.when(total("b") > 0, (F.col(f"bc_{n}") + seen_b * one) / (total("b") + seen_b)).otherwise(one)
    seen_ab = F.sum((F.col(n) > 0).cast("int")).over(Window.partitionBy("a", "b"))
    return F.when(total("a", "b") > 0, (F.col(n) + seen_ab * two) / (total("a", "b") + seen_ab)).otherwise(two)


def model(labelled: DataFrame) -> DataFrame:
    """(triple, p_block, p_allow, ratio): both models' p of contexts of two symbols, and ln p(rejected) - ln p(accepted),
    for all 40**3 triples, of (url, verdict)."""
    triples = labelled.select("verdict", F.explode(symbol_grams(F.col("url"))).alias("gram")).select("verdict", (F.col("gram") % BASE**3).cast("int").alias("triple"))
    counts = triples.groupBy("triple").agg(F.count(F.when(F.col("verdict") == "block", 1)).alias("n_block"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("n_allow"))
    every = labelled.sparkSession.range(BASE**3).withColumnRenamed("id", "triple").withColumn("triple", F.col("triple").cast("int"))
    dense = every.join(counts, "triple", "left").fillna(0, ["n_block", "n_allow"])
    dense = dense.withColumns({"a": F.expr(f"triple div {BASE * BASE}"), "b": F.expr(f"triple div {BASE} % {BASE}"), "c": F.col("triple") % BASE, "all": F.lit(0)})
    for n in ("n_block", "n_allow"):
        dense = dense.withColumn(f"bc_{n}", F.sum(n).over(Window.partitionBy("b", "c"))).withColumn(f"first_bc_{n}", F.col("a") == 0)
    dense = dense.select("triple", _p("n_block").alias("p_block"), _p("n_allow").alias("p_allow"))
    return dense.withColumn("ratio", F.log("p_block") - F.log("p_allow"))


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, seen, n_block, n_allow) of different URLs (url, ruled, rows): every gram, its places, and its count by class in all rows."""
    grams = urls.select("ruled", "rows", F.explode(symbol_grams(F.col("url"))).alias("gram"))
    by_class = [F.sum(F.when(F.col("ruled") == c, F.col("rows")).otherwise(0)).alias(f"n_{c}") for c in ("block", "allow")]
    return grams.groupBy("gram").agg(F.count("*").alias("seen"), *by_class)


def gram_ratios(grams: DataFrame, low: DataFrame) -> DataFrame:
    """(gram, seen, ratio, ratio_block, ratio_allow) of :func:`gram_counts` and :func:`model`.

    Each order from 3 to MAX_ORDER refines the one below. The last two ratios are for URLs of that class:
    one occurrence is taken out of its counts.
    """
    ps = ("p_block", "less_block", "p_allow", "less_allow")
    below = low.select(F.col("triple").cast("long").alias("below"), F.col("p_block"), F.col("p_block").alias("less_block"), F.col("p_allow"), F.col("p_allow").alias("less_allow"))
    for order in range(3, MAX_ORDER + 1):
        level = grams.select((F.col("gram") % F.lit(BASE ** (order + 1))).alias("suffix"), "seen", "n_block", "n_allow").groupBy("suffix").agg(*(F.sum(c).alias(c) for c in ("seen", "n_block", "n_allow")))
        context = Window.partitionBy("context")
        level = level.withColumn("context", F.expr(f"suffix div {BASE}")).withColumn("below", F.col("suffix") % F.lit(BASE**order))
        level = level.withColumns({f"{name}_{c}": F.sum(value).over(context) for c in ("block", "allow") for name, value in (("all", F.col(f"n_{c}")), ("kinds", (F.col(f"n_{c}") > 0).cast("long")))})
        refined = {}
        for c in ("block", "allow"):
            n, total, kinds = F.col(f"n_{c}"), F.col(f"all_{c}"), F.col(f"kinds_{c}")
            refined[f"p_{c}"] = F.when(total > 0, (n + kinds * F.col(f"p_{c}")) / (total + kinds)).otherwise(F.col(f"p_{c}"))
            fewer = kinds - (n == 1).cast("long")
            refined[f"less_{c}"] = F.when(n < 1, refined[f"p_{c}"]).when(total > 1, (n - 1 + fewer * F.col(f"less_{c}")) / (total - 1 + fewer)).otherwise(F.col(f"less_{c}"))
        below = level.join(below, "below").select(F.col("suffix").alias("below"), "seen", *(refined[p].alias(p) for p in ps))
        if order < MAX_ORDER:
            below = below.drop("seen")
    ratio = lambda block, allow: F.log(block) - F.log(allow)
    return below.select(F.col("below").alias("gram"), "seen", ratio("p_block", "p_allow").alias("ratio"), ratio("less_block", "p_allow").alias("ratio_block"), ratio("p_block", "less_allow").alias("ratio_allow"))


def url_scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(uid, score): the mean ratio a symbol of (uid, url, ruled).

    Grams that hold a share of 1 / HOT of all places are at most HOT rows and broadcast; the others meet by a shuffle,
    where no gram has more than that share.
    """
    least = (ratios.agg(F.sum("seen")).first()[0] or 0) / HOT
    value = F.when(F.col("ruled") == "block", F.col("ratio_block")).when(F.col("ruled") == "allow", F.col("ratio_allow")).otherwise(F.col("ratio"))
    spread = urls.select("uid", "ruled", F.explode(symbol_grams(F.col("url"))).alias("gram"))
    hot, cold = ratios.filter(F.col("seen") >= least).drop("seen"), ratios.filter(F.col("seen") < least).drop("seen")
    marked = spread.join(F.broadcast(hot), "gram", "left")
    near = marked.filter("ratio IS NOT NULL").select("uid", value.alias("value"))
    far = marked.filter("ratio IS NULL").select("uid", "ruled", "gram").join(cold, "gram").select("uid", value.alias("value"))
    return near.union(far).groupBy("uid").agg(F.avg("value").alias("score"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of (page_id, url).

    Null URLs and those without ``://`` have empty parts, no rule and, if null, no score; without a
    score, or without URLs of both classes to learn from, the method's verdict is allow. Repeated
    rows are judged alike; an empty table gives an empty result.
    """
    rows = with_parts(rows_of(pages, page_id="page_id", url=F.col("url").cast("string"))).withColumn("rule", matched_rule(0)).withColumn("ruled", matched_rule(1))
    urls = stash(rows.filter("url IS NOT NULL").groupBy("url", "ruled").agg(F.count("*").alias("rows")).withColumn("uid", F.monotonically_increasing_id()), "urls")
    low = stash(model(rows.filter("ruled IS NOT NULL").select("url", F.col("ruled").alias("verdict"))), "url-model")
    ratios = stash(gram_ratios(stash(gram_counts(urls), "url-grams"), low), "url-ratios")
    known = urls.join(stash(url_scores(urls, ratios), "url-scores"), "uid").select("url", "score")
    scored = rows.join(known, "url", "left")
    cut = scored.agg(F.percentile_approx(F.when(F.col("ruled") == "allow", F.col("score")), 0.95).alias("allow"), F.percentile_approx(F.when(F.col("ruled") == "block", F.col("score")), 0.05).alias("block")).first()
    at = (cut["allow"] + cut["block"]) / 2 if cut["allow"] is not None and cut["block"] is not None else math.inf
    verdict = F.coalesce("ruled", F.when(F.col("score") > at, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
