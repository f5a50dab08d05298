"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: words and word stems that occur in toxic documents far
more often than in others (a G test strict enough for the number of candidates). A deterministic
automaton for "within one edit of a trie path" is built lazily: a state is the set of (trie node,
edits) reachable so far, so a word costs one table look-up a letter and dies after a few.

A hit's weight is the log-odds of its term, of how it matched and of how many different words matched
it (one, two, or more: a stem that innocent texts hold once may be telling where it recurs), from the same
sample; within quotation marks or after a word of reporting it counts for less. The sum is made a probability by a
two-parameter logistic fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, append_columns, free_name, rows_of, slices, tool

#: Bound of the labelled sample that the model is fitted on (rows with the least hash of doc_id).
SAMPLE = 12_000
MAX_TERMS, CANDIDATES = 400, 5000
#: Least G statistic of a term: p below 1e-6 for one term, so few of some hundred thousand pass by chance.
LEAST_G, LEAST_LOG_ODDS = 25.0, 3.5
#: Shares of the sample's toxic documents: that a candidate term occurs in, that a kept one adds, unless it is in so many.
LEAST_SHARE, LEAST_NEW, COMMON = 0.01, 0.002, 0.08
#: Weight of near matches that the sample doesn't hold, for whole words and for stems.
UNSEEN_NEAR = (4.0, 1.0)
STEM_LENGTHS = range(3, 9)
#: Different words of a term that are told apart: 1, 2, or this many and more.
LEVELS = 3
#: Ends of the keys that count documents with two and with three words of a stem.
MANY = ("", "\x02", "\x03")
#: Log-odds from which a level of a chosen term has weight.
LEAST_LEVEL = 1.0
FUZZY_FROM = 5
THRESHOLD = 0.3
#: Score of a text without a hit at most, however many of the labelled documents are toxic: no evidence, no rejection.
MOST_WITHOUT = 0.25
WINDOW, QUOTED, REPORTED = 5, 0.35, 0.6
#: Bytes of the memo table of a worker, and states of its automaton, after which either starts anew.
MEMO_BYTES, STATES = 40 << 20, 8000

#: Marks that open or close a quotation, words that introduce one, letter look-alikes.
OPENING, CLOSING = "\"'“„«‘‚‹", "\"'”“»’›"
REPORTING = frozenset("said says wrote writes called quote quoted quoting dit disait écrit sagte sagt schrieb dijo dice escribió".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

RUN = re.compile(r"[^\W\d_]+")


def terms_of(chunk: str) -> list[str]:
    """Lower-cased letter runs of a white-space chunk, look-alike characters within words undone."""
    word = chunk.strip("#*%&$.,;:!?()[]{}<>|/\\\"'“”„«»‘’‚‹›-_=+~`^").lower()
    if not word:
        return []
    if word.isalpha():
        return [word]
    return RUN.findall(word.translate(LOOKALIKES) if any(c.isalpha() for c in word) else word)


class FuzzyLexicon:
    """Terms ending in ``$`` are whole words, the others stems that a word may begin with."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        for i, term in enumerate(terms):
            node = 0
            for c in term.rstrip("$"):
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
            (self.word if term.endswith("$") else self.stem)[node] = i
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.moves: dict[tuple[int, str], int] = {}
        self.found: list[tuple[int, int]] = [(0, 0)]
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        closed = set(pairs)
        for node, edits in pairs:
            if not edits:  # a letter of the term is missing from the word
                closed.update((child, 1) for child in self.children[node].values())
        closed -= {(n, 1) for n, e in closed if not e}
        key = frozenset(closed)
        if (at := self.ids.get(key)) is None:
            at = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.found.append((self._best(key, self.word), self._best(key, self.stem)))
        return at

    def _best(self, pairs: frozenset, ends: dict[int, int]) -> int:
        """0, or 1 + 2 * term + edits of the best term that ends here."""
        hits = [(edits, ends[node]) for node, edits in pairs if node in ends and (not edits or len(self.terms[ends[node]].rstrip("$")) >= FUZZY_FROM)]
        return 1 + 2 * min(hits)[1] + min(hits)[0] if hits else 0

    def _move(self, state: int, letter: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            step = self.children[node].get(letter)
            if step is not None:
                out.add((step, edits))
            if not edits:  # another letter in its place, or one too many
                out.update((child, 1) for c, child in self.children[node].items() if c != letter)
                out.add((node, 1))
        to = self._state(out) if out else 0
        self.moves[state, letter] = to
        return to

    def match(self, word: str) -> int:
        """0, or 1 + 2 * term + edits (0 or 1): exact before near, whole words before stems."""
        if len(self.sets) > STATES:
            self._reset()
        state, near, moves = self.start, 0, self.moves
        for letter in word:
            nxt = moves.get((state, letter))
            state = self._move(state, letter) if nxt is None else nxt
            if not state:
                return near
            hit = self.found[state][1]
            if hit:
                if hit & 1:  # exact
                    whole = self._exact_word(word)
                    return whole or hit
                near = near or hit
        whole = self.found[state][0]
        return whole if whole and (whole & 1 or not near) else near or whole

    def _exact_word(self, word: str) -> int:
        node: int | None = 0
        for c in word:
            node = self.children[node].get(c)
            if node is None:
                return 0
        return 1 + 2 * self.word[node] if node in self.word else 0


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)  # of LEVELS * (2 * term + edits) + level
    bias: float = -40.0
    slope: float = 1.0


class Matcher:
    """Hits of whole texts for one lexicon; lives in a worker."""

    def __init__(self, terms: tuple[str, ...]) -> None:
        self.lexicon = FuzzyLexicon(list(terms))
        self.memo = Memo(self._chunk, MEMO_BYTES)

    def _chunk(self, chunk: str) -> int:
        hits = [h for w in terms_of(chunk) if (h := self.lexicon.match(w))]
        return min(hits, key=lambda h: (not h & 1, h)) if hits else 0

    def hits(self, text: str) -> dict[int, float]:
        """{LEVELS * (2 * term + edits) + level: greatest context factor} over the whole text."""
        chunks = text.split()
        words: dict[int, set[tuple[str, ...]]] = {}
        factors: dict[int, float] = {}
        for i, hit in enumerate(map(self.memo.__getitem__, chunks)):
            if hit:
                met = words.setdefault(hit - 1, set())
                if len(met) < LEVELS:
                    met.add(tuple(terms_of(chunks[i])))
                factors[hit - 1] = max(factors.get(hit - 1, 0.0), context(chunks, i))
        return {LEVELS * hit + len(words[hit]) - 1: factor for hit, factor in factors.items()}


def context(chunks: list[str], i: int) -> float:
    """1 for plain use, less within quotation marks or after a word of reporting."""
    before, after = chunks[max(0, i - WINDOW) : i + 1], chunks[i : i + WINDOW + 1]
    if any(c[0] in OPENING for c in before) and any((c.rstrip(".,;:!?") or c)[-1] in CLOSING for c in after):
        return QUOTED
    if any(c.strip(".,;:").lower() in REPORTING for c in before[:-1]):
        return REPORTED
    return 1.0


def matcher(terms: tuple[str, ...]) -> Matcher:
    return tool(("toxicity", terms), lambda: Matcher(terms))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled training rows: of equal texts one, so that copies don't make terms."""
    known = rows_of(labels, doc_id=F.col("doc_id").cast("long"), toxic=F.col("toxic").cast("int")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most ``bound`` rows of 12 bytes, so it is sent to the documents rather than they to it.
    texts = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    return texts.withColumn("address", F.sha2("text", 256)).dropDuplicates(["address", "toxic"]).select("text", "toxic")


def countable(text: str) -> set[str]:
    """The keys that a document counts for: every word, every stem, stems of several words, and itself (the empty key)."""
    seen, stems = {""}, Counter()
    for word in {w for c in set(text.split()) for w in terms_of(c)}:
        seen.add(word + "$")
        stems.update(word[:n] for n in STEM_LENGTHS if n <= len(word))
    for stem, n in stems.items():
        seen.update(stem + MANY[level] for level in range(min(n, LEVELS)))
    return seen


def _stem_counts(sample: DataFrame) -> DataFrame:
    """term, n_toxic, n_clean: in how many sampled documents a word or stem occurs, or two or three words of a stem."""
    schema = pa.schema([("term", pa.string()), ("n_toxic", pa.int64()), ("n_clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], schema=schema)
            for c in counts:
                c.clear()
            return out

        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(countable(text or ""))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
        yield flush()

    return sample.mapInArrow(run, "term string, n_toxic long, n_clean long").groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """Greedy: best evidence first, the longer of equals; a stem covers what begins with it. Terms are without the ends of MANY."""

    def odds(t: int, c: int) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    ranked = sorted(rows, key=lambda r: (-r[1] * odds(r[1], r[2]), -len(r[0]), r[0]))
    chosen: dict[str, int] = {}
    for term, t, _ in ranked:
        if len(chosen) == MAX_TERMS:
            break
        term = term.rstrip("".join(MANY))
        bare = term.rstrip("$")
        covered = any(bare[:n] in chosen for n in range(1, len(bare) + 1))
        narrower = sum(n for other, n in chosen.items() if other.startswith(bare)) >= 0.9 * t and not term.endswith("$")
        if not covered and not narrower:
            chosen[term] = t
    return list(chosen)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by damped Newton steps, held to slope 1: classes that don't overlap have no other maximum."""
    start = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 1.0])
    prior, design = np.array([0.01, 1.0]), np.stack([np.ones_like(x), x], 1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (prior * (w - start) ** 2).sum())

    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (p - y) + prior * (w - start)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(prior), grad)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Fits a :class:`Model`. Without documents of both labels nothing tells them apart: all texts score as clean."""
    sample = labelled_sample(docs, labels, bound).cache()
    try:
        counts = _stem_counts(sample).cache()
        totals = counts.filter("term = ''").first()
        toxic, clean = (totals["n_toxic"], totals["n_clean"]) if totals else (0, 0)
        if not toxic or not clean:
            counts.unpersist()
            return Model()
        t, c, n = F.col("n_toxic"), F.col("n_clean"), toxic + clean
        expected = (t + c) * toxic / n
        g = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0.0))
        log_odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
        rows = counts.filter("term <> ''").filter(t >= max(3, LEAST_SHARE * toxic)).filter((g >= LEAST_G) & (log_odds >= LEAST_LOG_ODDS)).orderBy(F.desc(g), "term").limit(CANDIDATES).collect()
        counts.unpersist()
        terms = choose_terms([tuple(r) for r in rows], toxic, clean)

        schema = pa.schema([("toxic", pa.int32()), ("hits", pa.list_(pa.int32())), ("factors", pa.list_(pa.float64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                hits = [matcher(tuple(terms)).hits(text or "") for text in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(h) for h in hits], pa.list_(pa.int32())), pa.array([list(h.values()) for h in hits], pa.list_(pa.float64()))], schema=schema)

        seen = sample.mapInArrow(run, "toxic int, hits array<int>, factors array<double>").collect()  # at most ``bound`` rows
    finally:
        sample.unpersist()
    return fit(terms, [(r.toxic, r.hits, r.factors) for r in seen], toxic, clean)


def fit(terms: list[str], seen: list[tuple[int, list[int], list[float]]], toxic: int, clean: int) -> Model:
    """Keeps the terms that explain documents no better term does, weighs them, fits the logistic.

    ``seen`` has (label, hits, context factors) of every sampled document. Words that merely go along
    with a toxic term, as in copies of one document, add no document of their own and go.
    """
    places: dict[int, list[int]] = {}
    for at, (_, hits, _) in enumerate(seen):
        for hit in hits:
            places.setdefault(hit, []).append(at)
    label = np.array([row[0] for row in seen], bool)
    covered = np.zeros(len(seen), bool)

    def odds(at: np.ndarray) -> float:
        t = int(label[at].sum())
        return math.log((t + 0.5) / (toxic + 1)) - math.log((len(at) - t + 0.5) / (clean + 1))

    def levels(hit: int) -> list[np.ndarray]:
        return [np.array(places.get(LEVELS * hit + level, []), int) for level in range(LEVELS)]

    def weighed(found: list[np.ndarray]) -> list[float]:
        """A level counts no less than the one below; one that the sample doesn't hold counts like it."""
        out: list[float] = []
        for at in found:
            value = min(8.0, odds(at)) if len(at) else 0.0
            out.append(max([value if value >= LEAST_LEVEL else 0.0, *out[-1:]]))
        return out

    weights = [0.0] * (2 * LEVELS * len(terms))
    for i in range(len(terms)):
        found = levels(2 * i)
        at = np.concatenate([x for x in found if len(x) and odds(x) >= LEAST_LEVEL] or [np.empty(0, int)])
        new = at[~covered[at]]
        adds = label[new].sum() >= max(2, LEAST_NEW * toxic) and odds(new) >= LEAST_LOG_ODDS
        if adds or label[at].sum() >= COMMON * toxic and odds(at) >= LEAST_LOG_ODDS:
            covered[at] = True
            near = levels(2 * i + 1)
            every = np.concatenate(near)
            unseen = [UNSEEN_NEAR[not terms[i].endswith("$")]] * LEVELS
            weights[2 * LEVELS * i : 2 * LEVELS * (i + 1)] = weighed(found) + (unseen if not len(every) else weighed(near) if odds(every) >= LEAST_LOG_ODDS else [0.0] * LEVELS)
    evidence = np.array([sum(weights[h] * f for h, f in zip(hits, factors, strict=True)) for _, hits, factors in seen])
    bias, slope = _logistic(evidence, label.astype(float))
    bias = min(bias, math.log(MOST_WITHOUT / (1 - MOST_WITHOUT)))
    of = [weights[2 * LEVELS * i : 2 * LEVELS * (i + 1)] for i in range(len(terms))]
    kept = [i for i in range(len(terms)) if any(of[i][:LEVELS])]
    return Model([terms[i] for i in kept], [w for i in kept for w in of[i]], bias, slope)


def scores(model: Model, texts: list[str]) -> list[float]:
    found = matcher(tuple(model.terms))
    out = []
    for text in texts:
        x = model.bias + model.slope * sum(model.weights[h] * f for h, f in found.hits(text).items())
        out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, x)))))
    return out


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a toxicity score of each whole text; null and empty texts score as without a hit."""
    return append_columns(docs, "text", lambda texts: [scores(model, texts)], [(column, pa.float64(), "double")])


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (doc_id, text); a null doc_id isn't held out.

    Null and empty texts are scored like texts without a hit; repeated rows are scored alike; of a doc_id that is labelled
    twice the toxic label counts; very long texts are read whole; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    model = train(docs, labels)
    texts = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"))
    return score(texts, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or more; all columns stay, whatever their names.

    Null and empty texts stay, as they score like texts without a hit; repeated rows stay or go together; very long texts are read whole; an empty table comes back empty.
    """
    name = free_name(docs, "__toxicity")
    return score(docs, train(docs, labels), name).filter(F.col(name) < threshold).drop(name)
