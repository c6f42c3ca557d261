"""Toxicity scores from a learned lexicon, matched by Levenshtein automata run over a trie of its terms.

Terms and stems that mark toxic texts are learned from labelled rows. A word is matched by walking the trie with a set
of (node, errors) places, determinised as it goes and kept for the next word. Every match is weighed by a window of
words around it, where quotation marks and reporting verbs speak for a quotation and further matches for abuse. A
logistic regression over these sums gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize

SAMPLE_ROWS = 20_000  # most labelled rows that lexicon and weights are learned from
STEM_LENGTHS = range(4, 9)
STEM_WORDS = 4  # a stem needs so many different words
PURITY = 0.97
CHANCE = 0.01  # expected number of terms that owe their place to chance
FUZZY_LENGTH = 4  # terms from this length on may be misspelled by one edit
SURE_LENGTH = 6  # a misspelling of a shorter term is counted apart, as more other words are near it
LEAST_CLEAN = 2  # contexts in clean texts that make a word one that is no misspelling
MEMO_STATES = 50_000
WINDOW = 6
MEMO_WORDS = 200_000
PUNCTUATION = ".,;:!?()[]{}<>*%$&#\"'“”„«»‚‘’…-–—_"
QUOTES = '"“”„«»'
REPORTING = frozenset("said says wrote writes called quoted quote sagte schrieb zitat dit écrit cité dijo escribió cita".split())


@dataclass
class Lexicon:
    """Whole words and stems (which match any ending) with the weight that each adds.

    ``natural`` words are near some term and are no misspellings of it.
    """

    words: dict[str, float]
    stems: dict[str, float]
    natural: frozenset[str] = frozenset()
    _states: list = field(default_factory=list, repr=False)
    _known: dict = field(default_factory=dict, repr=False)
    _steps: list = field(default_factory=list, repr=False)
    _nodes: list = field(default_factory=list, repr=False)
    _memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.words, self.stems, self.natural

    def __setstate__(self, state):
        self.__init__(*state)

    def _build(self) -> None:
        self._nodes = [({}, None)]
        for term, weight, stem in [*((w, x, False) for w, x in self.words.items()), *((s, x, True) for s, x in self.stems.items())]:
            at = 0
            for c in term:
                children = self._nodes[at][0]
                if c not in children:
                    children[c] = len(self._nodes)
                    self._nodes.append(({}, None))
                at = children[c]
            misspelled = 1 if len(term) >= SURE_LENGTH else 2 if len(term) >= FUZZY_LENGTH else None
            self._nodes[at] = (self._nodes[at][0], (weight, stem, misspelled))
        self._state(self._closed({(0, 0)}))

    def _closed(self, places: set) -> frozenset:
        """Add what is reached by leaving out letters of a term."""
        reached, todo = set(places), list(places)
        while todo:
            node, errors = todo.pop()
            if errors == 0:
                for child in self._nodes[node][0].values():
                    if (child, 1) not in reached:
                        reached.add((child, 1))
                        todo.append((child, 1))
        return frozenset((n, e) for n, e in reached if e == 0 or (n, 0) not in reached)

    def _state(self, places: frozenset) -> int:
        if places not in self._known:
            self._known[places] = len(self._states)
            ends = [(e, *self._nodes[n][1]) for n, e in places if self._nodes[n][1]]
            fits = [(misspelled if e else 0, weight, stem) for e, weight, stem, misspelled in ends if not e or misspelled]
            self._states.append((places, min(((e, -w) for e, w, _ in fits), default=None), min(((e, -w) for e, w, s in fits if s), default=None)))
            self._steps.append({})
        return self._known[places]

    def _next(self, state: int, c: str) -> int:
        after = set()
        for node, errors in self._states[state][0]:
            children = self._nodes[node][0]
            if c in children:
                after.add((children[c], errors))
            if errors == 0:
                after.add((node, 1))
                after.update((child, 1) for child in children.values())
        self._steps[state][c] = found = self._state(self._closed(after)) if after else -1
        return found

    def match(self, word: str) -> tuple[int, float] | None:
        """(kind, weight) of the best term for a lower-case word without punctuation around it.

        The kind is 0 for the term itself, 1 for a misspelling of a term of ``SURE_LENGTH`` and 2 for one of a shorter.
        """
        if not self._states:
            self._build()
        state, best = 0, None
        for c in word:
            after = self._steps[state].get(c)
            state = self._next(state, c) if after is None else after
            if state < 0:
                return best
            stem = self._states[state][2]
            if stem and (best is None or stem < best):
                best = stem
        whole = self._states[state][1]
        return whole if whole and (best is None or whole < best) else best

    def lookup(self, token: str) -> tuple[int, float] | None:
        """``match`` of a token as it stands in a text, remembered for a bounded number of tokens."""
        try:
            return self._memo[token]
        except KeyError:
            if len(self._memo) >= MEMO_WORDS:
                self._memo.clear()
            if len(self._states) >= MEMO_STATES:
                self._states, self._known, self._steps = [], {}, []
            word = token.strip(PUNCTUATION)
            found = self.match(word)
            if found and found[0] and word in self.natural:
                found = None
            self._memo[token] = found
            return found


FEATURES = 10


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """What a whole text holds: exact and misspelled terms, quoted ones, different ones, neighbours, density, short
    misspelled terms, length."""
    tokens = (text or "").lower().split()
    lookup = lexicon.lookup
    hits = {w: found for w in set(tokens) if (found := lookup(w))}
    row = np.zeros(FEATURES)
    row[8] = np.log1p(len(tokens))
    row[9] = 1.0
    if not hits:
        return row
    places = [i for i, w in enumerate(tokens) if w in hits]
    exact = fuzzy = quoted = together = weight = 0.0
    sure = [i for i in places if hits[tokens[i]][0] < 2]
    for k, i in enumerate(sure):
        kind, minus = hits[tokens[i]]
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        quote = sum(c in QUOTES for w in near for c in (w[0], w[-1])) >= 2 or any(w in REPORTING for w in near)
        together += (k > 0 and i - sure[k - 1] <= WINDOW) + (k + 1 < len(sure) and sure[k + 1] - i <= WINDOW)
        quoted += quote
        exact += not kind and not quote
        fuzzy += bool(kind) and not quote
        weight = max(weight, minus * -1 * (0.5 if kind else 1.0) * (0.3 if quote else 1.0))
    short = len(places) - len(sure)
    different = sum(kind < 2 for kind, _ in hits.values())
    density = 1000 * len(sure) / len(tokens)
    row[:8] = [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), np.log1p(different), np.log1p(together), weight, np.log1p(density), np.log1p(short)]
    return row


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights by Newton steps with a ridge penalty on all but the last column, which is constant."""
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 5) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``rows`` labelled ids outside the held-out fold, chosen by hash of the id.

    Of repeated labels the largest counts, of repeated documents the smallest text; null ids and labels are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    ids = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = materialize(ids.limit(rows), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialize(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(24, "doc_id"), "toxic-sample")


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems found almost only in toxic texts, in more contexts than chance explains: the ``SAMPLE_ROWS`` with
    the largest weights of each at most (stems: the shortest first). Words of clean texts that look like misspellings of
    them are kept as natural words, the most frequent first, up to the same bound.

    A context is the word before, so copies of one text do not make its words into terms.
    """
    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic = totals[0] or 0
    clean = totals[1] - toxic
    if not toxic or not clean:
        return Lexicon({}, {})

    def contexts(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortest = min(STEM_LENGTHS)
        for batch in found:
            for label, text in zip(*batch.columns):
                tokens = ["^", *(w.strip(PUNCTUATION) for w in (text.as_py() or "").lower().split())]
                pairs = [p for p in set(zip(tokens[1:], tokens)) if len(p[0]) >= shortest]
                word, before = (list(x) for x in zip(*pairs)) if pairs else ([], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word, pa.string()), pa.array(before, pa.string()), pa.array([label.as_py()] * len(pairs), pa.int32())],
                    names=["word", "before", "toxic"],
                )

    spread = sample.select("toxic", "text").mapInArrow(contexts, "word string, before string, toxic int")
    seen = spread.groupBy("word", "before").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = seen.groupBy("word").agg(F.sum((F.col("t") > 0).cast("int")).alias("t"), F.sum("c").alias("c"))
    counts = materialize(counts, "word-counts")
    needed = np.log(max(counts.count(), 1) / CHANCE) / np.log((toxic + clean) / toxic)
    rate = (F.col("t") / toxic) / (F.col("t") / toxic + F.col("c") / clean)
    good = (F.col("t") >= needed) & (rate >= PURITY)
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    stems = counts.select("*", F.explode(F.array(*[F.lit(n) for n in STEM_LENGTHS])).alias("n")).where(F.length("word") > F.col("n"))
    by_stem = stems.groupBy(F.expr("substring(word, 1, n)").alias("stem")).agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") > 0).cast("int")).alias("words")
    ).where(good & (F.col("words") >= STEM_WORDS))
    kept: dict[str, float] = {}
    for row in by_stem.select("stem", weight.alias("w")).orderBy(F.length("stem"), F.desc("w"), "stem").limit(SAMPLE_ROWS).collect():
        if not any(row["stem"][:n] in kept for n in STEM_LENGTHS):
            kept[row["stem"]] = row["w"]
    words = counts.where(good).select("word", weight.alias("w")).orderBy(F.desc("w"), "word").limit(SAMPLE_ROWS).collect()
    lexicon = Lexicon({r["word"]: r["w"] for r in words}, kept)

    def misspelled(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            near = [bool((m := lexicon.lookup(w)) and m[0]) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    usual = counts.where(F.col("c") >= LEAST_CLEAN).select("word", "c").repartition(24).mapInArrow(misspelled, "word string, c long")
    natural = usual.orderBy(F.desc("c"), "word").limit(SAMPLE_ROWS).collect()
    return Lexicon(lexicon.words, lexicon.stems, frozenset(r["word"] for r in natural))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(text, self.lexicon) @ self.weights, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 5) -> ToxicityModel:
    """Learn lexicon and weights from ``labelled_sample``; without both classes every text gets the share of toxic ones."""
    sample = labelled_sample(docs, labels, rows, folds)
    lexicon = learn_lexicon(sample)

    def measure(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = [features(t.as_py(), lexicon).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows_ = sample.select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").collect()  # at most ``rows``
    if not rows_:
        return ToxicityModel(lexicon, np.array([0.0] * (FEATURES - 1) + [-10.0]))
    y = np.array([r["toxic"] for r in rows_], dtype=float)
    return ToxicityModel(lexicon, fit_logistic(np.array([r["x"] for r in rows_]), y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    A null or empty text has no terms and gets the model's score for that. A null id is not held out. Repeated rows
    get equal scores; an empty table gives no rows. Other columns are not read.
    """
    held = F.coalesce(fold(F.col(key), folds) == 0, F.lit(False))
    narrow = docs.select(F.col(key).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            score = np.array([model.score(t.as_py()) for t in batch.column(2)], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``least``; one pass, no shuffle."""
    place = docs.columns.index(text)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.filter(pa.array([model.score(t.as_py()) < least for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
