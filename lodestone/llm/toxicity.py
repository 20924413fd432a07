"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learnt from labelled rows: words and word beginnings that mark toxic texts. Features are
lexicon densities, closeness to second-person words, capitals, punctuation and obfuscation rates. Lexicon
and trees are fitted in turn on two halves of the bounded sample, so that no row is measured with a lexicon
that has seen it; the calibration uses those scores. Executors count the sample's words and measure its rows; only
the parts of words that mark toxic rows and the features reach the driver. Scoring is one pass without a shuffle.

Null and empty texts have empty features and a score. A text of any length is one string in memory, measured in time
linear in its length but for a binary search for each hit. Repeated rows give a row each; an empty table gives an
empty result; without labels the score is 0. Columns besides doc_id and text, whatever their names, are left out by
``op10``; ``keep_clean`` gives back all columns as they are. An id with several labels counts with the highest; of
splits with equal gain the first feature's lowest threshold is taken; equal scores calibrate to one value.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, as_bytes, discard, labelled_sample, remainder
from lodestone.llm.trees import Node, boost, isotonic, margins

#: Labelled rows that lexicon and trees are learnt from, at most.
SAMPLE_ROWS = 6000
#: Toxic rows in which a part must stand, and parts that a task counts together.
LEAST_TOXIC, TALLIED = 3, 1_000_000
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".encode().split())
#: Bytes of a word's beginning that the lexicon looks at, besides the whole word.
BEGINNINGS = (4, 5, 6)
#: Words apart within which a second-person word counts as near.
NEAR = 6
UPPER, FOLLOWING = bytes(range(65, 91)), bytes(range(128, 192))
#: Signs and digits that stand for letters in disguised words.
DISGUISE = bytes.maketrans(b"013457@$!", b"oieastasi")
FEATURES = (
    "hits", "log_hits", "density", "weight_density", "strongest", "kinds", "weak_density", "near_you", "you_density", "capitals",
    "capital_hits", "bangs", "punctuation", "disguised", "stretched", "log_words",
)
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() or chr(c) in "@$!'" else 32 for c in range(256))


def parts(word: bytes) -> list[bytes]:
    """The word and its beginnings; the marks keep them apart."""
    return [word + b"$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Lexicon:
    """Log-odds weights of words (ending in $) and beginnings."""

    strong: dict[bytes, float] = field(default_factory=dict)
    weak: dict[bytes, float] = field(default_factory=dict)
    starts: frozenset[bytes] = frozenset()

    def __post_init__(self) -> None:
        self.starts = frozenset(k[:3] for k in (*self.strong, *self.weak))

    def weigh(self, word: bytes) -> tuple[float, float]:
        """The highest strong and weak weight among the word's parts."""
        found = parts(word)
        return max((self.strong.get(p, 0.0) for p in found)), max((self.weak.get(p, 0.0) for p in found))


def tokens(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(b"!'$@") for x in text.translate(_WORDS).lower().split()) if w]


class _Tallied:
    """Rows of each part, by half and label, that stand in a task's texts; parts are counted once a text."""

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {}
        for b in batches:
            for half, label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                counts.setdefault((half, label), Counter()).update({p for w in set(tokens(text)) for p in parts(w)})
            if sum(map(len, counts.values())) > TALLIED:
                yield self._batch(counts)
                counts = {}
        yield self._batch(counts)

    @staticmethod
    def _batch(counts: dict[tuple[int, int], Counter]) -> pa.RecordBatch:
        rows = [(p, half, label, n) for (half, label), c in counts.items() for p, n in c.items()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "half", "label", "n"])


def learn(rows: Iterable[tuple[bytes, int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    """From (part, toxic rows, clean rows): parts that stand in toxic rows far more than in others, by smoothed log-odds."""
    strong, weak = {}, {}
    for part, toxic, clean in rows:
        if toxic < LEAST_TOXIC:
            continue
        odds = log((toxic + 0.5) / (n_toxic + 1)) - log((clean + 0.5) / (n_clean + 1))
        if odds >= 3.0 and clean <= 0.1 * toxic:
            strong[part] = odds
        elif odds >= 1.0:
            weak[part] = odds
    return Lexicon(strong, weak)


def lexicons(sample: DataFrame, totals: dict[tuple[int, int], int]) -> tuple[Lexicon, Lexicon, Lexicon]:
    """Of the first half, of the second, and of all rows; from (half, label, text). totals: rows by half and label."""
    found = arrow_map(sample.select("half", "label", "text"), _Tallied(), "part binary, half int, label int, n long")
    count = lambda half, label: F.sum(F.when((F.col("half") == half) & ((F.col("label") == 1) if label else (F.col("label") != 1)), F.col("n")).otherwise(0))
    by_part = found.groupBy("part").agg(*[count(half, label).alias(f"{'toxic' if label else 'clean'}{half}") for half in (0, 1) for label in (1, 0)])
    rows = by_part.where(F.col("toxic0") + F.col("toxic1") >= LEAST_TOXIC).orderBy("part").collect()  # of the bounded sample's words
    n = lambda halves, toxic: sum(v for (h, label), v in totals.items() if h in halves and (label == 1) == toxic)
    told = lambda *halves: learn(((bytes(r.part), sum(r[f"toxic{h}"] for h in halves), sum(r[f"clean{h}"] for h in halves)) for r in rows), n(halves, True), n(halves, False))
    return told(0), told(1), told(0, 1)


def features(text: bytes, lexicon: Lexicon, known: dict[bytes, tuple[float, float]]) -> tuple[float, ...]:
    """The features of a whole text. known: weights of words that were met before, kept small by the caller."""
    words = tokens(text)
    n, size = max(1, len(words)), max(1, len(text))
    starts = lexicon.starts
    hits: list[tuple[int, float]] = []
    weak, kinds = 0.0, set()
    disguised = 0
    for i, w in enumerate(words):
        if w[:3] in starts or len(w) < 3:
            got = known.get(w)
            if got is None:
                got = known[w] = lexicon.weigh(w)
            if got[0]:
                hits.append((i, got[0]))
                kinds.add(w)
            elif got[1]:
                weak += 1
    for w in text.split():
        if not w.isalpha() and (plain := w.strip(b".,;:!?\"'()").lower()) and not plain.isalpha() and any(97 <= c <= 122 for c in plain):
            told = plain.translate(DISGUISE, b"*_-.")
            if told != plain and told.isalpha() and told[:3] in starts and lexicon.weigh(told)[0]:
                disguised += 1
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = sum(1 for i, _ in hits if (k := bisect_left(you, i - NEAR)) < len(you) and you[k] <= i + NEAR)
    capitals = len(text) - len(text.translate(None, UPPER))
    shouted = sum(1 for w in kinds if w.upper() in text)
    points = sum(text.count(c) for c in (b"!", b"?"))
    stretched = sum(1 for w in kinds if any(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2)))
    total = sum(v for _, v in hits)
    return (
        len(hits), log1p(len(hits)), len(hits) / n, total / n, max((v for _, v in hits), default=0.0), len(kinds), weak / n, near,
        len(you) / n, capitals / size, shouted, text.count(b"!") / size, points / size, disguised, stretched, log1p(len(words)),
    )


@dataclass
class Model:
    lexicon: Lexicon
    trees: tuple[float, list[Node]]
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[bytes], known: dict[bytes, tuple[float, float]] | None = None) -> np.ndarray:
        known = {} if known is None else known
        x = np.array([features(t, self.lexicon, known) for t in texts], float).reshape(-1, len(FEATURES))
        return np.clip(np.interp(margins(self.trees, x), *self.knots), 0.0, 1.0)


class _Featured:
    """Half, label and features of the sample's rows, each under the lexicon of the other half."""

    def __init__(self, by_half: tuple[Lexicon, Lexicon]) -> None:
        self.by_half = by_half

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[dict, dict] = {}, {}
        for b in batches:
            rows = [features(t, self.by_half[1 - h], known[h]) for h, t in zip(b.column(0).to_pylist(), as_bytes(b.column(2)), strict=True)]
            x = np.array(rows, float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, j]) for j in range(len(FEATURES)))], names=["half", "label", *FEATURES])


def fit(x: np.ndarray, y: np.ndarray, half: np.ndarray, lexicon: Lexicon) -> Model:
    """Trees over features, and their calibration by the scores that the other half's trees give."""
    if len(y) < 4 or len(set(y.tolist())) < 2:
        return Model(Lexicon(), (0.0, []), (np.array([0.0]), np.array([float(y.mean()) if len(y) else 0.0])))
    out_of_fold = np.zeros(len(y))
    for k in (0, 1):
        at = half == k
        out_of_fold[at] = margins(boost(x[~at], y[~at], trees=40), x[at])
    return Model(lexicon, boost(x, y, trees=40), isotonic(out_of_fold, y))


class _Scored:
    def __init__(self, model: Model) -> None:
        self.model = model

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, float]] = {}
        for b in batches:
            if len(known) > 200_000:
                known.clear()
            score = self.model.score(as_bytes(b.column(b.num_columns - 1)), known)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "score"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``score`` of each row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), _Scored(model), f"doc_id {kind}, score double")


def fit_on(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    kept = labelled_sample(documents, labels, "toxic", 4, 2, sample_rows)
    sample = kept.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))
    totals = {(r.half, r.label): r.n for r in sample.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, second, whole = lexicons(sample, totals)
    schema = "half int, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = arrow_map(sample.orderBy("doc_id").select("half", "label", "text"), _Featured((first, second)), schema).collect()  # at most `sample_rows` rows of numbers
    discard(kept)
    x = np.array([r[2:] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label == 1 for r in rows], float), np.array([r.half for r in rows], int), whole)


class _Kept:
    """Rows whose text the model does not reject, unchanged."""

    def __init__(self, model: Model, threshold: float, text: int) -> None:
        self.model, self.threshold, self.text = model, threshold, text

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, float]] = {}
        for b in batches:
            if len(known) > 200_000:
                known.clear()
            yield b.filter(pa.array(self.model.score(as_bytes(b.column(self.text)), known) < self.threshold))


def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` with a score under the threshold, all columns."""
    return arrow_map(documents, _Kept(model, threshold, documents.columns.index("text")), documents.schema)


def op10(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from rows whose crc32 modulo 4 is not 2."""
    return score(documents, fit_on(documents, labels, sample_rows)).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
