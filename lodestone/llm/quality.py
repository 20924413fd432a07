"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees boosted on a bounded labelled sample yield their paths as conjunctive rules; a lasso logistic
regression weighs the rules; what keeps a weight is compiled into one Spark column expression over the
statistics, which are computed over whole texts, one pass and no shuffle. The sample's statistics are measured
by the executors too; only those reach the driver.

Null or empty texts have the statistics of the empty text and get a score like any other. A text of any length is
one string in memory, with its words counted. Columns besides doc_id and text, whatever their names, are left out;
repeated rows and ids give a row each; an empty table gives an empty result; without labels the score is 0.5. An id
with several labels counts with the highest; ids that tie in the sample's order come by the id itself; of splits
with equal gain the first statistic's lowest threshold is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, as_bytes, discard, labelled_sample, remainder
from lodestone.llm.trees import Node, boost, sigmoid

#: Labelled rows that the rules are learnt from, at most.
SAMPLE_ROWS = 4000
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS = b"#$%&*@^~=<>|\\{}[]_+/`"
STOPS = b".,;:!?"
HIGH, FOLLOWING, SPACES = bytes(range(128, 256)), bytes(range(128, 192)), b" \t\n\r\x0b\x0c"

STATISTICS = (
    "log_chars", "upper", "digits", "symbols", "bars", "bangs", "stops", "high", "spaces", "word_len", "log_words",
    "distinct", "top_word", "repeats", "log_lines", "distinct_lines", "line_len", "stop_ends", "symbol_ends", "longest_word",
)


def statistics(text: bytes) -> tuple[float, ...]:
    """The statistics of a whole text, in the order of STATISTICS."""
    size = len(text)
    n = max(1, size)
    left = lambda drop: size - len(text.translate(None, drop))
    words = text.split()
    n_words = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    return (
        log1p(size - left(FOLLOWING)), left(UPPER) / n, left(DIGITS) / n, left(SYMBOLS) / n, text.count(b"|") / n,
        text.count(b"!") / n, left(STOPS) / n, left(HIGH) / n, left(SPACES) / n, (size - len(words)) / n_words, log1p(len(words)),
        len(counts) / n_words, max(counts.values(), default=0) / n_words,
        sum(v for v in counts.values() if v > 1) / n_words, log1p(len(lines)), len(set(lines)) / n_lines, log1p(size / n_lines),
        (text.count(b". ") + text.count(b".\n")) / n_words, sum(text.count(x) for x in (b"% ", b"$ ", b"& ", b"* ", b"# ")) / n_words,
        max(map(len, counts), default=0),
    )


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, goes left, threshold), their weights, and the intercept."""

    intercept: float
    rules: tuple[tuple[tuple[int, bool, float], ...], ...]
    weights: tuple[float, ...]

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for j, left, at in rule:
                holds = holds & (F.col(STATISTICS[j]) <= at if left else F.col(STATISTICS[j]) > at)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def paths(tree: Node, so_far: tuple = ()) -> Iterator[tuple]:
    """Each way from the root to an inner node or leaf, as a conjunction with one bound a side."""
    if tree.left is None:
        return
    for left, child in ((True, tree.left), (False, tree.right)):
        here = {(j, side): at for j, side, at in so_far}
        key = (tree.feature, left)
        here[key] = min(here.get(key, tree.threshold), tree.threshold) if left else max(here.get(key, tree.threshold), tree.threshold)
        rule = tuple(sorted((j, side, at) for (j, side), at in here.items()))
        yield rule
        yield from paths(child, rule)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, left, at in rule:
        out &= x[:, j] <= at if left else x[:, j] > at
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradients; the intercept is free."""
    a = np.hstack([np.ones((len(x), 1)), x])
    rate = 4.0 * len(a) / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        step = z - rate * (a.T @ (sigmoid(a @ z) - y)) / len(a)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> Rules:
    """Rules from boosted trees over statistics and labels, kept where the lasso gives them a weight."""
    if len(set(y.tolist())) < 2:  # no two labels to tell apart
        return Rules(0.0 if not len(y) else 2.0 * float(y[0]) - 1.0, (), ())
    _, trees = boost(x, y, trees=40, depth=3, rate=0.3, bins=48)
    rules = list(dict.fromkeys(r for t in trees for r in paths(t)))
    made = np.stack([holds(r, x) for r in rules], 1).astype(float) if rules else np.zeros((len(x), 0))
    intercept, w = lasso(made, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules(intercept, tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept))


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([statistics(t) for t in as_bytes(b.column(1))], float).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, j]) for j in range(rows.shape[1]))], names=[b.schema.names[0], *STATISTICS])


def measure(rows: DataFrame, key: str) -> DataFrame:
    """The key and the statistics of each row's text."""
    return arrow_map(rows.select(key, "text"), _measured, f"{key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS))


def fit_on(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    sample = labelled_sample(documents, labels, "quality", 3, 1, sample_rows)
    found = measure(sample.orderBy("doc_id"), "label").collect()  # at most `sample_rows` rows of numbers
    discard(sample)
    return fit(np.array([r[1:] for r in found], float).reshape(-1, len(STATISTICS)), np.array([r.label for r in found], float))


def score(documents: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, the statistics and ``score`` of each row."""
    return measure(documents, "doc_id").withColumn("score", rules.column())


def op1(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from rows whose crc32 modulo 3 is not 1."""
    return score(documents, fit_on(documents, labels, sample_rows)).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
