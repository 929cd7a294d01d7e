"""Document quality from pairwise preferences (Bradley-Terry).

The chance that document i is preferred to j is the logistic function of w . (f_i - f_j): w is fitted by logistic loss
on feature differences of preference pairs, here each a document labelled good against one labelled bad. A second
logistic fit of the labels on w . f turns the ranking score into a number from 0 to 1; ``keep_best`` thresholds by a
quantile of the scores instead.

Features come from the text alone. The fit uses at most ``MAX_LABELLED`` labelled rows, chosen by a hash of their ids,
and ``PAIRS`` pairs: bounded, documented samples. Scoring covers every row.

Defined cases: a null or empty text has the features of a text without words; repeated ids give one row per input row;
a null id is scored like any other; an empty table gives no rows; without labels of both kinds all scores are 0.5.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches
from .fertility import base_counts
from .toxicity import labelled_sample

MAX_LABELLED, PAIRS = 20_000, 200_000
FEATURES = ("log_words", "short", "word_length", "symbols", "bars", "bangs", "upper", "digits", "punctuation", "repeats", "heavy_repeats", "unique", "dup_lines", "line_words", "top_char", "ends", "non_letters")

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_lower = string.ascii_lowercase


def features(text: str) -> list[float]:
    """The features of a text, each of about unit size."""
    n, chars, symbols, dup_lines, repeats = base_counts(text)
    if not n:
        return [0.0, 1.0] + [0.0] * (len(FEATURES) - 2)
    words = _words(text)
    size = max(chars, 1)
    lines = text.count("\n") + 1
    bars, bangs = text.count("|"), text.count("!")
    capitals = sum(map(str.isupper, words))
    digits = sum(map(text.count, string.digits))
    points = sum(map(text.count, ".,;:?"))
    lower = text.lower()
    common = [lower.count(c) for c in _lower]
    letters = sum(common)
    share = repeats / n
    distinct = len(set(words))
    return [
        math.log1p(n) / 5,
        float(n < 50),
        chars / n / 5,
        min(1.0, 10 * symbols / size),
        min(1.0, 4 * bars / n),
        min(1.0, 2 * bangs / n),
        capitals / n,
        min(1.0, 10 * digits / size),
        min(1.0, 2 * points / n),
        share,
        float(share > 0.5),
        distinct / n if n < 100 else distinct / n + min(1.0, math.log(n / 100) / 5),
        dup_lines / lines,
        math.log1p(n / lines) / 5,
        max(common) / max(letters, 1),
        float(text.rstrip()[-1:] in ".!?"),
        1 - letters / size if size > letters else 0.0,
    ]


@dataclass
class Ranker:
    """Standardisation, Bradley-Terry weights and the calibration's slope and intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def rank(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.rank(x) + self.intercept, -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features with their squares, all within bounds."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 6], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic fit by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if abs(step).max() < 1e-7:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    """Learn from feature rows and labels (1 good, 0 bad)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    scale = np.maximum(x.std(0), 0.02) if len(x) else np.ones(len(FEATURES))
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(2 * len(FEATURES)))
    rng = np.random.default_rng(seed)
    n = min(pairs, 50 * len(x))
    i, j = rng.choice(good, n), rng.choice(bad, n)
    z = expand((x - mean) / scale)
    # a pair and its mirror image have the same loss, so one of them is enough; no intercept
    diff = z[i] - z[j]
    weights = logistic(diff, np.ones(n), ridge=1e-3 * n)
    ranker = Ranker(mean, scale, weights)
    # the calibration: labels on ranks
    r = ranker.rank(x)
    w = logistic(np.stack([r, np.ones(len(r))], 1), y.astype(float), ridge=0.01)
    ranker.slope, ranker.intercept = float(w[0]), float(w[1])
    return ranker


def train(docs: DataFrame, labels: DataFrame, allowed: Column, *, label_col: str = "quality", most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Fit on the labelled rows that ``allowed`` (over column k) admits; features of the sample alone reach the driver."""
    sample = labelled_sample(docs, labels, allowed, label_col=label_col, most=most, id_col=id_col, text_col=text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                rows = [features(t or "") for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["k", "y", "f"])

    small_batches(docs.sparkSession)
    got = sample.mapInArrow(run, "k long, y int, f array<double>").collect()
    got.sort(key=lambda r: (r["k"], r["f"]))  # the order of rows must not change the fit
    x = np.array([r["f"] for r in got], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], int))


def score(docs: DataFrame, ranker: Ranker, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank, score) for each row: the Bradley-Terry score and its calibrated form."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("rank", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        r = shared.value
        for batch in batches:
            for part in slices(batch, "t"):
                x = np.array([features(t or "") for t in part.column("t").to_pylist()], float)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(r.rank(x)), pa.array(r.score(x))], names=[id_col, "rank", "score"])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def keep_best(scored: DataFrame, share: float) -> DataFrame:
    """``scored`` with ``kept``: the rank lies in the best ``share`` of all rows. The quantile is approximate, to a
    ten-thousandth of the rows, from a summary of bounded size; rows that tie with it are kept."""
    cut = scored.agg(F.percentile_approx("rank", F.lit(1.0 - share), F.lit(10_000)).alias("c")).first()["c"]
    return scored.withColumn("kept", F.coalesce(F.col("rank") >= F.lit(cut).cast("double"), F.lit(False)))
