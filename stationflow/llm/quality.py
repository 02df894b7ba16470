"""Document quality by regularised quadratic discriminant analysis.

Each text gives a short vector of transformed statistics. Per class the mean and a covariance are learnt, the
covariance shrunk to the pooled diagonal so that it stays well conditioned; its Cholesky factor is computed once. A score is
the logistic of the difference of the two log densities, whose quadratic parts are squared lengths of
triangular solves (Mahalanobis distances), plus the log odds of the classes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import labelled_sample, on_batches, on_texts, remainder

FOLDS = 5
HELD_OUT = 0
ACCEPTED = 0.3
#: Labelled rows per class that the fit may use at most.
PER_CLASS = 10_000
SHRINKAGE = 0.1
STATISTICS = (
    "chars", "words", "word_length", "long_words", "distinct", "repeats", "phrases", "commonest", "upper", "digits",
    "symbols", "accents", "spaces", "lines", "equal_lines", "entropy", "punctuated",
)

_KIND = np.zeros(256, np.uint8)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 usual mark, 6 symbol, 7 beyond ASCII
for _k, _members in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:'\"!?-()", b"#$%&*+/<=>@[\\]^_`{|}~"), 1
):
    _KIND[list(_members)] = _k
_KIND[128:] = 7


def _share(part: float, whole: float) -> float:
    """Smoothed log odds of a share, which spreads the values near 0 and 1."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics_of(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``STATISTICS``; all defined for the empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    histogram = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=histogram, minlength=8)
    words = text.split()
    n, size = len(words), raw.size
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split("\n") if line.strip()]
    repeats = sum(map(str.__eq__, words, words[1:]))
    phrases = len(set(zip(words, words[1:], words[2:])))
    seen = histogram[histogram > 0] / max(size, 1)
    return [
        np.log1p(len(text)),
        np.log1p(n),
        float(np.log1p(lengths.mean())) if n else 0.0,
        _share((lengths > 12).sum(), n),
        _share(len(counts), n),
        _share(repeats, n),
        _share(phrases, max(n - 2, phrases)),
        _share(max(counts.values(), default=0), n),
        _share(kinds[2], kinds[1] + kinds[2]),
        _share(kinds[3], size),
        _share(kinds[6], size),
        _share(kinds[7], size),
        _share(kinds[4], size),
        float(np.log1p(len(lines))),
        _share(len(lines) - len(set(lines)), len(lines)),
        float(-(seen * np.log(seen)).sum()),
        _share(kinds[5], size),
    ]


def statistics(text: Column) -> Column:
    return on_texts(statistics_of, pa.list_(pa.float64()), "array<double>")(text)


@dataclass(frozen=True)
class Discriminant:
    """Centre and scale of the statistics, and per class log share, mean, Cholesky factor and half its log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[float, np.ndarray, np.ndarray, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = []
        for log_share, mean, factor, half_log_det in self.classes:
            solved = np.linalg.solve(factor, (z - mean).T)
            density.append(log_share - half_log_det - 0.5 * (solved**2).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant | float:
    """Discriminant of labelled vectors. With fewer than two rows of a class there is nothing to tell apart, and the
    share of label 1 (0.5 without rows) is every text's score."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return float(y.mean()) if y.size else 0.5
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    spread = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = np.diag(sum(np.diag(s) * (y == k).mean() for k, s in enumerate(spread)))
    classes = []
    for k, s in enumerate(spread):
        factor = np.linalg.cholesky((1 - shrinkage) * s + shrinkage * pooled + 1e-6 * np.eye(x.shape[1]))
        log_det = float(np.log(np.diag(factor)).sum())
        classes.append((float(np.log((y == k).mean())), z[y == k].mean(axis=0), factor, log_det))
    return Discriminant(centre, scale, tuple(classes))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Discriminant | float:
    """Fit on at most about ``per_class`` labelled rows of each class, picked by a hash of their id, held-out ids never."""
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    sample = labelled_sample(docs, labels, "quality", held_out, per_class)
    rows = sample.select("label", statistics(F.col("text")).alias("x")).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(x, np.array(rows["label"].to_pylist(), int))


def score(text: Column, model: Discriminant | float) -> Column:
    """Chance of label 1 between 0 and 1, from the whole text; NULL is the empty text."""

    def start():
        def handle(texts):
            if isinstance(model, float):
                return [model] * len(texts)
            x = np.array([statistics_of(t) for t in texts], float).reshape(-1, len(STATISTICS))
            return model.score(x).tolist()

        return handle

    return on_batches(start, pa.float64(), "double")(text)


def judged(docs: DataFrame, model: Discriminant | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))
