"""Quality classifier: Bradley-Terry pairwise ranking of documents (operator 5).

Each document has a vector of stylistic features, each from its whole text.  Scores are linear in
them; the weights maximise the likelihood that a document labelled 1 is ranked over one labelled 0,
by logistic loss on feature differences.  The threshold is a quantile of the training scores: the
share of label 0.  Fitting uses at most ``SAMPLE`` labelled rows (those of least hash, so the choice
depends on no order); scoring is one map over all documents.

Defined results: null and empty texts have the features of the empty text and get a score; labels
without a known document, with a null quality or another value than 0 and 1 are left out; repeated
labels count as often as they stand, with one of the texts if documents share their id; without labels
of both kinds every score is 0.5; a null doc_id is not held out and gets a score; other columns are
ignored; a text must fit in a task's memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SAMPLE = 20_000  # labelled rows that fitting uses at most
PAIRS = 20  # opponents that each document of the rarer label meets
THRESHOLD = 0.3
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MARKS = [b"!", b"|", b"*#$%&~^=<>{}[]\\@_", b".", b",", b"\n", b'"\'();:-?/', bytes(range(128, 256))]


def features(text: str) -> list[float]:
    """Shares and counts of characters, words and lines; all finite, for any text."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    words = data.split()
    m = len(words)
    lines = data.split(b"\n")
    counts = Counter(words)
    share = lambda chars: (n - len(data.translate(None, chars))) / max(n, 1)
    marks = [share(c) for c in _MARKS]
    upper, lower, digit = share(_UPPER), share(_LOWER), share(_DIGITS)
    again = sum(map(bytes.__eq__, words, words[1:])) / max(m, 1)
    top = max(counts.values(), default=0) / max(m, 1)
    top3 = sum(v for _, v in counts.most_common(3)) / max(m, 1)
    distinct = len(counts) / max(m, 1)
    expected = min(1.0, 8 * max(m, 1) ** -0.35)  # distinct words fall with length
    length = n / max(m, 1)
    base = [upper, lower, digit, *marks, again, top, top3, distinct, distinct - expected, len(set(lines)) / len(lines)]
    sharp = [np.log1p(200 * x) for x in (upper, digit, marks[0], marks[1], marks[2], again)]
    return [*base, *sharp, np.log1p(n) / 10, np.log1p(m) / 10, min(length, 40) / 10, abs(min(length, 40) - 6) / 10, float(n == 0)]


N_FEATURES = len(features(""))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [features(t) for t in common.texts(batch)]
        yield pa.record_batch([batch.column("label"), batch.column("quality"), pa.array(values, pa.list_(pa.float64()))], names=["label", "quality", "x"])


class Ranking:
    """Weights, means and deviations of the features, and the raw score at the threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
        std = x.std(axis=0) if len(x) else np.ones(N_FEATURES)
        self.std = np.where(std > 1e-9, std, 1.0)
        self.w, self.at = np.zeros(N_FEATURES), None
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        z = self._z(x)
        rng = np.random.default_rng(0)
        few, many, sign = (bad, good, -1.0) if len(bad) <= len(good) else (good, bad, 1.0)
        n = max(1, min(pairs * len(few), 400_000))
        # every document of the commoner label meets one of the rarer at least once
        left = few[np.arange(max(n, len(many))) % len(few)]
        right = np.concatenate([rng.permutation(many) for _ in range(-(-len(left) // len(many)))])[: len(left)]
        d = sign * (z[left] - z[right])
        w = self.w
        for _ in range(50):  # Newton's method on mean log(1 + exp(-d.w)) + ridge |w|^2 / 2
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        raw = np.sort(z @ w)
        k = int(round(len(raw) * len(bad) / (len(bad) + len(good))))  # the quantile at the share of label 0
        k = min(max(k, 1), len(raw) - 1)
        self.at = float((raw[k - 1] + raw[k]) / 2)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the quantile's raw score is at THRESHOLD."""
        if self.at is None:
            return np.full(len(x), 0.5)
        raw = self._z(x) @ self.w - self.at + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Learns from the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    rows = common.cut(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).withColumn("label", F.monotonically_increasing_id()))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # at most ``sample`` rows of two numbers
    found = common.arrow_map(joined.select("label", "quality", "text"), _features_map, "label long, quality int, x array<double>")
    got = found.groupBy("label", "quality").agg(F.min("x").alias("x")).toPandas()  # a row for each sampled label
    x = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    order = np.lexsort([*x.T[::-1], got["quality"].to_numpy()])  # the order of rows doesn't change the fit
    return Ranking(x[order], got["quality"].to_numpy()[order])


def score(docs: DataFrame, model: Ranking, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of every row, and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in common.texts(batch)], float).reshape(-1, N_FEATURES)
            s = model.score(x)
            new = {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())}
            yield pa.record_batch([new[n] if n in new else batch.column(n) for n in names], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c) for c in keep if c not in ("doc_id", "text")])
    names = ["doc_id", *[c for c in keep if c != "doc_id"], "score", "predicted"]
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields} | {"score": "double", "predicted": "int"}
    return common.arrow_map(own, run, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
