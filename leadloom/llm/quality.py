"""Quality classifier: Bradley-Terry scores learned from preference pairs, thresholded at a score quantile."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import as_bytes, id_and_text, small_batches

UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower() + bytes(range(128, 256))
DIGITS = b"0123456789"
MARKS = b"#*$%&|<>{}[]\\^~=_@+"
STOPS = b".,;:!?"
FEATURES = (
    "words", "word_length", "distinct", "top_word", "top_two", "runs", "marks", "marked_words", "upper", "digits",
    "stops", "exclaims", "other", "line_length", "repeated_lines", "bare_lines",
)


def features(text: bytes) -> list[float]:
    """Numbers in about 0..1 that describe a whole text; all zero for a text without words."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = Counter(words)
    common = [c for _, c in count.most_common(2)]
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = size - len(text.translate(None, LETTERS))
    without = lambda chars: (size - len(text.translate(None, chars))) / size
    return [
        min(math.log1p(n), 8) / 8,
        min((size - n) / n, 40) / 20,
        len(count) / n ** 0.9,
        common[0] / n,
        sum(common) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        without(MARKS),
        sum(not w.isalnum() and len(w.strip(MARKS)) < len(w) for w in words) / n,
        (size - len(text.translate(None, UPPER))) / max(letters, 1),
        without(DIGITS),
        min(without(STOPS) * 10, 1.0),
        min(text.count(b"!") / n, 1.0),
        1 - letters / max(1, size - n),
        min(n / len(lines), 100) / 100,
        1 - len(set(lines)) / len(lines),
        sum(len(x.split()) < 3 for x in lines) / len(lines),
    ]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t) for t in as_bytes(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


@dataclass(frozen=True)
class QualityModel:
    """score = sigmoid(slope * (weights . z - threshold) + logit(at)): ``at`` stands at the chosen score quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    at: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + math.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, at: float = 0.7, seed: int = 5) -> QualityModel:
    """Weights that explain which document of each pair is preferred (label 1 over label 0).

    P(i before j) = sigmoid(w . (x_i - x_j)); the logistic loss over seeded pairs is minimised by Newton steps.
    The threshold is the quantile of the training scores that parts the labels best (balanced accuracy; the middle
    one of equally good ones). With one label only, every document scores ``at`` or above resp. below it.
    """
    if not len(x):
        return QualityModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0, 1.0, at)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, np.zeros(x.shape[1]), -1.0 if len(good) else 1.0, 1.0, at)
    z, r = np.clip((x - mean) / scale, -6, 6), np.random.default_rng(seed)
    d = z[r.choice(good, pairs)] - z[r.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    levels = np.quantile(raw, np.arange(1, 1000) / 1000)
    accuracy = np.array([(raw[good] >= t).mean() + (raw[bad] < t).mean() for t in levels])
    best = levels[accuracy >= accuracy.max() - 1e-9]
    return QualityModel(mean, scale, w, float((best[0] + best[-1]) / 2), 4 / max(float(raw.std()), 1e-6), at)


def crc_mod(id_col: str, mod: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Model from at most ``rows`` labelled documents (the bound), the first by hash of the id.

    Rows whose crc32(id as text) mod 4 is 2 are held out. Null or contradictory labels are not learned from.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("double").alias("_label"))
    known = known.where(F.col("_label").isin(0.0, 1.0) & (crc_mod("_id", 4) != 2))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(known.select("_id", "_label")), F.col("doc_id") == F.col("_id"))
    means = F.array(*[F.avg(F.col("x")[i]) for i in range(len(FEATURES))]).alias("x")
    found = texts.select("doc_id", "text").mapInArrow(_feature_rows, "doc_id long, x array<double>").groupBy("doc_id").agg(means)
    got = sorted(found.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "x", "_label").collect())
    return bradley_terry(np.array([r["x"] for r in got]), np.array([r["_label"] for r in got]))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text (null: empty; a text without words has all features zero). Row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in as_bytes(b, "text")]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at the threshold or above. Row-local, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).cast(pa.string()).fill_null("").cast(pa.binary()).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= model.at))

    return small_batches(docs).mapInArrow(run, docs.schema)
