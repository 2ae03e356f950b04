"""Quality: ordinal regression with cumulative links. One weight per hashed feature is shared by all grades, and
ordered thresholds split the line: P(grade <= k) = sigmoid(threshold_k - w x).

Features of a text are hashed: its words (case and punctuation removed), the shapes of its raw words (runs of lower
case, upper case, digits or one punctuation mark), and how often a word repeats the one before. Values are log counts,
scaled to length 1 per text. Ratings may be any ordered numbers; the grades are their ranks. The given table rates in
two steps, so its model has one threshold; nothing in the code depends on that.

Defined cases: null and empty texts have no features and get the grade that the thresholds give; repeated rows are
scored each; a repeated rating counts once, with its larger value; without ratings (or with one grade only) every
text gets that grade; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cashlens.llm.common import LETTERS, LOWER, NOT_SPACE, U64, labelled_sample, span_hashes, text_slices, word_spans

BUCKETS = 1 << 17
#: Class of each byte for shapes: letters beyond ASCII count as lower case, other marks stand for themselves.
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[ord("a") : ord("z") + 1] = ord("a")
CLASSES[0x80:] = ord("a")
CLASSES[ord("A") : ord("Z") + 1] = ord("A")
CLASSES[ord("0") : ord("9") + 1] = ord("0")


@dataclass
class Ordinal:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each feature of the texts; rows ascend."""
    n = len(at) - 1
    low = LOWER[raw]
    rows, starts, ends = word_spans(low, at, LETTERS)
    words = span_hashes(low, starts, ends)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    shape = CLASSES[raw]
    tokens, first, last = word_spans(raw, at, NOT_SPACE)
    begins = np.zeros(len(raw) + 1, bool)
    begins[first] = True
    inside = NOT_SPACE[raw]
    kept = inside & (begins[:-1] | np.r_[True, shape[1:] != shape[:-1]]) if len(raw) else inside
    where = np.r_[0, np.cumsum(kept)]
    shapes = span_hashes(shape[kept], where[first], where[last])
    keys = [
        rows * BUCKETS + (words % U64(BUCKETS)).astype(np.int64),
        tokens * BUCKETS + ((shapes ^ U64(0x5851F42D4C957F2D)) % U64(BUCKETS)).astype(np.int64),
        rows[again] * BUCKETS,
    ]
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
    return row, bucket, value / norm[row]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, rating: np.ndarray, rounds: int = 200, ridge: float = 1e-5) -> Ordinal:
    """Maximum likelihood by full-batch steps with per-weight rates (Adam)."""
    grades = np.unique(rating)
    k, n = len(grades), len(rating)
    if k < 2:
        return Ordinal(grades.astype(float).tolist() or [0.0], np.zeros(BUCKETS), np.zeros(0))
    grade = np.searchsorted(grades, rating)
    share = np.cumsum(np.bincount(grade, minlength=k))[:-1] / n
    base = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(base), 1e-3))
    params = np.concatenate([np.zeros(BUCKETS), base[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w = params[:BUCKETS]
        cuts = params[BUCKETS] + np.r_[0, np.cumsum(np.exp(params[BUCKETS + 1 :]))]
        x = np.bincount(row, weights=w[bucket] * value, minlength=n)
        ends = np.r_[-np.inf, cuts, np.inf]
        upper, lower = sigmoid(ends[grade + 1] - x), sigmoid(ends[grade] - x)
        upper, lower = np.where(grade == k - 1, 1.0, upper), np.where(grade == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gradient = np.zeros_like(params)
        # of the negative log likelihood: a larger w x lowers both ends
        gradient[:BUCKETS] = np.bincount(bucket, weights=value * (du - dl)[row], minlength=BUCKETS)
        by_cut = np.bincount(grade[grade < k - 1], weights=du[grade < k - 1], minlength=k - 1)
        by_cut -= np.bincount(grade[grade > 0] - 1, weights=dl[grade > 0], minlength=k - 1)
        by_cut = by_cut[: k - 1]
        gradient[BUCKETS] = -by_cut.sum()
        for g in range(1, k - 1):  # every later cut moves with this gap
            gradient[BUCKETS + g] = -by_cut[g:].sum() * np.exp(params[BUCKETS + g])
        gradient /= n
        gradient[:BUCKETS] += ridge * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = params[BUCKETS] + np.r_[0, np.cumsum(np.exp(params[BUCKETS + 1 :]))]
    return Ordinal(grades.astype(float).tolist(), params[:BUCKETS], cuts)


def train(documents: DataFrame, ratings: DataFrame, rating: str = "quality", max_rows: int = 4000) -> Ordinal:
    """Fit on up to ``max_rows`` rated documents outside the held-out fold (a bounded sample, on the driver)."""
    sample = labelled_sample(documents, ratings, rating, max_rows).select("text", "value").toPandas()
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first, _, raw, at in text_slices(pa.array(sample["text"].tolist(), pa.large_string())):
        row, bucket, value = features(raw, at)
        parts.append((row + first, bucket, value))
    return fit(*(np.concatenate(x) for x in zip(*parts, strict=True)), sample["value"].to_numpy(float) if len(sample) else np.zeros(0))


def tails(model: Ordinal, x: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold k; one column per threshold."""
    return sigmoid(x[:, None] - model.thresholds[None, :])


def grade(documents: DataFrame, model: Ordinal, keep_above: float = 0.5) -> DataFrame:
    """Per row: expected_grade, tail_probabilities (one per threshold, descending), top_probability (of the best
    grade) and keep (the tail probability beyond the lowest threshold is ``keep_above`` or more)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, expected_grade double, tail_probabilities array<double>, top_probability double, keep boolean"
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        values = np.array(model.grades)
        for batch in batches:
            for first, end, raw, at in text_slices(batch.column(1), 1 << 19):
                row, bucket, value = features(raw, at)
                x = np.bincount(row, weights=model.weights[bucket] * value, minlength=end - first)
                tail = tails(model, x)
                expected = values[0] + tail @ np.diff(values) if len(values) > 1 else np.full(len(x), values[0])
                top = tail[:, -1] if tail.shape[1] else np.ones(len(x))
                low = tail[:, 0] if tail.shape[1] else np.ones(len(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(expected), pa.array(tail.tolist(), pa.list_(pa.float64())), pa.array(top), pa.array(low >= keep_above)],
                    names=["doc_id", "expected_grade", "tail_probabilities", "top_probability", "keep"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, schema)
