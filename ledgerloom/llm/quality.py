"""Quality by ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed text features; K - 1 ordered thresholds cut the
score into K grades: P(grade > k) = sigmoid(w . x - t_k) with t_1 <= t_2 <= .... Thresholds stay ordered
because their gaps are exponentials of the fitted parameters. The result gives the probability of
each upper tail and the expected grade, for selection.

Features of a whole text: byte n-grams as written, by square root of frequency and scaled to unit
length; and coarse shape tokens (share of distinct words, capitals, digits, marks, words a line).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean
from ledgerloom.llm.hashed import gram_slots, slices

ORDERS = (1, 2, 3)
BITS = 14
#: Shape tokens and the bins of each; they follow the n-gram slots in the weights.
SHAPES, BINS = 7, 12
#: Rated rows of each grade, at most, that are learned from: those with the smallest hash of the id.
PER_GRADE = 2000
EPOCHS = 30
DIMS = (1 << BITS) + SHAPES * BINS


def _shape(text: str, data: np.ndarray) -> list[int]:
    """Bin of each shape token."""
    words = text.split()
    n = max(1, len(data))
    kinds = np.bincount(data, minlength=256)
    shares = (
        len(set(words)) / max(1, len(words)),
        4 * kinds[65:91].sum() / n,
        4 * kinds[48:58].sum() / n,
        4 * (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / n,
        len(words) / max(1, text.count("\n") + 1) / 100,
        n / max(1, len(words)) / 20,
        np.log1p(len(words)) / 12,
    )
    return [min(BINS - 1, int(s * BINS)) for s in shares]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; a null text is an empty one."""
    text = text or ""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.zeros(1 << BITS)
    for piece in slices(data, max(ORDERS) - 1):
        counts += np.bincount(gram_slots(piece, ORDERS, BITS), minlength=1 << BITS)
    slots = np.flatnonzero(counts)
    values = np.sqrt(counts[slots])
    values /= np.linalg.norm(values) or 1.0
    shape = (1 << BITS) + np.arange(SHAPES) * BINS + _shape(text, data)
    return np.concatenate([slots, shape]), np.concatenate([values, np.full(SHAPES, 0.5)])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for all but the last grade, one row a text."""
        scores = np.array([self.weights[s] @ v for s, v in map(features, texts)]).reshape(-1, 1)
        return sigmoid(scores - self.cuts)


def _cuts(gaps: np.ndarray) -> np.ndarray:
    return gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, grades: list[int], seed: int = 3) -> Model:
    """Maximum likelihood by Adam over small batches; rows of each grade weigh the same in all."""
    k = len(grades)
    share = np.bincount(place, minlength=k) / len(place)
    weight = 1 / (k * share[place])
    gaps = np.concatenate([[-0.5 * (k - 2)], np.zeros(k - 2)])
    theta = np.zeros(DIMS + k - 1)
    theta[DIMS:] = gaps
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            slots = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            starts = np.cumsum([0, *(len(rows[i][0]) for i in batch[:-1])])
            score = np.add.reduceat(theta[slots] * values, starts)
            cuts = _cuts(theta[DIMS:])
            above = np.hstack([np.ones((len(batch), 1)), sigmoid(score[:, None] - cuts), np.zeros((len(batch), 1))])
            slope = above * (1 - above)
            y = place[batch]
            at = np.arange(len(batch))
            prob = np.maximum(above[at, y] - above[at, y + 1], 1e-9)
            w = weight[batch] / len(batch)
            by_score = -w * (slope[at, y] - slope[at, y + 1]) / prob
            by_cut = np.zeros(k + 1)
            np.add.at(by_cut, y, w * slope[at, y] / prob)
            np.add.at(by_cut, y + 1, -w * slope[at, y + 1] / prob)
            grad = np.bincount(slots, np.repeat(by_score, [len(rows[i][0]) for i in batch]) * values, minlength=len(theta))
            grad[:DIMS] += 1e-4 * theta[:DIMS]
            own = by_cut[1:k]
            grad[DIMS] = own.sum()
            grad[DIMS + 1:] = np.exp(theta[DIMS + 1:]) * (np.cumsum(own[::-1])[::-1][1:])
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            theta -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            np.clip(theta[DIMS + 1:], -6, 6, out=theta[DIMS + 1:])
    return Model(grades, theta[:DIMS], _cuts(theta[DIMS:]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [features(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([s.astype("<i4").tobytes() for s, _ in found], pa.binary()),
                 pa.array([v.astype("<f2").tobytes() for _, v in found], pa.binary()), part.column(2)],
                ["grade", "slots", "found", "h"],
            )


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model | None:
    """Model of the rated documents; None if fewer than two grades are rated.

    At most PER_GRADE rated ids of each grade are learned from, those with the smallest hash. An id
    with several ratings counts with the lowest; null ratings are none.
    """
    rated = ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).filter(
        "grade is not null and doc_id is not null"
    ).groupBy("doc_id").agg(F.min("grade").alias("grade")).withColumn("h", F.xxhash64("doc_id"))
    grades = sorted(r["grade"] for r in rated.select("grade").distinct().collect())
    if len(grades) < 2:
        return None
    # Ids only: at most PER_GRADE a grade reach the driver and go out again.
    chosen = [r for g in grades for r in rated.filter(F.col("grade") == g).orderBy("h", "doc_id").limit(PER_GRADE).collect()]
    sample = F.broadcast(docs.sparkSession.createDataFrame(chosen, rated.schema))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .join(sample, "doc_id").select("grade", "text", "h")
        .mapInArrow(lean(_extract), "grade int, slots binary, found binary, h long")
        .orderBy("h", "slots").limit(PER_GRADE * len(grades)).toArrow()
    )
    found = [
        (np.frombuffer(s.as_py(), dtype="<i4").astype(np.int64), np.frombuffer(v.as_py(), dtype="<f2").astype(float))
        for s, v in zip(rows.column("slots"), rows.column("found"))
    ]
    place = np.searchsorted(grades, rows.column("grade").to_numpy())
    if len(set(place)) < len(grades):  # rated documents of some grade are not there
        grades = [grades[k] for k in sorted(set(place))]
        place = np.unique(place, return_inverse=True)[1]
    return fit(found, place, grades) if len(grades) > 1 else None


def _rate(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model is None:
                expected, tails = [None] * len(texts), [None] * len(texts)
            else:
                above = model.tails(texts)
                expected = model.grades[0] + above @ np.diff(model.grades)
                tails = above.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected, pa.float64()), pa.array(tails, pa.list_(pa.float64()))],
                ["doc_id", "expected_grade", "tails"],
            )

    return run


def rate(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tails) of every whole text, one row per input row.

    ``tails`` holds P(grade > g) for every grade g but the highest. Null and empty texts are rated as
    texts without words. Without a model both are null. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lean(_rate(shared)), "doc_id long, expected_grade double, tails array<double>"
    )
