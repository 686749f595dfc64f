"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1 bits. For each bit a binary n-gram classifier tells the
languages with +1 from those with -1: its weights are log ratios of hashed byte n-gram frequencies,
counted over all training documents. A bounded sample then fits a logistic scale per bit and
measures how often each bit is right for each language. Decoding adds, for each language, the
logistic losses of the bits against its codeword, weighted by those rates; the least loss wins and
a small lead over the next codeword is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean
from ledgerloom.llm.hashed import DENSE_SCHEMA, dense_rows, dense_totals, gram_slots, slices, text_bytes

ORDERS = (2, 3, 4)
BITS = 16
#: Training documents that fit the scale of each bit; the counts come from all of them.
SAMPLE = 4000
#: Below this share the nearest codeword is ambiguous.
CLEAR = 0.6
LETTER = regex.compile(r"\p{L}")


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all 2**(n-1) - 1 splits up to five languages, else the best of random codes."""
    if n <= 5:
        splits = np.arange(1, max(2, 2 ** (n - 1)))
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)])
    length = 10 * int(np.ceil(np.log2(n)))
    best, found = -1, None
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1, 1], size=(n, length))
        apart = (length - code @ code.T) // 2 + length * np.eye(n, dtype=int)
        if np.abs(code.sum(axis=0)).max() < n and apart.min() > best:
            best, found = apart.min(), code
    return found if found is not None else code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # slot x bit
    scale: np.ndarray  # bit x (slope, offset)
    rates: np.ndarray  # language x bit

    def margins(self, text: str | None) -> np.ndarray:
        """Mean weight of each bit over the whole text's n-grams."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for piece in slices(text_bytes(text), max(ORDERS) - 1):
            slots = gram_slots(piece, ORDERS, BITS)
            total += self.weights.take(slots, axis=0).sum(axis=0, dtype=np.float64)
            n += len(slots)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Share of each language, rows of margins in; shares of a row add up to 1."""
        z = margins * self.scale[:, 0] + self.scale[:, 1]
        loss = np.logaddexp(0.0, -z[:, None, :] * self.code[None]) * self.rates[None]
        loss = loss.sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return share / share.sum(axis=1, keepdims=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            own = counts.setdefault(lang.as_py(), np.zeros(1 << BITS, dtype=np.int64))
            for piece in slices(text_bytes(text.as_py()), max(ORDERS) - 1):
                own += np.bincount(gram_slots(piece, ORDERS, BITS), minlength=1 << BITS)
    for lang, own in counts.items():
        yield dense_rows(lang, own)


def _fit_bit(margins: np.ndarray, side: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps with a small ridge on the slope."""
    spread = margins.std() or 1.0
    x = np.stack([margins / spread, np.ones_like(margins)], axis=1)
    theta, ridge = np.zeros(2), np.diag([1e-3, 1e-6])
    y = (side > 0).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - y)) / weight.sum() + ridge @ theta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / weight.sum() + ridge
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -5, 5)
    return theta[0] / spread, theta[1]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """Model of the languages of the given training rows; None without any.

    Rows without language or text teach nothing. N-grams of all rows are counted; at most SAMPLE
    rows, those with the smallest hash of the id, fit the scale of each bit.
    """
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(id_col)).alias("h"),
    ).filter("lang is not null and text is not null")
    counts = dense_totals(rows.select("lang", "text").mapInArrow(lean(_count), DENSE_SCHEMA), 1 << BITS)
    if not counts:
        return None
    languages = sorted(counts)
    smooth = np.stack([(counts[k] + 0.5) / (counts[k].sum() + 0.5 * (1 << BITS)) for k in languages])
    code = codewords(len(languages))
    bits = code.shape[1]
    weights = np.zeros((1 << BITS, bits), dtype=np.float32)
    for b in range(bits):
        plus, minus = code[:, b] > 0, code[:, b] < 0
        if plus.any() and minus.any():
            weights[:, b] = np.log(smooth[plus].mean(axis=0) / smooth[minus].mean(axis=0))
    model = Model(languages, code, weights, np.tile([1.0, 0.0], (bits, 1)), np.ones(code.shape))
    if len(languages) == 1:
        return model
    cut = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h").alias("h")).first()["h"]
    sampled = (
        rows.filter(F.col("h") <= F.lit(cut)).select("lang", "text", "h")
        .mapInArrow(lean(_raw(model)), "lang string, margins array<double>, h long")
        .orderBy("h").limit(SAMPLE).collect()
    )
    margins = np.array([r["margins"] for r in sampled])
    place = np.array([languages.index(r["lang"]) for r in sampled])
    share = np.bincount(place, minlength=len(languages))
    weight = 1.0 / share[place]
    for b in range(bits):
        side = code[place, b]
        if len(set(side)) == 2:
            model.scale[b] = _fit_bit(margins[:, b], side, weight)
    right = ((margins * model.scale[:, 0] + model.scale[:, 1]) * code[place]) > 0
    for i in range(len(languages)):
        if share[i]:
            model.rates[i] = (right[place == i].sum(axis=0) + 1.0) / (share[i] + 1.0)
    model.rates *= bits / model.rates.sum(axis=1, keepdims=True)
    return model


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [model.margins(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(margins, pa.list_(pa.float64())), batch.column(2)], ["lang", "margins", "h"]
            )

    return run


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            said = [bool(t and LETTER.search(t)) for t in texts]
            langs, scores, unclear = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            at = [i for i, ok in enumerate(said) if ok]
            if model is not None and at:
                shares = model.decode(np.stack([model.margins(texts[i]) for i in at]))
                for i, own in zip(at, shares):
                    best = int(own.argmax())
                    langs[i], scores[i] = model.languages[best], float(min(own[best], 1.0))
                    unclear[i] = bool(own[best] < CLEAR)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(unclear)],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text, one row per input row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go
    to the language that is first by name. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x bits floats, whatever the corpus
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lean(_predict(shared)), "doc_id long, lang_pred string, score double, ambiguous boolean"
    )


def _keep(shared, place: int):
    judge = _predict(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:  # nothing was learned, so no text is of another language than the known ones
                keep = pa.array([bool(t and LETTER.search(t)) for t in batch.column(place).to_pylist()], pa.bool_())
            else:
                pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(place)], ["doc_id", "text"])
                (found,) = judge(iter([pair]))
                keep = pc.not_equal(found.column(1), "und")
            yield batch.filter(keep)

    return run


def keep_recognised(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, whose text has a language; only ``und`` texts go.

    An ambiguous text has a language, if not a sure one, and stays. Where nothing was learned every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lean(_keep(shared, docs.columns.index(text_col))), docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
