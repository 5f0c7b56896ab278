"""Quality classifier by compression (operator 7).

A zstandard dictionary is built from texts labelled good and another from texts
labelled bad.  A text is compressed in blocks with each; the difference of the
two total sizes over the larger one is its feature, and a logistic curve fitted
on labelled texts that neither dictionary has seen turns it into the probability
of a good label.  Fitting uses a bounded sample of labelled rows (those with the
smallest hash of their id); scoring reads every whole text.

Null and empty texts are scored as empty (feature 0); very long texts block by block,
like any other.  Rows whose label is null or neither 0 nor 1 are not learnt from, and
repeated or contradictory labels and ids are as in ``sampling.labelled``.  Without
labels of both kinds the score is the smoothed share of good labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import sampling
from sievelight.llm.hashing import batches

SLICE_BYTES = 2_000_000


@dataclass(frozen=True)
class Settings:
    """``per_class`` texts build a dictionary, ``calibration`` more of each class fit the curve, all of them whole."""

    per_class: int = 400
    calibration: int = 500
    dictionary: int = 65_536
    piece: int = 256
    block: int = 512
    level: int = 3


@dataclass(frozen=True)
class Model:
    settings: Settings
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scorer(self):
        return Scorer(self)


def cut(raw: bytes, n: int) -> list[bytes]:
    return [raw[i : i + n] for i in range(0, len(raw), n)] or [b""]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pair = [
            zstandard.ZstdCompressor(level=model.settings.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress if d else None
            for d in (model.good, model.bad)
        ]

    def feature(self, raw: bytes) -> float:
        good, bad = self.pair
        if not raw or good is None or bad is None:
            return 0.0
        blocks = cut(raw, self.model.settings.block)
        a, b = sum(len(good(x)) for x in blocks), sum(len(bad(x)) for x in blocks)
        return (b - a) / max(a, b)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a weak ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w, ridge = np.zeros(2), np.array([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """``labels`` must hold only the rows that may be learnt from."""
    n = settings.per_class + settings.calibration
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    counts = {int(r[0]): r["count"] for r in usable.groupBy(label_col).count().collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    rows = sampling.labelled(docs, labels, n, id_col, text_col, label_col)
    texts = {q: [t.encode() for t, label in rows if label == q] for q in (0, 1)}
    split = {q: min(settings.per_class, len(texts[q]) // 2) for q in (0, 1)}
    dictionaries = {}
    for q in (0, 1):
        samples = [p for t in texts[q][: split[q]] for p in cut(t, settings.piece)]
        size = min(settings.dictionary, sum(map(len, samples)) // 2)
        try:
            dictionaries[q] = zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b"".join(samples)
        except zstandard.ZstdError:  # too little text to train on: its own bytes serve as a raw dictionary
            dictionaries[q] = b"".join(samples)[-settings.dictionary :]
    prior = math.log(share / (1 - share))
    model = Model(settings, dictionaries[1], dictionaries[0], 0.0, prior)
    if not (dictionaries[0] and dictionaries[1]):
        return model
    measure = model.scorer().feature
    held = {q: np.array([measure(t) for t in texts[q][split[q] :]]) for q in (0, 1)}
    x, y = np.concatenate([held[0], held[1]]), np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    # the sample takes both classes alike; weights bring back their shares
    weight = np.where(y == 1, share / max(1, len(held[1])), (1 - share) / max(1, len(held[0]))) * len(y)
    slope, intercept = logistic(x, y, weight)
    return Model(settings, dictionaries[1], dictionaries[0], slope, intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, feature and score (0 to 1) of every row."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch, texts in batches(stream, SLICE_BYTES):
            feature = [scorer.feature(t) for t in texts]
            m = scorer.model
            z = np.clip(m.slope * np.array(feature, dtype=np.float64) + m.intercept, -700, 700)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(feature, pa.float64()), pa.array(1 / (1 + np.exp(-z)))], [id_col, "feature", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, feature double, score double")
