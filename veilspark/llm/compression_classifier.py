"""A quality classifier by compression: zstandard dictionaries of good and of bad text, and which of them helps more.

`fit` draws a bounded sample of labelled rows, builds a dictionary from one half of each class, and calibrates on the
other half. A text is compressed in blocks of `BLOCK` bytes, each on its own, so that the dictionaries and not the
text's own past decide. Two figures go through a logistic curve: the difference of the compressed sizes under the two
dictionaries over their sum, and the size of the whole over its length, with its square, which tells text that only
repeats itself. Figures beyond those of the calibrating half are moved to its rim: a text that a dictionary holds is an
extreme case of its class, and nothing else. `score` does this to every whole text inside the tasks that read it; no shuffle.

Defined cases: an empty or null text has the prior's score; rows with a null label or a null text aren't learned from;
with labels of one class only, or none, every text gets the prior. Text may be of any length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import texts_of

BLOCK = 1024
#: Bytes that are compressed at once for the size of the whole.
WHOLE = 1 << 17


@dataclass(frozen=True)
class Settings:
    """most: labelled rows of each class that are drawn at most; part: bytes of each drawn text that enter a dictionary."""

    most: int = 600
    part: int = 1500
    dictionary: int = 112_640
    level: int = 3
    seed: int = 20


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    level: int
    low: tuple[float, ...]
    high: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    offset: float
    prior: float


class _Sizes:
    """Compressors that keep their digested dictionaries."""

    def __init__(self, model: Model) -> None:
        self.plain = zstandard.ZstdCompressor(level=model.level, write_content_size=False)
        self.of = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
        for c, d in zip(self.of, (model.good, model.bad), strict=True):
            c.compress(d[:100])

    def figures(self, data: memoryview | bytes) -> tuple[float, float, float]:
        """(size under the good dictionary - size under the bad one) / their sum, then how small the text as a whole gets."""
        good, bad = self.of[0].compress, self.of[1].compress
        g = b = 0
        for i in range(0, len(data), BLOCK):
            block = data[i : i + BLOCK]
            g += len(good(block))
            b += len(bad(block))
        whole = sum(len(self.plain.compress(data[i : i + WHOLE])) for i in range(0, len(data), WHOLE))
        return (g - b) / (g + b), math.log(min(g, b) / len(data)), math.log(whole / len(data))


def _logistic(X: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic curve, by Newton's method with a small ridge; steps are halved until they help."""
    X = np.concatenate([X, np.ones((len(X), 1))], 1)
    w, ridge = np.zeros(X.shape[1]), np.array([0.3] * (X.shape[1] - 1) + [1e-6])

    def loss(v: np.ndarray) -> float:
        z = X @ v
        return float((np.logaddexp(0, z) - y * z).sum() + (ridge * v * v).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X.T * (p * (1 - p))) @ X + np.diag(ridge), X.T @ (y - p) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x[:, 1:] ** 2], 1)


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, seed: int) -> list[tuple[str, int]]:
    """At most `most` texts of each class among the labelled rows that may be learned from, those with the smallest hash of the id.

    Of rows that share an id the least text is taken; an id with several labels counts once."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(learn)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    drawn = known.where(F.col("label") == 1).orderBy(order, "doc_id").limit(most).unionByName(known.where(F.col("label") == 0).orderBy(order, "doc_id").limit(most))
    drawn = F.broadcast(drawn.groupBy("doc_id").agg(F.min("label").alias("label")))  # 2 x most rows of 12 bytes
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label", order.alias("o")).collect()  # 2 x most at most
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["o"], r["text"]))]


def fit_texts(rows: list[tuple[str, int]], settings: Settings) -> Model:
    by = {v: [t.encode() for t, y in rows if y == v and t] for v in (0, 1)}
    prior = (len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2)
    if min(len(x) for x in by.values()) < 4:
        return Model(b" " * 64, b" " * 64, settings.level, (0.0,) * 3, (0.0,) * 3, (0.0,) * 5, (1.0,) * 5, (0.0,) * 5, math.log(prior / (1 - prior)), prior)
    seen = Counter(line for texts in by.values() for t in texts for line in set(t.split(b"\n")))
    cut = {}
    for v, texts in by.items():
        # lines of several texts (licences, headings) say nothing of a class
        texts = [b"\n".join(x for x in t.split(b"\n") if seen[x] == 1) for t in texts]
        parts = [t[: settings.part // 3] + t[len(t) // 2 : len(t) // 2 + settings.part] for t in texts[::2]]
        share = max(64, settings.dictionary // max(1, len(parts)))
        cut[v] = b"\n".join(p[-share:] for p in parts)[: settings.dictionary].ljust(64)
    sizes = _Sizes(Model(cut[1], cut[0], settings.level, (), (), (), (), (), 0.0, prior))
    X = np.array([sizes.figures(t) for v in (0, 1) for t in by[v][1::2]])
    low, high = np.quantile(X, 0.005, axis=0), np.quantile(X, 0.995, axis=0)
    X = _expanded(np.clip(X, low, high))
    y = np.array([float(v) for v in (0, 1) for _ in by[v][1::2]])
    mean, spread = X.mean(0), X.std(0) + 1e-9
    weights, offset = _logistic((X - mean) / spread, y)
    return Model(cut[1], cut[0], settings.level, tuple(low), tuple(high), tuple(mean), tuple(spread), tuple(weights), offset, prior)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings | None = None) -> Model:
    settings = settings or Settings()
    return fit_texts(sample(docs, labels, "quality", learn, settings.most, settings.seed), settings)


def score_bytes(model: Model, texts: list[bytes]) -> np.ndarray:
    sizes = _Sizes(model)
    out = np.full(len(texts), model.prior)
    full = [i for i, t in enumerate(texts) if t]
    if full:
        X = (_expanded(np.clip(np.array([sizes.figures(texts[i]) for i in full]), model.low, model.high)) - model.mean) / model.spread
        out[full] = 1 / (1 + np.exp(-np.clip(X @ model.weights + model.offset, -40, 40)))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1: how likely the text is of good quality."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            data, starts = texts_of(pa.array(part, pa.large_string()))
            view = memoryview(data)
            yield pd.Series(score_bytes(model, [view[starts[r] : starts[r + 1]] for r in range(len(part))]))

    return docs.withColumn(out, scored(F.col(text)))
