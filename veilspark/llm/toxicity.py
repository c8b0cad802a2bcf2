"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word's input holds what the labelled sample says about the word itself and about its character n-grams (log odds,
with hashed n-grams of three to five characters and word rims), and its length. Two gated recurrent layers read a window
of `window` words from both ends, attention pools their states, and a logistic unit gives the window's probability. The
score of a text is that of its most toxic window; windows overlap by `window - stride` words, and every word is read.

`fit` trains in numpy on the driver, on a bounded sample; the sample's texts that give the log odds and those that train
the network are different. `score` runs in the tasks that read the documents: no shuffle.

Defined cases: a null or empty text scores as a window without words, from the network's bias; rows with null labels
aren't learned from; with labels of one class only every text scores that class's share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import runs, texts_of, word_hashes, words_of

INPUTS = 6
_RIM = "".join(chr(c) for c in range(33, 48)) + ":;<=>?@[\\]^_`{|}~«»“”„’‘…"


@dataclass(frozen=True)
class Settings:
    """most: sampled rows of each class at most; grams: buckets of hashed character n-grams."""

    most: int = 600
    hidden: int = 8
    window: int = 48
    stride: int = 36
    grams: int = 1 << 16
    rounds: int = 200
    seed: int = 8
    known: int = 400_000


@dataclass
class Model:
    settings: Settings
    words: dict[str, float]
    grams: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float
    trained: bool = True
    mean: np.ndarray = field(default_factory=lambda: np.zeros(INPUTS, np.float32))
    spread: np.ndarray = field(default_factory=lambda: np.ones(INPUTS, np.float32))


def plain(word: str) -> str:
    return word.lower().strip(_RIM)


def grams_of(words: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hashed character n-grams of words with their rims, for each n: hashes, and the words they are of (rising)."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    x = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[owner] if len(words) else size
    out = []
    for n in (3, 4, 5):
        m = max(0, len(x) - n + 1)
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = (h ^ x[k : m + k]) * np.uint64(0x100000001B3) + np.uint64(n)
        own = np.arange(m) + n <= end[:m]
        out.append((((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)[own], owner[:m][own]))
    return out


def inputs(words: list[str], known: dict[str, float], grams: np.ndarray) -> np.ndarray:
    """Each word's input: its own log odds and whether it is known, the highest, mean and lowest of its n-grams, its length."""
    ws = [plain(w) for w in words]
    out = np.zeros((len(ws), INPUTS), np.float32)
    out[:, 0] = [known.get(w, 0.0) for w in ws]
    out[:, 1] = [w in known for w in ws]
    out[:, 5] = [min(len(w), 20) / 10 for w in ws]
    top, low, total, count = np.full(len(ws), -np.inf), np.full(len(ws), np.inf), np.zeros(len(ws)), np.zeros(len(ws))
    for at, owner in grams_of(ws, len(grams)):
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        own, value = owner[first], grams[at]
        top[own] = np.maximum(top[own], np.maximum.reduceat(value, first))
        low[own] = np.minimum(low[own], np.minimum.reduceat(value, first))
        total[own] += np.add.reduceat(value, first)
        count[own] += np.diff(np.append(first, len(owner)))
    some = count > 0
    out[some, 2], out[some, 3], out[some, 4] = top[some], total[some] / count[some], low[some]
    return out


def _odds(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Log odds of being seen in a toxic text, shrunk towards 0 where little was seen."""
    odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
    return odds * ((a + b) / (a + b + 3.0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(x: np.ndarray, w: dict[str, np.ndarray], side: str, keep: bool) -> tuple[np.ndarray, list]:
    """States of one gated recurrent layer over inputs x (time, rows, inputs)."""
    H = w[f"U{side}"].shape[0]
    U, bias = w[f"U{side}"], w[f"b{side}"]
    h, out, past = np.zeros((x.shape[1], H), np.float32), np.empty((*x.shape[:2], H), np.float32), []
    gates = x @ w[f"W{side}"] + bias
    for t in range(len(x)):
        s = h @ U[:, : 2 * H]
        zr = 1 / (1 + np.exp(-(gates[t, :, : 2 * H] + s)))
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(gates[t, :, 2 * H :] + (r * h) @ U[:, 2 * H :])
        if keep:
            past.append((h, z, r, c))
        h = h + z * (c - h)
        out[t] = h
    return out, past


def _unread(d: np.ndarray, x: np.ndarray, past: list, w: dict[str, np.ndarray], side: str, g: dict[str, np.ndarray]) -> None:
    """Adds to g the gradients of a layer's weights, given the gradients d of its states."""
    U = w[f"U{side}"]
    H = U.shape[0]
    dh = np.zeros_like(d[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c = past[t]
        dh = dh + d[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        drh = dc @ U[:, 2 * H :].T
        dr = drh * h * r * (1 - r)
        da = np.concatenate([dz, dr, dc], 1)
        g[f"W{side}"] += x[t].T @ da
        g[f"b{side}"] += da.sum(0)
        g[f"U{side}"][:, : 2 * H] += h.T @ da[:, : 2 * H]
        g[f"U{side}"][:, 2 * H :] += (r * h).T @ dc
        dh = dh * (1 - z) + da[:, : 2 * H] @ U[:, : 2 * H].T + drh * r


def _pooled(states: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights (time, rows) and the pooled states."""
    e = states @ w["v"] * 1.0
    e = np.where(mask, e, -1e9)
    a = np.exp(e - e.max(0))
    a *= mask
    a /= np.maximum(a.sum(0), 1e-9)
    return a, np.einsum("tb,tbh->bh", a, states)


def forward(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """The probability of each window; x (time, rows, inputs)."""
    states = np.concatenate([_read(x, w, "f", False)[0], _read(x[::-1], w, "b", False)[0][::-1]], 2)
    _, pooled = _pooled(states, mask, w)
    return _sigmoid(pooled @ w["o"] + w["c"][0])


def _gradient(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    g = {k: np.zeros_like(v) for k, v in w.items()}
    f, pf = _read(x, w, "f", True)
    b, pb = _read(x[::-1], w, "b", True)
    states = np.concatenate([f, b[::-1]], 2)
    a, pooled = _pooled(states, mask, w)
    d = (_sigmoid(pooled @ w["o"] + w["c"][0]) - y) / len(y)
    g["o"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
    dp = d[:, None] * w["o"]
    da = np.einsum("tbh,bh->tb", states, dp)
    de = a * (da - (a * da).sum(0))
    g["v"] = np.einsum("tb,tbh->h", de, states)
    ds = a[:, :, None] * dp + de[:, :, None] * w["v"]
    H = len(w["o"]) // 2
    _unread(ds[:, :, :H], x, pf, w, "f", g)
    _unread(ds[::-1, :, H:], x[::-1], pb, w, "b", g)
    return g


def _start(settings: Settings) -> dict[str, np.ndarray]:
    r, H = np.random.default_rng(settings.seed), settings.hidden
    w = {}
    for side in "fb":
        w |= {f"W{side}": r.normal(0, 0.5, (INPUTS, 3 * H)), f"U{side}": r.normal(0, 0.3, (H, 3 * H)), f"b{side}": np.zeros(3 * H)}
    w |= {"v": r.normal(0, 0.5, 2 * H), "o": r.normal(0, 0.5, 2 * H), "c": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _windows(n: int, window: int, stride: int) -> list[int]:
    """Where the overlapping windows of n words begin; the last one ends with the last word."""
    if n <= window:
        return [0]
    out = list(range(0, n - window, stride))
    return [*out, n - window]


def fit_texts(rows: list[tuple[str, int]], settings: Settings | None = None) -> Model:
    s = settings or Settings()
    n1 = sum(y for _, y in rows)
    prior = (n1 + 1) / (len(rows) + 2)
    blank = Model(s, {}, np.zeros(s.grams, np.float32), _start(s), prior, False)
    if min(n1, len(rows) - n1) < 4:
        return blank
    order = np.random.default_rng(s.seed).permutation(len(rows))
    half = [rows[i] for i in order[: len(rows) // 2]], [rows[i] for i in order[len(rows) // 2 :]]
    seen: dict[str, list[int]] = {}
    count, total = np.zeros((2, s.grams)), [0, 0]
    for text, y in half[0]:
        own = {plain(w) for w in text.split()} - {""}
        total[y] += 1
        for w in own:
            seen.setdefault(w, [0, 0])[y] += 1
        if own:
            count[y, np.unique(np.concatenate([at for at, _ in grams_of(list(own), s.grams)]))] += 1
    table = np.array(list(seen.values()), float)
    words = dict(zip(seen, _odds(table[:, 1], table[:, 0], total[1], total[0]).tolist()))
    words = {w: o for w, o in words.items() if abs(o) > 0.3}
    grams = _odds(count[1], count[0], total[1], total[0]).astype(np.float32)
    # windows of the other half; a toxic text teaches by its most toxic window as the network stands
    every = list({w for text, _ in half[1] for w in text.split()})
    known = dict(zip(every, inputs(every, words, grams)))
    xs, owner, ys = [], [], []
    for i, (text, y) in enumerate(half[1]):
        ws = text.split()
        for a in _windows(len(ws), s.window, s.stride):
            part = ws[a : a + s.window]
            x = np.zeros((s.window, INPUTS + 1), np.float32)
            if part:
                x[: len(part), :INPUTS] = [known[w] for w in part]
                x[: len(part), INPUTS] = 1
            xs.append(x)
            owner.append(i)
            ys.append(y)
    x = np.stack(xs, 1)
    mask, x = x[:, :, INPUTS] > 0, x[:, :, :INPUTS]
    flat = x[mask]
    mean, spread = flat.mean(0), flat.std(0) + 1e-3
    x = np.where(mask[:, :, None], (x - mean) / spread, 0).astype(np.float32)
    owner, ys = np.array(owner), np.array(ys, np.float32)
    bad, good = np.flatnonzero(ys == 1), np.flatnonzero(ys == 0)
    w = _start(s)
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    r = np.random.default_rng(s.seed + 1)
    # first guess of the toxic window: the one with the highest word or n-gram evidence
    strength = np.where(mask, x[:, :, 0] + x[:, :, 2], -9).max(0)
    for step in range(s.rounds):
        if step and step % 40 == 0:
            strength = np.concatenate([forward(x[:, i : i + 4096], mask[:, i : i + 4096], w) for i in range(0, x.shape[1], 4096)])
        if step % 40 == 0:
            at = bad[np.lexsort((-strength[bad], owner[bad]))]
            lead = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
            hard = good[np.argsort(-strength[good])[: max(64, len(good) // 8)]]
        pick = np.concatenate([r.choice(lead, 64), r.choice(good, 64), r.choice(hard, 48)])
        g = _gradient(x[:, pick], mask[:, pick], ys[pick], w)
        rate = 0.02 * (1 - step / s.rounds) + 0.001
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(np.float32)
    return Model(s, words, grams, w, prior, True, mean.astype(np.float32), spread.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings | None = None) -> Model:
    from veilspark.llm.compression_classifier import sample

    settings = settings or Settings()
    return fit_texts(sample(docs, labels, "toxic", learn, settings.most, settings.seed), settings)


class Scorer:
    """Scores texts; keeps the inputs of words it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.reset()
        self.empty = float(forward(np.zeros((1, 1, INPUTS), np.float32), np.zeros((1, 1), bool), model.weights)[0])

    def reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.values = np.zeros((0, INPUTS), np.float32)

    def _values(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        unique, one, back = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.searchsorted(self.hashes, unique)
            new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != unique) if len(self.hashes) else np.arange(len(unique))
            if not len(new):
                break
            if len(self.hashes) + len(new) > self.m.settings.known and len(self.hashes):
                self.reset()
                continue
            raw = data.tobytes()
            made = inputs([raw[b:e].decode() for b, e in zip(begin[one[new]].tolist(), end[one[new]].tolist())], self.m.words, self.m.grams)
            every = np.concatenate([self.hashes, unique[new]])
            order = np.argsort(every, kind="stable")
            self.hashes = every[order]
            self.values = np.concatenate([self.values, (made - self.m.mean) / self.m.spread])[order]
        return self.values[np.searchsorted(self.hashes, unique)][back]

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        s, n = self.m.settings, len(starts) - 1
        if not self.m.trained:
            return np.full(n, self.m.prior)
        begin, end, first = words_of(data, starts)
        out = np.full(n, self.empty)
        if not len(begin):
            return out
        values = self._values(data, begin, end)
        at, owner, size = [], [], []
        for i in np.flatnonzero(np.diff(first)):
            many = int(first[i + 1] - first[i])
            own = _windows(many, s.window, s.stride)
            at += [int(first[i]) + a for a in own]
            owner += [i] * len(own)
            size += [min(s.window, many)] * len(own)
        at, owner, size = np.array(at), np.array(owner), np.array(size)
        best = np.zeros(n)
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), 2048):
            pick = order[i : i + 2048]
            T = int(size[pick].max())
            step = np.arange(T)[:, None]
            mask = step < size[pick]
            x = values[np.minimum(at[pick] + step, len(values) - 1)]
            x *= mask[:, :, None]
            np.maximum.at(best, owner[pick], forward(x, mask, self.m.weights))
        full = np.diff(first) > 0
        out[full] = best[full]
        return out


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1: how likely the text is toxic."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for part in parts:
            data, starts = texts_of(pa.array(part, pa.large_string()))
            got = [scorer.score(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]) for i, j in runs(starts, 1 << 20)]
            yield pd.Series(np.concatenate(got) if got else np.zeros(0))

    return docs.withColumn(out, scored(F.col(text)))
