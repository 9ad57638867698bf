"""Quality: supervised subword embeddings.

A text is the bag of its words (what lies between ASCII white space; a word that repeats the word before it is
the one token "again" instead) and of the 3- and 4-grams of its characters. Each is hashed to one of ``2**bits`` cells that
hold a learned vector; the vectors are averaged over the text and a softmax layer turns the average into class
probabilities. Vectors and layer are trained together by numpy stochastic gradient descent with AdaGrad steps;
cells in fewer than ``min_df`` of the sample's texts keep the zero vector. As average and layer are linear, a trained model is applied as one number for each
cell (its vector times the layer's difference of the two classes): the same scores, and only this is broadcast.

The model learns from at most ``per_class`` labelled texts of each class (whole texts, taken by a hash of their
id, never from the held-out fold); every document is scored by its whole text, on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from evidencespark.llm.linear import code_points, collect_features, labelled_sample, score_texts

GRAMS = (3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class QualityModel:
    logits: np.ndarray  # float32, one for each cell
    bias: float
    bits: int


def subword_cells(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all words and n-grams of a run of texts, and for each the text it belongs to.

    Both are hashed by sums of code points times base ** (place), modulo 2 ** 64.
    """
    data, offsets = code_points(data, offsets)
    n = len(offsets) - 1
    shift = np.uint64(64 - bits)
    wide = data.astype(np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    cells, texts = [], []
    value, have = np.zeros(len(wide), np.uint64), 0
    for size in GRAMS:
        m = max(0, len(wide) - size + 1)
        value = value[:m]
        for i in range(have, size):
            value = value + wide[i : i + m] * np.uint64(pow(int(_BASE), i, 1 << 64))
        have = size
        inside = owner[:m] == owner[size - 1 : size - 1 + m]
        own = value[inside]
        cells.append(((((own ^ (own >> np.uint64(29))) + np.uint64(size)) * _MIX) >> shift).astype(np.int32))
        texts.append(owner[:m][inside])
    letter = (data != 32) & ((data < 9) | (data > 13))
    first = letter.copy()
    first[1:] &= ~(letter[:-1] & (owner[1:] == owner[:-1]))
    start = np.flatnonzero(first)
    if len(start):
        last = letter.copy()
        last[:-1] &= ~(letter[1:] & (owner[1:] == owner[:-1]))
        end = np.flatnonzero(last) + 1
        length = end - start
        at = np.flatnonzero(letter)
        # A word's hash: the sum of (code point + 1) times base ** (place in the word).
        place = at - np.repeat(start, length)
        power = np.full(int(length.max()), _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.add.reduceat((wide[at] + np.uint64(1)) * power[place], np.concatenate(([0], np.cumsum(length)[:-1])))
        again = np.zeros(len(sums), bool)
        again[1:] = (sums[1:] == sums[:-1]) & (owner[start[1:]] == owner[start[:-1]])
        sums[again] = 1
        cells.append((((sums ^ (sums >> np.uint64(29))) * _MIX) >> shift).astype(np.int32))
        texts.append(owner[start])
    return np.concatenate(cells), np.concatenate(texts)


def fit(rows: list, bits: int, dim: int, min_df: int, steps: int, rate: float) -> QualityModel:
    """Vectors and softmax layer from ``(y, cells, shares)`` rows by stochastic gradient descent in a fixed order.

    As many epochs as give ``steps`` steps, 40 at most.
    """
    rng = np.random.default_rng(11)
    df = np.zeros(1 << bits, np.int32)
    for _, at, _ in rows:
        df[at] += 1
    known = df >= min_df
    small = np.uint16 if bits <= 16 else np.int32
    rows = [(y, at[known[at]].astype(small), share[known[at]]) for y, at, share in rows]
    vectors = np.zeros((1 << bits, dim))
    layer = rng.uniform(-1, 1, (2, dim))
    bias = np.zeros(2)
    seen, seen_layer, seen_bias = np.full(1 << bits, 1e-8), 1e-8, 1e-8
    for _ in range(min(40, -(-steps // max(1, len(rows))))):
        for i in rng.permutation(len(rows)):
            y, at, share = rows[i]
            own = vectors[at]
            mean = share @ own
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ layer
            step = np.outer(p, mean)
            seen_layer += (step * step).mean()
            seen_bias += (p * p).mean()
            seen[at] += share * share * (back @ back)
            layer -= rate * step / np.sqrt(seen_layer)
            bias -= rate * p / np.sqrt(seen_bias)
            vectors[at] = own - rate * (share / np.sqrt(seen[at]))[:, None] * back
    return QualityModel((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, bits: int = 16, dim: int = 8, min_df: int = 4, steps: int = 24_000, rate: float = 0.2) -> QualityModel:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``; without labelled rows it scores all 0.5."""

    def features(data):
        cells, _ = subword_cells(data, np.array([0, len(data)]), bits)
        at, counts = np.unique(cells, return_counts=True)
        return at, counts / max(1, len(cells))

    rows = collect_features(labelled_sample(docs, labels, label, per_class), features)
    return fit(rows, bits, dim, min_df, steps, rate)


def score(model: QualityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The softmax probability of class 1 of each text of a run."""
    n = len(offsets) - 1
    cells, texts = subword_cells(data, offsets, model.bits)
    total = np.bincount(texts, model.logits[cells].astype(float), n)
    mean = total / np.maximum(1, np.bincount(texts, minlength=n))
    return 1 / (1 + np.exp(-np.clip(model.bias + mean, -30, 30)))


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with a ``score`` column: the model's probability that a text is of good quality.

    Null texts count as empty, empty texts get the score of no features. Every row is scored on its own, so
    repeated rows, ties, null ids and further columns do not matter; an empty table stays empty.
    """
    return score_texts(docs, model, score)
