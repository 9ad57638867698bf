"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

The features of a text are the hashed 4-, 5- and 6-grams of its characters (A-Z in lower case, ASCII white space as
one kind of space) that occur in it at all. Feature ``f`` of class counts ``p_f`` and ``q_f`` (documents of
either class that hold it, plus one) gets the log-count ratio ``r_f = log(p_f / |p|) - log(q_f / |q|)``; a
logistic regression then learns a weight for each ``r_f``, on presence values damped by the text's length.
Features seen in fewer than ``min_df`` sample texts, or than a hundredth of the rarer class, have ratio 0, and only the ``keep`` strongest products of
weight and ratio stay in the model, which bounds what is broadcast (4 bytes for each of ``2**bits`` cells).

The ratios and weights are fitted on at most ``per_class`` labelled texts of each class (whole texts, taken by a
hash of their id, never from the held-out fold); every document is scored by its whole text, on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from evidencespark.llm.linear import code_points, collect_features, labelled_sample, score_texts

SIZES = (4, 5, 6)
#: Presence values are divided by (number of n-gram positions) ** DAMPING.
DAMPING = 0.4

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_BASE, _MIX = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # float32, one for each cell: learned weight times log-count ratio
    bias: float
    bits: int


def gram_cells(points: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each n-gram size the cell of the n-gram that starts at each code point (none where it would pass the end).

    An n-gram's hash is the sum of its code points times base ** (place in it), modulo 2 ** 64.
    """
    low = np.where(points < 128, _FOLD[np.minimum(points, 127)], points).astype(np.uint64)
    out, value, have = [], np.zeros(len(low), np.uint64), 0
    for n in SIZES:
        m = max(0, len(low) - n + 1)
        value = value[:m]
        for i in range(have, n):
            value = value + low[i : i + m] * np.uint64(pow(_BASE, i, 1 << 64))
        have = n
        mixed = (value ^ (value >> np.uint64(29))) + np.uint64(n)
        out.append(((mixed * _MIX) >> np.uint64(64 - bits)).astype(np.int32))
    return out


def _damp(n_points):
    """The factor on presence values of a text of ``n_points`` (padded) characters."""
    return 1.0 / np.maximum(len(SIZES) * np.asarray(n_points, float), 1.0) ** DAMPING


def _padded(points: np.ndarray) -> np.ndarray:
    return np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))


def fit(rows: list, bits: int, min_df: int, keep: int, steps: int, rate: float) -> ToxicityModel:
    """Ratios and logistic weights from ``(y, cells, [damping])`` rows, by AdaGrad steps in a fixed order.

    As many epochs as give ``steps`` steps, 40 at most.
    """
    cells = 1 << bits
    counts = [np.ones(cells), np.ones(cells)]
    sizes = [2.0, 2.0]
    for y, at, _ in rows:
        counts[y][at] += 1
        sizes[y] += 1
    ratio = np.log(counts[1] / sizes[1]) - np.log(counts[0] / sizes[0])
    ratio[counts[0] + counts[1] - 2 < max(min_df, min(sizes) // 100)] = 0
    weight = [len(rows) / (2 * max(1, size - 2)) for size in sizes]  # classes count alike
    w, seen, bias, seen_bias = np.zeros(cells), np.full(cells, 1e-8), 0.0, 1e-8
    rows = [(y, at[ratio[at] != 0], damp[0]) for y, at, damp in rows]
    order = np.random.default_rng(7)
    for _ in range(min(40, -(-steps // max(1, len(rows))))):
        for i in order.permutation(len(rows)):
            y, at, damp = rows[i]
            x = ratio[at] * damp
            error = 1 / (1 + np.exp(-np.clip(bias + w[at] @ x, -30, 30))) - y
            error *= weight[y]
            step = error * x + 1e-6 * w[at]
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            seen_bias += error * error
            bias -= rate * error / np.sqrt(seen_bias)
    final = w * ratio
    if keep < cells:
        final[np.abs(final) < np.partition(np.abs(final), cells - keep)[cells - keep]] = 0
    return ToxicityModel(final.astype(np.float32), float(bias), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500, bits: int = 20, min_df: int = 3, keep: int = 65_536, steps: int = 20_000, rate: float = 0.1) -> ToxicityModel:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``; without labelled rows it scores all 0.5."""

    def features(data):
        text = _padded(code_points(data, np.array([0, len(data)]))[0])
        at = np.unique(np.concatenate(gram_cells(text, bits)))
        return at, _damp([len(text)])

    rows = collect_features(labelled_sample(docs, labels, label, per_class), features)
    return fit(rows, bits, min_df, keep, steps, rate)


def score(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of class 1 of each text of a run: a sum over the distinct cells it holds."""
    n = len(offsets) - 1
    points, offsets = code_points(data, offsets)
    sizes = np.diff(offsets)
    spaced = np.full(len(points) + 2 * n, 32, np.uint32)  # each text between two spaces
    owner = np.repeat(np.arange(n), sizes)
    spaced[np.arange(len(points)) + 2 * owner + 1] = points
    starts = offsets[:-1] + 2 * np.arange(n)
    ends = starts + sizes + 2
    found = []
    for size, cells in zip(SIZES, gram_cells(spaced, model.bits), strict=True):
        hit = np.flatnonzero(model.weights[cells])
        doc = np.searchsorted(starts, hit, side="right") - 1
        inside = hit + size <= ends[doc]
        found.append(doc[inside].astype(np.int64) << model.bits | cells[hit[inside]])
    pairs = np.unique(np.concatenate(found))
    total = np.bincount(pairs >> model.bits, model.weights[pairs & ((1 << model.bits) - 1)].astype(float), n)
    return 1 / (1 + np.exp(-np.clip(model.bias + total * _damp(sizes + 2), -30, 30)))


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with a ``score`` column: the model's probability that a text is toxic.

    Null texts count as empty, empty texts get the score of no features. Every row is scored on its own, so
    repeated rows, ties, null ids and further columns do not matter; an empty table stays empty.
    """
    return score_texts(docs, model, score)
