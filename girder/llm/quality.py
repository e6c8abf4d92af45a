"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (the length).

Every occurrence of a word is a feature of weight 1/sqrt(words); the statistics follow, standardised. The machine adds
to a linear score the products of all pairs' factors, in time linear in the features by the identity
2 * sum of pairs = (sum of v x)**2 - sum of (v x)**2, per factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .text import SPACE, U64, WordHash, chunks, word_bounds

BUCKETS, FACTORS = 1 << 15, 8
MAX_TRAINING_ROWS = 8000
_HASH = WordHash(501, fold_case=True)
_UPPER, _DIGIT, _MARK, _HIGH, _LINE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = _LINE[10] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def featurise(column: pa.Array):
    """Per chunk of documents: word buckets, word counts, statistics (one row per document)."""
    for _, _, data, offsets in chunks(column):
        starts, ends, bounds = word_bounds(data, offsets)
        hashes = _HASH.spans(data, starts, ends)
        n = np.diff(bounds)
        sums = lambda x, at: np.diff(np.append(0, np.cumsum(x))[at])
        size = np.diff(offsets)
        share = [sums(c[data], offsets) / np.maximum(size, 1) for c in (_UPPER, _DIGIT, _MARK, _HIGH, _LINE, SPACE)]
        length = (ends - starts).astype(float)
        mean = sums(length, bounds) / np.maximum(n, 1)
        spread = np.sqrt(np.maximum(sums(length**2, bounds) / np.maximum(n, 1) - mean**2, 0))
        short = sums(length <= 3, bounds) / np.maximum(n, 1)
        marked = sums(_MARK[data[ends - 1]], bounds) / np.maximum(n, 1) if len(ends) else np.zeros(len(n))
        follows = np.append(hashes[1:] == hashes[:-1], False)[: len(hashes)]
        follows[bounds[1:][n > 0] - 1] = False  # a document's last word has none after it
        again = sums(follows, bounds) / np.maximum(n, 1)
        distinct = _distinct(np.repeat(np.arange(len(n)), n), hashes, len(n))
        stats = np.stack([np.log1p(size), np.log1p(n), *share, mean, spread, short, marked, again, distinct / np.maximum(n, 1)], axis=1)
        yield (hashes & U64(BUCKETS - 1)).astype(np.int64), n, stats


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.sort((hashes & ~U64((1 << 20) - 1)) | (doc % (1 << 20)).astype(np.uint64))
    new = np.append(True, order[1:] != order[:-1])[: len(order)]
    return np.bincount((order[new] & U64((1 << 20) - 1)).astype(np.int64), minlength=n)[:n].astype(float)


class FactorisationMachine:
    def __init__(self, n_stats: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.params = {
            "bias": np.zeros(1),
            "w": np.zeros(BUCKETS),
            "v": np.zeros((BUCKETS, FACTORS)),
            "ws": np.zeros(n_stats),
            "vs": rng.normal(0, 0.05, (n_stats, FACTORS)),
        }
        self.center, self.scale = np.zeros(n_stats), np.ones(n_stats)

    def forward(self, words: np.ndarray, counts: np.ndarray, stats: np.ndarray):
        p = self.params
        doc = np.repeat(np.arange(len(counts)), counts)
        x = 1 / np.sqrt(np.maximum(counts, 1))
        bounds = np.append(0, np.cumsum(counts))

        def total(values: np.ndarray) -> np.ndarray:
            sums = np.cumsum(np.concatenate([np.zeros((1, *values.shape[1:])), values]), axis=0)
            return sums[bounds[1:]] - sums[bounds[:-1]]

        z = np.clip((stats - self.center) / self.scale, -4, 4)
        v = p["v"][words]
        summed = total(v) * x[:, None] + z @ p["vs"]
        squares = total((v * v).sum(axis=1)) * x * x + (z * z) @ (p["vs"] ** 2).sum(axis=1)
        score = p["bias"][0] + total(p["w"][words]) * x + z @ p["ws"] + 0.5 * ((summed**2).sum(axis=1) - squares)
        return score, (doc, x, z, v, summed)

    def fit(self, parts: list, target: np.ndarray, epochs: int = 12, rate: float = 0.02) -> None:
        words, counts, stats = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.center, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        bounds = np.append(0, np.cumsum(counts))
        rng = np.random.default_rng(7)
        adam, p = training.Adam(self.params, rate), self.params
        p["v"] += rng.normal(0, 0.01, p["v"].shape) * (np.bincount(words, minlength=BUCKETS) > 0)[:, None]
        size = max(16, min(256, len(target) // 12))
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for at in range(0, len(order), size):
                rows = order[at : at + size]
                own = np.concatenate([words[bounds[r] : bounds[r + 1]] for r in rows]) if len(rows) else words[:0]
                score, (doc, x, z, v, summed) = self.forward(own, counts[rows], stats[rows])
                g = (training.sigmoid(score) - target[rows]) / len(rows)
                gx = (g * x)[doc]
                grads = {"bias": np.array([g.sum()]), "ws": z.T @ g + 1e-3 * p["ws"]}
                grads["vs"] = (z * g[:, None]).T @ summed - ((z * z).T @ g)[:, None] * p["vs"] + 1e-3 * p["vs"]
                grads["w"] = np.bincount(own, gx, BUCKETS) + 1e-5 * p["w"]
                pull = gx[:, None] * (summed[doc] - v * x[doc][:, None])
                grads["v"] = np.stack([np.bincount(own, pull[:, f], BUCKETS) for f in range(FACTORS)], axis=1) + 1e-5 * p["v"]
                adam.step(grads)
        for k in ("w", "v"):
            p[k] = p[k].astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = [training.sigmoid(self.forward(*part)[0]) for part in featurise(column)]
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAINING_ROWS, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine | None:
    """Fit on at most ``max_rows`` labelled rows that are not held out; without any, None."""
    sample = training.labelled_sample(docs, labels, "quality", _by_text, modulus=modulus, held_out=held_out, max_rows=max_rows, id_col=id_col, text_col=text_col)
    if not len(sample):
        return None
    words, stats = training.numbers_of(sample), np.array(sample.column("stats").to_pylist())
    model = FactorisationMachine(stats.shape[1])
    model.fit([(np.concatenate(words), np.array([len(w) for w in words]), stats)], sample.column("_label").to_numpy().astype(float))
    return model


def _by_text(column: pa.Array):
    for words, counts, stats in featurise(column):
        yield from zip(np.split(words, np.cumsum(counts)[:-1]), stats, strict=True)


def _scores(model: FactorisationMachine | None, column: pa.Array) -> np.ndarray:
    return np.full(len(column), 0.5) if model is None else model.scores(column)


def classify(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` (default all) and ``score_col``: the likelihood that a text's quality label is 1.

    Scores depend on the text alone, so repeated rows score alike; null texts read as empty and are scored by their
    statistics; with no labelled rows every score is 0.5. A column named ``score_col`` is replaced. One scan fits the model
    (a bounded sample), one scores every row; nothing is shuffled but the sample.
    """
    model = train(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col)
    return training.score_documents(docs, model, _scores, keep=keep or docs.columns, text_col=text_col, score_col=score_col)
