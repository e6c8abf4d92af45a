"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Filters of several widths slide over the words of a whole text, each keeps its greatest response, and a logistic layer
reads those. Embeddings start at zero but for a first lane with the word's log-odds among the training rows, so words
never seen answer nothing. Cut-offs are calibrated by language on labelled rows that the net isn't fitted on; the score
itself never reads the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .text import Rolling, U64, chunks, mix, word_bounds

BUCKETS, LANES, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
#: Bytes of the beginnings of a word that have embeddings of their own, added to the word's.
PREFIXES = (4, 6, 8)
#: Labelled rows that are sampled, and of how many of them one is kept from a fit that finds the cut-offs.
MAX_TRAINING_ROWS, CALIBRATION = 7000, 7
_HASH = Rolling(601, fold_case=True)
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def featurise(column: pa.Array):
    """Per chunk: the buckets of each word (itself and its beginnings), and the words' bounds by document.

    Words are runs of letters, digits and non-ASCII bytes, in lower case of A-Z.
    """
    for _, _, data, offsets in chunks(column):
        starts, ends, bounds = word_bounds(data, offsets, _SEPARATORS)
        sums, down = _HASH.sums(_HASH.table[data])
        rows = []
        for size in (None, *PREFIXES):
            stop = ends if size is None else np.minimum(starts + size, ends)
            rows.append(mix((sums[stop] - sums[starts]) * down[starts] + U64(size or 0)) & U64(BUCKETS - 1))
        yield np.stack(rows, axis=1).astype(np.int64), bounds


class TextCnn:
    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.params = {"e": np.zeros((BUCKETS, LANES), np.float32)}
        for k in WIDTHS:
            f = rng.normal(0, 0.3, (k, LANES, FILTERS)).astype(np.float32)
            f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
            self.params[f"f{k}"] = f
            self.params[f"b{k}"] = np.zeros(FILTERS, np.float32)
        self.params["out"] = np.tile(np.repeat([0.5, -0.2], FILTERS // 2), len(WIDTHS)).astype(np.float32)
        self.params["bias"] = np.full(1, -1.0, np.float32)
        self.cutoffs: dict[str | None, float] = {}

    def pooled(self, words: np.ndarray, bounds: np.ndarray):
        """The greatest response of each filter per document, at least 0, and (for training) where it was."""
        p, n = self.params, len(bounds) - 1
        vectors = p["e"][words[:, 0]]
        for i in range(1, words.shape[1]):
            vectors += p["e"][words[:, i]]
        out, places = [], []
        for k in WIDTHS:
            last = len(words) - k + 1
            best = np.zeros((n, FILTERS), np.float32)
            where = np.full((n, FILTERS), -1)
            if last > 0:
                response = sum(vectors[j : last + j] @ p[f"f{k}"][j] for j in range(k)) + p[f"b{k}"]
                starts, stops = bounds[:-1], np.maximum(bounds[1:] - k + 1, bounds[:-1])
                for d in np.flatnonzero(stops > starts):
                    own = response[starts[d] : stops[d]]
                    at = own.argmax(axis=0)
                    top = own[at, np.arange(FILTERS)]
                    best[d] = np.maximum(top, 0)
                    where[d] = np.where(top > 0, at + starts[d], -1)
            out.append(best)
            places.append(where)
        return np.concatenate(out, axis=1), places, vectors

    def fit(self, docs: list[np.ndarray], target: np.ndarray, epochs: int = 8, rate: float = 0.01) -> None:
        rng, p = np.random.default_rng(8), self.params
        pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for words, y in zip(docs, target, strict=True):
            (pos if y else neg)[np.unique(words)] += 1
        n_pos, n_neg = max(target.sum(), 1), max((1 - target).sum(), 1)
        seen = pos + neg >= 3
        p["e"][:, 0] = np.where(seen, np.log((pos + 0.3) / (n_pos + 0.6)) - np.log((neg + 0.3) / (n_neg + 0.6)), 0).clip(-3, 6) / 4
        p["e"][seen, 1:] = rng.normal(0, 0.05, (int(seen.sum()), LANES - 1))
        adam = training.Adam({k: v for k, v in p.items() if k != "e"}, rate)
        size = max(8, min(64, len(target) // 12))
        weight = np.where(target > 0, min(10.0, n_neg / n_pos), 1.0)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), size):
                rows = order[at : at + size]
                words = np.concatenate([docs[r] for r in rows])
                bounds = np.append(0, np.cumsum([len(docs[r]) for r in rows]))
                pooled, places, vectors = self.pooled(words, bounds)
                score = training.sigmoid(pooled @ p["out"] + p["bias"])
                g = ((score - target[rows]) * weight[rows] / len(rows)).astype(np.float32)
                grads = {"out": pooled.T @ g + 1e-3 * p["out"], "bias": np.array([g.sum()], np.float32)}
                back = g[:, None] * p["out"]
                for w, k in enumerate(WIDTHS):
                    own, where = back[:, w * FILTERS : (w + 1) * FILTERS], places[w]
                    doc, f = np.nonzero(where >= 0)
                    pull, spot = own[doc, f], where[doc, f]
                    grads[f"b{k}"] = np.bincount(f, pull, FILTERS).astype(np.float32)
                    grad = np.zeros_like(p[f"f{k}"])
                    for j in range(k):
                        np.add.at(grad[j].T, f, pull[:, None] * vectors[spot + j])
                        step = -rate * len(rows) / 4 * pull[:, None] * p[f"f{k}"][j].T[f]
                        for i in range(words.shape[1]):
                            np.add.at(p["e"], words[spot + j, i], step)
                    grads[f"f{k}"] = grad + 1e-4 * p[f"f{k}"]
                adam.step(grads)

    def score(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return training.sigmoid(self.pooled(words, bounds)[0] @ self.params["out"] + self.params["bias"])

    def scores(self, column: pa.Array) -> np.ndarray:
        out = [self.score(words, bounds) for words, bounds in featurise(column)]
        return np.concatenate(out).astype(float) if out else np.zeros(0)


def calibrate(model: TextCnn, scores: np.ndarray, target: np.ndarray, langs: list, least: int = 20) -> None:
    """Per language the cut-off with the best F1 on these rows; languages with fewer than ``least`` toxic rows share the
    one of all rows (under the key None). Of equal F1 the highest cut-off counts."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
        at = int(f1.argmax())
        below = s[order[at + 1]] if at + 1 < len(s) else 0.0
        return float((s[order[at]] + below) / 2)

    model.cutoffs = {None: best(scores, target)}
    tags = np.array([x or "" for x in langs])
    for lang in np.unique(tags):
        own = tags == lang
        if lang and target[own].sum() >= least:
            model.cutoffs[str(lang)] = best(scores[own], target[own])


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAINING_ROWS, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> TextCnn | None:
    """Fit on at most ``max_rows`` labelled rows that are not held out; without any, None.

    Cut-offs come from rows that the net they are found with wasn't fitted on: one is fitted without every seventh row and
    scores those; the one that is returned is fitted on all. Of fewer than 50 rows all serve both ends.
    """
    more = (lang_col,) if lang_col in docs.columns else ()
    sample = training.labelled_sample(docs, labels, "toxic", _by_text, modulus=modulus, held_out=held_out, max_rows=max_rows, id_col=id_col, text_col=text_col, more=more)
    if not len(sample):
        return None
    own = [x.reshape(-1, 1 + len(PREFIXES)) for x in training.numbers_of(sample)]
    target = sample.column("_label").to_numpy().astype(float)
    model = judge = TextCnn()
    model.fit(own, target)
    rest = np.arange(len(own))
    if len(own) >= 50:
        apart, judge = rest % CALIBRATION == 0, TextCnn()
        judge.fit([own[i] for i in rest[~apart]], target[~apart])
        rest = rest[apart]
    scores = np.concatenate([judge.score(own[i], np.array([0, len(own[i])])) for i in rest])
    langs = sample.column(f"_{lang_col}").to_pylist() if more else [None] * len(own)
    calibrate(model, scores, target[rest], [langs[i] for i in rest])
    return model


def _by_text(column: pa.Array):
    for words, bounds in featurise(column):
        yield from ((words[a:b], ()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def _scores(model: TextCnn | None, column: pa.Array) -> np.ndarray:
    return np.full(len(column), 0.5) if model is None else model.scores(column)


def classify(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns ``keep`` (default all), ``score`` (the likelihood of toxic label 1) and ``toxic`` (by the language's
    calibrated cut-off; null or unknown languages use the common one).

    Scores depend on the text alone. Null texts read as empty; texts without words score by the bias. With no labelled
    rows every score is 0.5 and nothing is toxic. Columns named score or toxic are replaced.
    """
    model = train(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col, lang_col=lang_col)
    keep = [c for c in keep or docs.columns if c not in ("score", "toxic")]
    carried = keep + ([lang_col] if lang_col in docs.columns and lang_col not in keep else [])
    scored = training.score_documents(docs, model, _scores, keep=carried, text_col=text_col)
    cut = model.cutoffs if model else {None: 2.0}
    limit = F.lit(cut[None])
    if lang_col in docs.columns:
        for lang, value in cut.items():
            if lang is not None:
                limit = F.when(F.col(f"`{lang_col}`") == lang, value).otherwise(limit)
    return scored.select(*[F.col(f"`{c}`") for c in keep], "score", (F.col("score") >= limit).alias("toxic"))
