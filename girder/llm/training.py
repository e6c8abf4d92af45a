"""What both classifiers share: the bounded sample of labelled rows and per-document score columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import free_name, lean


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, features, *, modulus: int, held_out: int, max_rows: int, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> pa.Table:
    """Of at most ``max_rows`` labelled rows that are not held out, the first by a hash of the id: (label, numbers, stats,
    *more), by id.

    ``features(column of texts)`` yields per text its hashed words as integers and a list of statistics; both are found
    where the texts are, so no text reaches the driver. An id labelled more than once takes its greatest label; null
    labels don't count. A document is asked for once even where its row repeats.
    """
    chosen = labels.where(F.col(label).isNotNull() & (remainder("doc_id", modulus) != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), *[F.col(f"`{c}`").cast("string").alias(f"_{c}") for c in more])
    rows = rows.join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("_text", "_label", *[f"_{c}" for c in more])).alias("r")).select("doc_id", "r.*")

    def run(batches):
        for batch in batches:
            found = list(features(batch.column("_text")))
            arrays = [pa.array([np.asarray(w, np.int32).tobytes() for w, _ in found], pa.binary()), pa.array([list(map(float, s)) for _, s in found], pa.list_(pa.float64()))]
            names = ["doc_id", "_label", *[f"_{c}" for c in more]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], names=[*names, "numbers", "stats"])

    out = rows.mapInArrow(lean(run), rows.select("doc_id", "_label", *[f"_{c}" for c in more]).schema.add("numbers", "binary").add("stats", ArrayType(DoubleType())))
    return out.orderBy("doc_id").drop("doc_id").toArrow()


def numbers_of(sample: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.int32) for x in sample.column("numbers")]


class Adam:
    """Steps for a dictionary of numpy arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.first[k], self.second[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.params[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_documents(docs: DataFrame, model, scorer, *, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` and ``score_col`` of every row; ``scorer(model, column of texts)`` gives the scores."""
    keep = [c for c in keep if c != score_col]
    name_of_text = free_name(keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(name_of_text))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(name_of_text)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scorer(shared.value, texts), pa.float64())], names=[*keep, score_col])

    return source.mapInArrow(lean(run), source.drop(name_of_text).schema.add(score_col, "double"))
