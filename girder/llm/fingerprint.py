"""Document fingerprints: a homomorphic multiset hash of paragraphs, and the edited-text query that exercises it.

Every distinct paragraph position counts: a paragraph (a run between line feeds) hashes to a wide vector of 16-bit lanes
and a document's fingerprint is the sum of its paragraphs' vectors modulo 2**16. Sums don't depend on the order, and
adding or subtracting a paragraph's vector inserts or deletes it. The lanes form bands: in band j a paragraph touches a
lane with probability 2**-j, so the share of equal lanes also tells how many paragraphs two documents don't share,
into the tens of millions.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lean

BANDS, BAND_LANES = 24, 32
LANES = BANDS * BAND_LANES
#: The last lanes count the paragraphs, modulo 2**64.
COUNT_LANES = 4
#: Ids a run that the driver sorts to find the runs' bounds.
SAMPLED = 30
#: From this band on a lane's mask has no room in the 16 bits drawn for it and takes more.
WIDE = 16


@lru_cache(1)
def _band_masks() -> np.ndarray:
    return np.repeat((1 << np.arange(BANDS)) - 1, BAND_LANES).astype(np.uint32)


def vectors(paragraphs: list[bytes]) -> np.ndarray:
    """One row of lanes per paragraph."""
    wide = (BANDS - WIDE) * BAND_LANES
    raw = b"".join([hashlib.shake_128(p).digest(4 * LANES + 2 * wide) for p in paragraphs])
    words = np.frombuffer(raw, np.uint16).reshape(len(paragraphs), 2 * LANES + wide)
    chance = words[:, :LANES].astype(np.uint32)
    chance[:, LANES - wide :] |= words[:, 2 * LANES :].astype(np.uint32) << 16
    return np.where(chance & _band_masks() == 0, words[:, LANES : 2 * LANES] | np.uint16(1), 0).astype(np.uint16)


def _sum(paragraphs: list[bytes]) -> np.ndarray:
    """Lanes and count of some paragraphs; a block at a time, for texts of very many."""
    lanes = np.zeros(LANES, np.uint16)
    for i in range(0, len(paragraphs), 1024):
        lanes += vectors(paragraphs[i : i + 1024]).sum(axis=0, dtype=np.uint16)
    return np.append(lanes, np.array([len(paragraphs)], "<u8").view("<u2"))


def count(state: np.ndarray) -> int:
    return int(np.ascontiguousarray(state[LANES:]).view("<u8")[0])


def _counted(lanes: np.ndarray, n: int) -> np.ndarray:
    return np.append(lanes, np.array([n % 2**64], np.uint64).view("<u2"))


def fingerprint(text: str | None) -> np.ndarray:
    """Lanes and the count of the paragraphs of a text; an empty text has one empty paragraph, null reads as empty."""
    return _sum((text or "").encode().split(b"\n"))


def insert(state: np.ndarray, *paragraphs: str) -> np.ndarray:
    """The fingerprint with more paragraphs; ``delete`` undoes it."""
    more = _sum([p.encode() for p in paragraphs])
    return _counted(state[:LANES] + more[:LANES], count(state) + len(paragraphs))


def delete(state: np.ndarray, *paragraphs: str) -> np.ndarray:
    more = _sum([p.encode() for p in paragraphs])
    return _counted(state[:LANES] - more[:LANES], count(state) - len(paragraphs))


def as_text(state: np.ndarray) -> str:
    return base64.b64encode(state.astype("<u2").tobytes()).decode()


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(value), "<u2")


@lru_cache(1)
def _difference_by_equal_lanes() -> np.ndarray:
    """Of each number of equal lanes, the number of unshared paragraphs that makes it likeliest."""
    d = np.unique(np.append(np.arange(4096), np.geomspace(4096, 2.0 ** (BANDS + 2), 8192).astype(np.int64)))
    touched = 0.5 ** np.arange(BANDS)
    touched[0] = 1 - 2.0**-15
    expected = BAND_LANES * ((1 - touched)[None, :] ** d[:, None]).sum(axis=1)
    return np.array([d[np.abs(expected - k).argmin()] for k in range(LANES + 1)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the two multisets of paragraphs; 1 exactly when the fingerprints are equal."""
    if np.array_equal(a, b):
        return 1.0
    unshared = max(1, int(_difference_by_equal_lanes()[int((a[:LANES] == b[:LANES]).sum())]))
    total = count(a) + count(b)
    return max(0.0, (total - unshared) / (total + unshared))


def _cuts(rows: DataFrame, runs: int) -> list:
    """Ascending ids that part the rows into about ``runs`` runs of like size, from some ids a run chosen by their hashes."""
    every = max(1, rows.count() // (SAMPLED * runs))
    chosen = rows.where(F.col("_id").isNotNull() & (F.pmod(F.xxhash64("_id"), F.lit(every)) == 0)).select("_id").toArrow().column(0)
    ids = sorted(chosen.to_pylist())
    return sorted({ids[len(ids) * i // runs] for i in range(1, runs)}) if ids else []


def _dealer(shared, tops: bool):
    """Rows (_run, _borrowed, _id, _text) from (_id, _text); with ``tops`` unknown yet, (_run, _id) from (_id).

    Run 0 has ids from the highest cut upwards; null ids end the last run. Of the rows of a run's greatest id, each task
    also deals the one of least text to the run before, as a borrowed row.
    """

    def run(batches):
        cuts, before = shared.value
        place = lambda i: len(cuts) - bisect_right(cuts, i) if i is not None else len(cuts)
        heads: dict = {}
        for batch in batches:
            ids = batch.column("_id")
            values = ids.to_pylist()
            runs = pa.array([place(i) for i in values], pa.int32())
            if not tops:
                yield pa.RecordBatch.from_arrays([runs, ids], names=["_run", "_id"])
                continue
            texts = batch.column("_text")
            for k, i in enumerate(values):
                if i in before and (i not in heads or texts[k].as_py() < heads[i]):
                    heads[i] = texts[k].as_py()
            yield pa.RecordBatch.from_arrays([runs, pa.array(np.zeros(len(values), bool)), ids, texts], names=["_run", "_borrowed", "_id", "_text"])
            kind, text_kind = ids.type, texts.type
        if heads:
            columns = [pa.array([before[i] for i in heads], pa.int32()), pa.array([True] * len(heads)), pa.array(list(heads), kind), pa.array(list(heads.values()), text_kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["_run", "_borrowed", "_id", "_text"])

    return run


def documents_with_next(docs: DataFrame, *, id_col: str, text_col: str, runs: int | None = None) -> DataFrame:
    """Rows in runs: per partition, documents by falling id (nulls last, then by text), each run ending with the first
    row of the next one (_borrowed), the last with the first row of all.

    Runs are ranges of ids, two a split of the input; the driver knows a few ids of each. Rows of one id are in one run.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    cuts = _cuts(rows, runs or max(8, 2 * rows.rdd.getNumPartitions()))
    dealt = rows.select("_id").mapInArrow(_dealer(context.broadcast((cuts, {})), False), f"_run int, _id {kind}")
    tops = dealt.groupBy("_run").agg(F.max("_id").alias("top")).orderBy("_run").collect()
    before = {r["top"]: tops[i - 1]["_run"] for i, r in enumerate(tops)}
    dealt = rows.mapInArrow(_dealer(context.broadcast((cuts, before)), True), f"_run int, _borrowed boolean, _id {kind}, _text string")
    return dealt.repartitionById(max(1, len(cuts) + 1), F.col("_run")).sortWithinPartitions("_run", "_borrowed", F.col("_id").desc_nulls_last(), "_text")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id under ``id_col``, n_chars and fingerprint. Null texts are empty; rows never meet, so
    repeated rows give repeated results and nothing is shuffled."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([as_text(fingerprint(t)) for t in texts], pa.string())], names=[id_col, "n_chars", "fingerprint"])

    return source.mapInArrow(run, docs.select(F.col(f"`{id_col}`").alias(id_col)).schema.add("n_chars", "long").add("fingerprint", "string"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document by falling id
    (rows of one id by text, null ids last; after the last document comes the first). Ids may be of any type that has an
    order. Unshared paragraphs are subtracted and added rather than hashed anew. Null texts are empty; an empty table
    gives an empty result.
    """
    rows = documents_with_next(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        from itertools import chain

        waiting: tuple | None = None
        out: list[tuple] = []
        id_type = None

        def typed(batches):
            nonlocal id_type
            for batch in batches:
                id_type = batch.column("_id").type
                yield batch

        for run_no, borrowed, doc_id, text in chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("_run", "_borrowed", "_id", "_text")), strict=True) for b in typed(batches)):
            if borrowed and not waiting:
                continue  # several tasks may have borrowed the row; the first of least text has been met
            state = fingerprint(text)
            if waiting and waiting[0] == run_no:
                out.append(_edited(waiting[1], waiting[2], waiting[3], text, state))
            waiting = None if borrowed else (run_no, doc_id, text, state)
            if len(out) >= 512:
                yield _batch(out, names, id_type)
                out = []
        if out:
            yield _batch(out, names, id_type)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    return rows.select("_run", "_borrowed", "_id", "_text").mapInArrow(lean(run), f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edited(doc_id, text: str, state: np.ndarray, following: str, next_state: np.ndarray) -> tuple:
    cut = len(text) // 2
    head = text[: len(text) - cut]
    edited = head + following[:cut]
    # The paragraphs before the last line feed of the kept half are shared.
    shared = head.rfind("\n") + 1
    if edited[shared:] == text[shared:]:
        changed = state
    else:
        changed = insert(delete(state, *text[shared:].split("\n")), *edited[shared:].split("\n"))
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(state), as_text(changed), likeness(state, changed), likeness(state, next_state)


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
