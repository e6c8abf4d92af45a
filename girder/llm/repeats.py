"""The common frame of both repeat removers: candidates by minimizers, documents beside their candidates, the cut.

A unit is a byte or a word. Every window of ``width`` units has an anchor, the least gram in it by hash; equal windows
have equal anchors at equal places. So only windows whose anchor's gram occurs at another anchor can repeat, and one
anchor in some ``(width - gram) / 2`` units is all that is exchanged to find them.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .cluster import drop_stored, stored
from .text import U64, lean

ANCHOR = "_row long, anchor int, first int, last int"


def repeated_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts; counted before they are exchanged, so a hot key is one row a task.

    Callers write the result before they join it: joined right away, the rows would meet it in the partitions of the
    count, which can't be split where one key is hot.
    """
    return table.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")


def anchor_table(rows: DataFrame, find: Callable, extra: str = "", name: str = "anchors") -> DataFrame:
    """``find(column)`` yields (first row, document in chunk, anchor, first, last, gram hash, *extra) per chunk."""
    schema = f"{ANCHOR}, gram long{extra}"

    def run(batches):
        for batch in batches:
            row = batch.column("_row").to_numpy()
            for at, doc, *columns in find(batch.column("_text")):
                ints, longs = columns[:3], columns[3:]
                arrays = [pa.array(row[at + doc])] + [pa.array(c.astype(np.int32)) for c in ints]
                arrays += [pa.array(c.view(np.int64)) if not isinstance(c, tuple) else pa.array(c[0].view(np.int64), mask=c[1]) for c in longs]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return stored(rows.select("_row", "_text").mapInArrow(lean(run), schema), name)


def beside_candidates(rows: DataFrame, candidates: DataFrame, fields: list[str], whole: Callable, whole_schema: str, name: str) -> DataFrame:
    """One row per document: (_row, _id, its whole result) where it has no candidate, else with _text and _candidates.

    ``whole(texts)`` gives the columns of ``whole_schema`` for documents that lose nothing. The table is written to the
    shared scratch space, so the texts are exchanged once.
    """
    lists = candidates.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_candidates"))
    joined = rows.join(lists, "_row", "left").select("_row", "_id", "_text", "_candidates")
    schema = StructType([*joined.schema.fields, *StructType.fromDDL(whole_schema).fields])

    def run(batches):
        for batch in batches:
            alone = batch.column("_candidates").is_null()
            texts = batch.column("_text").to_pylist()
            keep = alone.to_pylist()
            columns = whole([t if k else None for t, k in zip(texts, keep, strict=True)], keep)
            text = pa.array([None if k else t for t, k in zip(texts, keep, strict=True)], pa.string())
            arrays = [batch.column("_row"), batch.column("_id"), text, batch.column("_candidates"), *columns.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "_id", "_text", "_candidates", *columns])

    return stored(joined.mapInArrow(run, schema), name)


def cut(beside: DataFrame, runs: DataFrame, columns: list[str], whole_schema: str, cutter: Callable) -> DataFrame:
    """(_id, *columns) of every document: the results written before, and those of documents with candidates, whose
    texts meet their ``runs`` (_row, start, end: windows' first and last starts) and go through ``cutter``."""
    done = beside.where(F.col("_candidates").isNull()).select("_id", *columns)
    lists = runs.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    left = beside.where(F.col("_candidates").isNotNull()).select("_row", "_id", "_text").join(lists, "_row", "left")

    def run(batches):
        for batch in batches:
            found = batch.column("_runs")
            flat = np.stack([found.flatten().field(f).to_numpy().astype(np.int64) for f in ("start", "end")], axis=1)
            bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy()))
            out = cutter(batch.column("_text").to_pylist(), [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *out.values()], names=["_id", *out])

    return done.unionByName(left.select("_id", "_text", "_runs").mapInArrow(run, done.schema))


def covered(runs: np.ndarray, width: int) -> np.ndarray:
    """Maximal stretches covered by the windows whose starts lie in the sorted ``runs`` of starts (both ends in)."""
    if not len(runs):
        return np.zeros((0, 2), np.int64)
    starts, ends = runs[:, 0], np.maximum.accumulate(runs[:, 1] + width)
    new = np.append(True, starts[1:] > ends[:-1])
    first = np.flatnonzero(new)
    return np.stack([starts[first], ends[np.append(first[1:], len(starts)) - 1]], axis=1)


#: A window as it is kept in a block: its two hashes.
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u4")])
BLOCK = "_row long, first int, key binary, windows binary"


def block_batch(row: np.ndarray, first: np.ndarray, place: np.ndarray, last: np.ndarray, h: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    """Blocks, each a run of windows: its document, first window, and (from ``place`` to ``last`` of the hashes) its windows."""
    packed = np.empty(len(h), _WINDOW)
    packed["h"], packed["g"] = h, (g >> U64(32)).astype(np.uint32)
    raw = memoryview(packed.tobytes())
    size = _WINDOW.itemsize
    own = [bytes(raw[a * size : b * size]) for a, b in zip(place.tolist(), (last + 1).tolist(), strict=True)]
    keys = [blake2b(x, digest_size=16).digest() for x in own]
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(first.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(own, pa.binary())], names=["_row", "first", "key", "windows"])


def same_windows(blocks: DataFrame, name: str) -> DataFrame:
    """Of blocks of consecutive windows, the windows whose two hashes (94 bits) occur more than once, as runs
    (_row, start, end) of starts.

    A block that occurs again, window by window, repeats as a whole: copies need no more than that. All other blocks, and
    one of each that repeats, are taken apart and their windows counted. Windows are counted before they are exchanged.
    """
    blocks = stored(blocks, f"{name}-blocks")
    twice = blocks.groupBy("key").agg(F.count("*").alias("_n"), F.min(F.struct("_row", "first")).alias("_one")).where("_n > 1").select("key", "_one")
    twice = stored(twice, f"{name}-twice", small=True)
    joined = blocks.join(twice, "key", "left").select("_row", "first", "windows", F.col("_one").isNotNull().alias("whole"), F.coalesce(F.col("_one") == F.struct("_row", "first"), F.lit(True)).alias("apart"))

    def run(batches):
        for batch in batches:
            row, first = (batch.column(c).to_numpy() for c in ("_row", "first"))
            whole, apart = (np.asarray(batch.column(c)) for c in ("whole", "apart"))
            raw = batch.column("windows").to_pylist()
            n = np.array([len(x) for x in raw], np.int64) // _WINDOW.itemsize
            at = np.flatnonzero(whole)
            if len(at):
                none = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(first[at]), pa.array((first[at] + n[at] - 1).astype(np.int32)), *none], names=["_row", "start", "end", "h", "g"])
            at = np.flatnonzero(apart)
            if len(at):
                own = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), _WINDOW)
                before = np.repeat(np.cumsum(n[at]) - n[at], n[at])
                start = (np.repeat(first[at], n[at]) + np.arange(len(own)) - before).astype(np.int32)
                columns = [np.repeat(row[at], n[at]), start, start, own["h"].astype(np.uint64).view(np.int64), own["g"].astype(np.uint32).view(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_row", "start", "end", "h", "g"])

    rows = stored(joined.mapInArrow(run, "_row long, start int, end int, h long, g int"), f"{name}-windows")
    drop_stored(blocks, twice)
    windows = rows.where("h IS NOT NULL")
    twice = stored(repeated_keys(windows, "h", "g").select("h", "g"), f"{name}-repeated")
    found = windows.join(twice, ["h", "g"], "left_semi").select("_row", "start", "end").unionByName(rows.where("h IS NULL").select("_row", "start", "end"))
    out = stored(found, f"{name}-runs")
    drop_stored(rows, twice)
    return out
