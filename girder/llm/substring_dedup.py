"""Substring dedup by level-wise doubling over windows of words.

Windows of 9 words (one per anchor) that occur alone are out. What is left is extended to twice that length, to the left
and to the right; a candidate both of whose extensions are alone is out. What is left is extended to the full length (at
most twice again), and the windows that repeat there are removed. Lengths halve from the full one down to at least 5.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .cluster import drop_stored, keyed, stored
from .text import Prints, Rolling, U64, WordHash, anchors, chunks, word_bounds

WIDTH = 35
_WORD = WordHash(401)
_SHORT, _MIDDLE = Rolling(402), Rolling(403)
#: At the full length windows are told apart by two independent hashes, of words that two independent hashes tell apart.
_FULL = [(WordHash(s), Prints(s + 1)) for s in (411, 421)]


def levels(width: int) -> tuple[int, int]:
    """The first two lengths: a quarter and a half of the full one, rounded up."""
    return (width + 3) // 4, (width + 1) // 2


def _candidates(width: int):
    short, middle = levels(width)

    def find(column):
        for at, _, data, offsets in chunks(column):
            starts, ends, bounds = word_bounds(data, offsets)
            words = _WORD.spans(data, starts, ends)
            gram = _SHORT.windows(words, short)
            doc, anchor, first, last = anchors(gram, bounds, width, short)
            if not len(doc):
                continue
            long = _MIDDLE.windows(words, middle)
            low, high = bounds[doc], bounds[doc + 1]
            # The extension that ends with the anchor's gram and the one that starts with it, where the document has them.
            left, right = anchor + short - middle, anchor
            no_left, no_right = left < low, right + middle > high
            pick = lambda i, no: (long[np.where(no, 0, i)], no)
            yield at, doc, anchor - low, first - low, last - low, gram[anchor], pick(left, no_left), pick(right, no_right)

    return find


def _whole(digests: bool):
    def columns(texts, asked):
        words = [(t or "").encode().split() for t in texts]
        kept = [b" ".join(w) for w in words]
        return _columns([len(w) for w in words], [0] * len(texts), [[] for _ in texts], kept, asked, digests)

    return columns


def _columns(n_words, n_removed, runs, kept, asked, digests) -> dict[str, pa.Array]:
    ok = lambda x: [v if a else None for v, a in zip(x, asked, strict=True)]
    text = [hashlib.sha256(k).hexdigest() for k in kept] if digests else [k.decode() for k in kept]
    return {
        "n_words": pa.array(ok(n_words), pa.int64()),
        "n_removed": pa.array(ok(n_removed), pa.int64()),
        "removed_runs": pa.array(ok(runs), pa.list_(pa.list_(pa.int32()))),
        "kept_sha256" if digests else "kept": pa.array(ok(text), pa.string()),
    }


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row of ``docs``: its id under ``id_col``, n_words, n_removed, removed_runs (maximal [start, end) word positions)
    and kept (what stays, joined by one space) or, with ``digests``, kept_sha256.

    A word goes when a window of ``width`` words of its document covers it whose words also start anywhere else. Null
    and empty texts have no words; documents shorter than a window lose nothing; repeated rows are copies and lose every
    window; null ids are kept apart by row. All words of all documents are looked at. What is removed rests on 94 bits of
    two hashes of the window, each with a hash of the words of its own.
    """
    short, middle = levels(width)
    rows = keyed(docs, id_col, text_col)
    table = repeats.anchor_table(rows, _candidates(width), ", left long, right long", "op4-anchors")
    twice = stored(repeats.repeated_keys(table, "gram").select("gram"), "op4-repeated")
    once = stored(table.join(twice, "gram", "left_semi").drop("gram"), "op4-short")
    drop_stored(table, twice)
    sides = once.select("*", F.posexplode(F.array("left", "right")).alias("side", "key")).where("key IS NOT NULL").drop("left", "right")
    twice = stored(repeats.repeated_keys(sides, "side", "key").select("side", "key"), "op4-repeated")
    doubled = sides.join(twice, ["side", "key"], "left_semi")
    doubled = doubled.select("_row", "first", "last").distinct()
    schema = f"n_words long, n_removed long, removed_runs array<array<int>>, {'kept_sha256' if digests else 'kept'} string"
    beside = repeats.beside_candidates(rows, doubled, ["first", "last"], _whole(digests), schema, "op4-beside")
    drop_stored(once, twice)

    def windows(batches):
        for batch in batches:
            row, ranges = batch.column("_row").to_numpy(), batch.column("_candidates")
            for at, end, data, offsets in chunks(batch.column("_text")):
                own = ranges.slice(at, end - at)
                starts, ends, bounds = word_bounds(data, offsets)
                flat = own.flatten()
                if not len(flat):
                    continue
                doc = np.repeat(np.arange(end - at), np.diff(own.offsets.to_numpy()))
                first, last = (flat.field(f).to_numpy().astype(np.int64) for f in ("first", "last"))
                h, g = (long.windows(word.spans(data, starts, ends), width) for word, long in _FULL)
                yield repeats.block_batch(row[at + doc], first, first + bounds[doc], last + bounds[doc], h, g)

    full = beside.where(F.col("_candidates").isNotNull()).select("_row", "_text", "_candidates")
    runs = repeats.same_windows(full.mapInArrow(windows, repeats.BLOCK), "op4")

    def cutter(texts, found):
        counts, removed, runs, kept = [], [], [], []
        for text, own in zip(texts, found, strict=True):
            words = (text or "").encode().split()
            spans = repeats.covered(own, width)
            stay, at = [], 0
            for start, end in spans.tolist():
                stay += words[at:start]
                at = end
            stay += words[at:]
            counts.append(len(words))
            removed.append(len(words) - len(stay))
            runs.append(spans.tolist())
            kept.append(b" ".join(stay))
        return _columns(counts, removed, runs, kept, [True] * len(texts), digests)

    columns = [f.split()[0] for f in schema.split(", ")]
    return repeats.cut(beside, runs, columns, schema, cutter).withColumnRenamed("_id", id_col)
