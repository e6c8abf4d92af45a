"""LM scoring by prediction by partial matching over bytes, and the word-count base it is held against.

The model holds, for contexts of up to ORDER bytes, every symbol that followed in training (or, where a ``min_share``
is asked for, those with that share of all training positions), so it grows with the corpus. It is never whole in one
place: each task holds the chances of the most frequent codes (a symbol and the ORDER bytes before it); the rest of a
text's codes go to the part of the stored counts that has their contexts, dealt by the last LOCAL bytes of the context.
Shorter contexts have at most 2**24 codes, which each of those tasks holds. A symbol is coded in the longest context that the trie has, else by escaping to the next shorter one, where the symbols
the longer one predicts are excluded. The chance of an escape is what the context's training count leaves to symbols
that aren't in the trie, plus one for each that is. A text ends with the symbol 0.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import keyed, most_frequent, stored
from .text import HELD, LOWER, U64, WordHash, chunks, lean, mix, word_bounds

ORDER = 5
#: Contexts of this many bytes and more are dealt over the tasks by their last bytes.
LOCAL = 3
#: Codes, the most frequent, whose chances every task holds; all others meet the stored counts.
HEAVY_CODES = 800_000
#: Counted codes, and codes to be looked up, that a task is meant to have.
PART_CODES, PART_LOOKUPS = 250_000, 4_000_000
#: Words, the most frequent, whose counts every task holds; those of all others meet their counts in a join.
HEAVY_WORDS = 250_000
FLUSH = 6_000_000
_WORD = WordHash(301, fold_case=True)
#: Bytes in lower case of A-Z; U+0000, which is the end's symbol, reads as a byte that UTF-8 never has.
_SYMBOL = LOWER.copy()
_SYMBOL[0] = 0xFF


def contexts(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(order + 1)-byte codes of all symbols, ends included, in lower case of A-Z, and each document's bounds."""
    n_docs = len(offsets) - 1
    padded = np.zeros(len(data) + order * (n_docs + 1), np.uint64)
    shift = np.repeat(np.arange(1, n_docs + 1) * order, np.diff(offsets))
    padded[np.arange(len(data)) + shift] = _SYMBOL[data]
    code = np.zeros(len(padded) - order, np.uint64)
    for j in range(order + 1):
        code |= padded[j : len(padded) - order + j] << U64(8 * (order - j))
    # Symbols of document d, its end being the first zero after it, start at offsets[d] + d * order.
    bounds = offsets + np.arange(n_docs + 1) * order
    keep = np.ones(len(code), bool)
    for j in range(1, order):
        keep[bounds[1:] - j] = False
    return code[keep], offsets + np.arange(n_docs + 1)


class Table:
    """Places of 64-bit keys by open addressing, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(2.5 * max(len(keys), 1)))))
        self.mask = U64(size - 1)
        self.keys, self.places = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = mix(keys) & self.mask
        while len(left):
            free = self.places[slot] < 0
            self.places[slot[free]] = left[free]
            won = self.places[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + U64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is missing."""
        slot = mix(keys) & self.mask
        out = self.places[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + U64(1)) & self.mask
            out[open_] = self.places[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out


class Trie:
    """Per order k: ``grams`` (codes of k + 1 bytes, sorted) and ``counts``; per context of k bytes its full count."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], below: Trie | None = None):
        """``below`` has the orders before those of ``levels``; it is shared, not copied."""
        self.levels = list(below.levels) if below else []
        before = below.last if below else None
        for k, (grams, counts, context_codes, full) in enumerate(levels, len(self.levels)):
            order = np.argsort(grams)
            grams, counts = grams[order], counts[order].astype(float)
            codes, first = np.unique(grams >> U64(8), return_index=True)
            by_code = np.argsort(context_codes)
            total = full[by_code][np.searchsorted(context_codes[by_code], codes)].astype(float)
            kinds = np.diff(np.append(first, len(grams))).astype(float)
            held = np.add.reduceat(counts, first) if len(first) else counts
            level = {
                "grams": Table(grams),
                "contexts": Table(codes),
                "log_count": np.log10(counts).astype(np.float32),
                "log_total": np.append(np.log10(total + kinds), 0).astype(np.float32),  # the last is for contexts it hasn't
                "log_escape": np.log10((total - held + kinds) / (total + kinds)).astype(np.float32),
            }
            if before is not None:
                # What the next shorter context still has once this one's symbols are excluded.
                shorter = np.searchsorted(before["codes"], codes & U64((1 << 8 * (k - 1)) - 1))
                excluded = np.add.reduceat(before["counts"][np.searchsorted(before["grams"], grams & U64((1 << 8 * k) - 1))], first) if len(first) else counts
                kinds_left = before["kinds"][shorter] - kinds
                total_left = np.maximum(before["total"][shorter] - excluded, 0) + kinds_left
                unheld = np.maximum(before["total"][shorter] - before["held"][shorter], 0) + kinds_left
                empty = total_left <= 0
                level["left_total"] = np.log10(np.where(empty, 1, total_left)).astype(np.float32)
                level["left_escape"] = np.log10(np.where(empty, 1, np.maximum(unheld, 1e-9) / np.where(empty, 1, total_left))).astype(np.float32)
            before = {"codes": codes, "grams": grams, "counts": counts, "kinds": kinds, "total": total, "held": held}
            self.levels.append(level)
        self.last = before
        self.unseen = below.unseen if below else float(-np.log10(max(256 - len(levels[0][0]), 1)))

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each code after those before it."""
        out = np.zeros(len(codes))
        at = np.arange(len(codes))
        escaped = np.full(len(codes), -1, np.int32)  # the context just escaped from, one order up
        for k in range(len(self.levels) - 1, -1, -1):
            level, up = self.levels[k], self.levels[k + 1] if k + 1 < len(self.levels) else None
            own = codes[at] & U64((1 << 8 * (k + 1)) - 1)
            place, context = level["grams"].find(own), level["contexts"].find(own >> U64(8))
            first, again = escaped < 0, escaped >= 0
            hit = place >= 0
            total = np.where(first, level["log_total"][context], 0.0)
            if up is not None and again.any():
                total[again] = up["left_total"][escaped[again]]
            out[at[hit]] += level["log_count"][place[hit]] - total[hit]
            miss = ~hit & (context >= 0)
            fresh, more = miss & first, miss & again
            out[at[fresh]] += level["log_escape"][context[fresh]]
            if up is not None:
                out[at[more]] += up["left_escape"][escaped[more]]
            rest = ~hit
            at, escaped = at[rest], np.where(context >= 0, context, -1)[rest].astype(np.int32)
            if not len(at):
                return out
        out[at] += self.unseen
        return out


def _gather(order: int):
    """Counts of (order + 1)-byte codes (kind 0) and word hashes (kind 1) in blocks of a few million symbols."""

    def counted(kind: int, held: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), kind, np.int8)), pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names=["kind", "key", "count"])

    def run(batches):
        held: tuple[list, list] = ([], [])
        size = 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("_text")):
                codes, _ = contexts(data, offsets, order)
                starts, ends, _ = word_bounds(data, offsets)
                held[0].append(codes)
                held[1].append(_WORD.spans(data, starts, ends))
                size += len(codes)
                if size >= FLUSH:
                    yield from (counted(kind, own) for kind, own in enumerate(held))
                    held, size = ([], []), 0
        if held[0]:
            yield from (counted(kind, own) for kind, own in enumerate(held))

    return run


def gather(train: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, count) over all training rows (_text)."""
    counts = train.select("_text").mapInArrow(lean(_gather(order)), "kind tinyint, key long, count long")
    return stored(counts.groupBy("kind", "key").agg(F.sum("count").alias("count")), "op3-counts")


def levels_of(codes: np.ndarray, counts: np.ndarray, orders: range, least: int) -> list[tuple]:
    """Levels of a Trie from counted codes of at least as many bytes: what was seen ``least`` times or more."""
    levels = []
    for k in orders:
        grams, at = np.unique(codes & U64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        own = np.bincount(at, counts, len(grams)).astype(np.int64)
        context, at = np.unique(grams >> U64(8), return_inverse=True)
        full = np.bincount(at, own, len(context)).astype(np.int64)
        held = own >= least
        some = np.bincount(at[held], minlength=len(context)) > 0
        levels.append((grams[held], own[held], context[some], full[some]))
    return levels


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False).view(np.uint64)


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table on the driver, by Arrow: as Python rows they would take some 30 times as much memory."""
    return [c.to_numpy() for c in df.toArrow().columns]


def shorter_levels(grams: DataFrame, order: int, least: int) -> list[tuple]:
    """The levels below LOCAL bytes of context."""
    low = min(LOCAL, order)
    if not low:
        return []
    own = grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * low) - 1)).alias("key")).agg(F.sum("count").alias("count"))
    codes, count = _columns(own)
    return levels_of(codes.view(np.uint64), count, range(low), least)


def heavy_codes_of(grams: DataFrame, least: int, most: int) -> DataFrame:
    """(key, logp) of the most frequent codes: all were seen in their longest context, so none escapes."""
    top = most_frequent(grams.where(F.col("count") >= least), "count", most).withColumn("context", F.shiftright("key", 8))
    full = grams.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("count").alias("full"), F.count_if(F.col("count") >= least).alias("kinds"))
    return top.join(full, "context").select("key", (F.log10("count") - F.log10(F.col("full") + F.col("kinds"))).alias("logp"))


def look_up(wanted: DataFrame, n_wanted: int, grams: DataFrame, n_grams: int, shared, order: int, least: int) -> DataFrame:
    """(_row, log): the sum over (_row, key, times) of times the log probability of the code, from the full counts.

    All contexts of a code that have LOCAL bytes or more end alike, so they are in one part.
    """
    low = min(LOCAL, order)

    def run(batches):
        trie, own, waiting, size = None, [], [], 0

        def settled():
            row, key, times = (np.concatenate(x) for x in zip(*waiting, strict=True))
            rows, at = np.unique(row, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, trie.log_probabilities(key) * times, len(rows)))], names=["_row", "log"])

        for batch in batches:  # counts, whose _row is null, come first
            n = batch.column("_row").null_count
            key, times = _unsigned(batch.column("key")), batch.column("times").to_numpy()
            if n:
                own.append((key[:n], times[:n]))
            if n == len(key):
                continue
            if trie is None:
                codes, counts = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                trie, own = Trie(levels_of(codes, counts, range(low, order + 1), least), _shorter(id(shared.value), shared)), []
            waiting.append((batch.column("_row").slice(n).to_numpy(), key[n:], times[n:]))
            size += len(key) - n
            if size >= 200_000:
                yield settled()
                waiting, size = [], 0
        if waiting:
            yield settled()

    rows = grams.select(F.lit(None).cast("long").alias("_row"), "key", F.col("count").alias("times")).unionByName(wanted.select("_row", "key", "times"))
    parts = max(8, -(-n_grams // PART_CODES), -(-n_wanted // PART_LOOKUPS))
    end = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * low) - 1))
    return rows.repartition(parts, end).sortWithinPartitions(F.col("_row").isNotNull()).mapInArrow(lean(run, "ppm short"), "_row long, log double")


@lru_cache(1)
def _shorter(key: int, shared) -> Trie | None:
    return Trie(shared.value[0]) if shared.value[0] else None


@lru_cache(1)
def _heavy(key: int, shared) -> tuple[Table, np.ndarray, Table, np.ndarray]:
    _, words, counts, codes, logp = shared.value
    return Table(words), np.append(np.log10(counts + 1.0), 0.0), Table(codes), np.append(logp, 0.0)


HELD["ppm short"], HELD["ppm heavy"] = _shorter.cache_clear, _heavy.cache_clear


def _times(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of document and key, and how often each occurs."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])))
    return doc[new], keys[new], np.diff(np.append(new, len(doc)))


def score(docs: DataFrame, train: DataFrame | None = None, *, order: int = ORDER, min_share: float = 0.0, heavy_words: int = HEAVY_WORDS, heavy_codes: int = HEAVY_CODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id under ``id_col``, n_tokens, n_known, train_tokens, base_score and score (log10).

    The model and the word counts come from all rows of ``train`` (default: ``docs``) in columns of the same names. Null
    texts read as empty, whose only token is the end. Rows are scored one by one, so repeated rows score alike; with no
    training rows the counts are 0 and bytes are equally likely. Words are told apart by 64-bit hashes.
    """
    rows = keyed(docs, id_col, text_col)
    train = docs if train is None else train
    counts = gather(train.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")), order)
    words = counts.where("kind = 1").select("key", "count")
    ends = train.count()
    n, v = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    grams = counts.where("kind = 0").select("key", "count")
    n_grams, total = grams.agg(F.count("*"), F.sum("count")).first()
    least = max(1, int(np.ceil((total or 0) * min_share)))
    top, times = _columns(most_frequent(words, "count", heavy_words).select("key", "count"))
    codes_top, logp = _columns(heavy_codes_of(grams, least, heavy_codes))
    value = (shorter_levels(grams, order, least) if total else [], top.view(np.uint64), times, codes_top.view(np.uint64), logp)
    shared = docs.sparkSession.sparkContext.broadcast(value)
    unit = float(np.log10(n + v + 1))
    names = ["kind", "_row", "_id", "n_tokens", "n_known", "base", "score", "key", "times"]

    def run(batches):
        table, logs, code_table, code_logs = _heavy(id(shared.value), shared)

        def apart(kind: int, row: np.ndarray, id_type, doc: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            doc, keys, times = _times(doc, keys)
            m = len(doc)
            blank = [pa.nulls(m, t) for t in (id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.array(row[doc]), *blank, pa.array(keys.view(np.int64)), pa.array(times)], names=names)

        for batch in batches:
            row, ids = batch.column("_row").to_numpy(), batch.column("_id")
            for first, last, data, offsets in chunks(batch.column("_text")):
                codes, bounds = contexts(data, offsets, order)
                at = code_table.find(codes)
                logp = np.append(0, np.cumsum(code_logs[at] if total else np.full(len(codes), -np.log10(256))))
                starts, stops, by_doc = word_bounds(data, offsets)
                keys = _WORD.spans(data, starts, stops)
                place = table.find(keys)
                doc = np.repeat(np.arange(last - first), np.diff(by_doc))
                known = np.bincount(doc[place >= 0], minlength=last - first) + (ends > 0)
                base = np.bincount(doc, logs[place] - np.where(place >= 0, unit, 0), minlength=last - first) + np.log10(ends + 1) - unit
                none = pa.nulls(last - first, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(last - first, np.int8)), pa.array(row[first:last]), ids.slice(first, last - first), pa.array(np.diff(by_doc) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.diff(logp[bounds])), none, none], names=names)
                rare, light = place < 0, np.flatnonzero(at < 0)
                if rare.any():
                    yield apart(1, row[first:last], ids.type, doc[rare], keys[rare])
                if total and len(light):
                    yield apart(2, row[first:last], ids.type, np.searchsorted(bounds, light, "right") - 1, codes[light])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stored(rows.select("_row", "_id", "_text").mapInArrow(lean(run, "ppm heavy"), f"kind tinyint, _row long, _id {kind}, n_tokens long, n_known long, base double, score double, key long, times long"), "op3-scored")
    rare = scored.where("kind = 1").select("_row", "key", "times").join(words, "key", "left")
    rare = rare.select("_row", F.when(F.col("count") > 0, F.col("times")).otherwise(0).alias("more"), (F.col("times") * (F.log10(F.coalesce("count", F.lit(0)) + 1.0) - unit)).alias("rest"), F.lit(0.0).alias("log"))
    wanted = scored.where("kind = 2")
    n_wanted = wanted.count()
    if n_wanted:
        rare = rare.unionByName(look_up(wanted, n_wanted, grams, n_grams, shared, order, least).select("_row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("rest"), "log"))
    rare = rare.groupBy("_row").agg(F.sum("more").alias("more"), F.sum("rest").alias("rest"), F.sum("log").alias("log"))
    out = scored.where("kind = 0").join(rare, "_row", "left")
    zero, none = F.lit(0), F.lit(0.0)
    return out.select(F.col("_id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", none)).alias("base_score"), (F.col("score") + F.coalesce("log", none)).alias("score"))
