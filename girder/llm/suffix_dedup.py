"""Suffix-array dedup: a distributed, common-prefix-aware merge sort of the suffixes that may repeat.

Suffixes start at anchors (see :mod:`repeats`), so a sparse suffix array suffices. Of anchors with equal surroundings, as
copies have them, one goes on and stands for all. Every task sorts its suffixes into runs and sends them front-coded: of
each suffix only what it doesn't share with the one before. A receiving task merges the runs of its share of grams, dealt
by hash, with a loser tree whose players carry their common prefix with the last winner; two players are compared only
beyond prefixes known to be equal. Suffixes with a common gram come out side by side, with the lengths they share;
sorting what precedes them in the same way gives the lengths shared to the left, and a window repeats where two suffixes
share enough of both. A gram in very many different surroundings is taken apart: each window it serves is a suffix by
itself, dealt by its own bytes, so no task has to hold the gram's; the same merge brings equal ones together.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .cluster import drop_stored, keyed, stored
from .text import Prints, Rolling, anchors, chunks, mix

WIDTH, GRAM = 200, 64
#: A gram in more different surroundings than this goes through the merge window by window.
HOT_ANCHORS = 20_000
RUN_BYTES = 4 << 20
#: What becomes of an anchor: another one stands for it, its suffix is merged, or each of its windows is.
STAYS, SUFFIX, WINDOWS = 0, 1, 2
_GRAM = Rolling(101)
_BLOCK = Prints(102)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two byte strings of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    while known < n:
        size = min(64, n - known)
        x, y = a[known : known + size], b[known : known + size]
        if x != y:
            return known + (size * 8 - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8
        known += size
    return n


#: Of a suffix: common prefix with the one before, length of the rest, length of the left context, row, anchor.
_HEAD = struct.Struct("<HHHqi")


def front_coded(run: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, reversed left context, row, anchor)."""
    out, before = [], b""
    for suffix, left, row, anchor in run:
        lcp = shared_prefix(before, suffix)
        out += [_HEAD.pack(lcp, len(suffix) - lcp, len(left), row, anchor), suffix[lcp:], left]
        before = suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(common prefix with the one before, suffix, left, row, anchor) of a front-coded run."""
    at, suffix = 0, b""
    while at < len(run):
        lcp, rest, left, row, anchor = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        suffix = suffix[:lcp] + run[at : at + rest]
        at += rest
        yield lcp, suffix, run[at : at + left], row, anchor
        at += left


def merged(runs: list[Iterator]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """Merge sorted runs with a loser tree; the first field is the common prefix with the suffix before.

    Node n holds the loser of its match and that loser's common prefix with the winner. On a replay both players know
    their common prefix with the same last winner: the longer one wins unseen; only equal ones are compared, from there.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0 if h else -1 for h in heads]  # with the last winner; -1 for a run that is over
    tree = [-1] * k  # losers

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix becomes that with the winner."""
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        x, y = heads[a][1], heads[b][1]
        n = shared_prefix(x, y, lcp[a])
        first, second = (b, a) if n < len(x) and (n == len(y) or y[n] < x[n]) else (a, b)
        lcp[second] = n
        return first, second

    def build(node: int) -> int:
        if node >= k:
            return node - k
        first, second = play(build(2 * node), build(2 * node + 1))
        tree[node] = second
        return first

    winner = build(1) if k > 1 else 0
    while lcp[winner] >= 0:
        yield (lcp[winner], *heads[winner][1:])
        head = heads[winner] = next(runs[winner], None)
        lcp[winner] = head[0] if head else -1
        node = (k + winner) // 2
        while node:
            other = tree[node]
            if lcp[winner] > lcp[other]:
                pass
            elif lcp[winner] < lcp[other]:
                winner, tree[node] = other, winner
            else:
                winner, tree[node] = play(winner, other)
            node //= 2


def repeated_starts(group: list[tuple[int, bytes, bytes, int, int]], width: int) -> Iterator[tuple[int, int, int]]:
    """(row, first start, last start) of the windows that repeat among suffixes (sorted) that share a gram.

    Equal suffixes with equal left contexts repeat as far as both reach; one of them stands for all beside the others.
    Two suffixes that share R bytes and, to the left, L bytes share the windows that start R - width to L bytes before.
    """
    kinds: list[tuple[int, bytes, bytes, list[tuple[int, int]]]] = []
    at: dict[bytes, int] = {}
    gap = 1 << 16
    for lcp, suffix, left, row, anchor in group:
        gap = min(gap, lcp)
        if kinds and not (gap == len(suffix) == len(kinds[-1][1])):
            at = {}
        if left in at:
            kinds[at[left]][3].append((row, anchor))
            continue
        at[left] = len(kinds)
        kinds.append((gap if kinds else 0, suffix, left, [(row, anchor)]))
        gap = 1 << 16
    if len(kinds) == 1 and len(kinds[0][3]) == 1:
        return
    whole = [len(members) > 1 for *_, members in kinds]
    for (_, suffix, left, members), many in zip(kinds, whole, strict=True):
        if many:
            for row, anchor in members:
                yield row, anchor - len(left), anchor + len(suffix) - width
    if all(whole):
        return
    if len(kinds) == 2:
        (_, _, left, own), (right, _, other, theirs) = kinds
        both = shared_prefix(left, other)
        if both + right >= width:
            for members, many in ((own, whole[0]), (theirs, whole[1])):
                if not many:
                    yield members[0][0], members[0][1] - both, members[0][1] + right - width
        return
    lcps = np.array([k[0] for k in kinds], np.int32)
    order = sorted(range(len(kinds)), key=lambda i: kinds[i][2])
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    lefts = np.array([0] + [shared_prefix(kinds[a][2], kinds[b][2]) for a, b in zip(order, order[1:], strict=False)], np.int32)

    def with_all(shared: np.ndarray, i: int) -> np.ndarray:
        """Common prefix of sorted string i with each, from those of neighbours."""
        out = np.full(len(shared), 1 << 14, np.int32)
        out[i + 1 :] = np.minimum.accumulate(shared[i + 1 :])
        out[:i] = np.minimum.accumulate(shared[i:0:-1])[::-1]
        return out

    for i, (_, _, _, members) in enumerate(kinds):
        if whole[i]:
            continue
        right, left = with_all(lcps, i), with_all(lefts, int(place[i]))[place]
        fits = right + left >= width
        fits[i] = False
        if not fits.any():
            continue
        spans = np.unique(np.stack([-left[fits], right[fits] - width], axis=1), axis=0).tolist()
        row, anchor = members[0]
        low, high = spans[0]
        for start, end in spans[1:]:
            if start > high + 1:
                yield row, anchor + low, anchor + high
                low = start
            high = max(high, end)
        yield row, anchor + low, anchor + high


def groups(stream: Iterator, gram: int) -> Iterator[list]:
    """Consecutive suffixes that share a gram."""
    own: list = []
    for item in stream:
        if own and item[0] < gram:
            yield own
            own = []
        own.append(item)
    if own:
        yield own


def equal_windows(stream: Iterator, width: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, start) of the windows that come more than once in a sorted stream of them; only one is held."""
    before = None
    for lcp, _, _, row, start in stream:
        if lcp < width:
            before = row, start, start
            continue
        if before:
            yield before
            before = None
        yield row, start, start


def _candidates(width: int, gram: int):
    def find(column):
        for at, _, data, offsets in chunks(column):
            hashes = _GRAM.byte_windows(data, gram)
            doc, anchor, first, last = anchors(hashes, offsets, width, gram)
            if len(doc):
                low = offsets[doc]
                block = _BLOCK.runs(data, first, last + width) ^ mix((anchor - first).astype(np.uint64))
                yield at, doc, anchor - low, first - low, last - low, hashes[anchor], block

    return find


def _columns(asked, n_bytes, n_removed, runs, kept, digests) -> dict[str, pa.Array]:
    ok = lambda x: [v if a else None for v, a in zip(x, asked, strict=True)]
    return {
        "n_bytes": pa.array(ok(n_bytes), pa.int64()),
        "n_removed": pa.array(ok(n_removed), pa.int64()),
        "removed_runs": pa.array(ok(runs), pa.list_(pa.list_(pa.int32()))),
        ("kept_sha256" if digests else "kept"): pa.array(ok([hashlib.sha256(k).hexdigest() for k in kept] if digests else kept), pa.string() if digests else pa.binary()),
    }


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, hot_anchors: int = HOT_ANCHORS, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row of ``docs``: its id under ``id_col``, n_bytes, n_removed, removed_runs (maximal [start, end) byte positions)
    and kept (the remaining UTF-8 bytes; a cut may fall inside a character) or, with ``digests``, kept_sha256.

    A byte goes when a string of ``width`` bytes of its document covers it that also starts anywhere else. Null and empty
    texts have no bytes; texts shorter than ``width`` lose nothing; repeated rows are copies and lose every such string;
    null ids are kept apart by row. What is removed rests on bytes compared in the merge, but for anchors whose surroundings
    are equal by 62 bits of hashes modulo a prime, of which one is merged. Grams in more
    than ``hot_anchors`` different surroundings are merged window by window, with the same results.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    table = repeats.anchor_table(rows, _candidates(width, gram), ", block long", "op1-anchors")
    twice = stored(repeats.repeated_keys(table, "gram").select("gram"), "op1-repeated")
    again = stored(table.join(twice, "gram", "left_semi"), "op1-again")
    drop_stored(table, twice)
    copies = again.groupBy("gram", "block").agg(F.count("*").alias("_n"), F.min(F.struct("_row", "anchor")).alias("_one")).where("_n > 1").drop("_n")
    copies = stored(copies, "op1-copies", small=True)
    one = again.join(copies, ["gram", "block"], "left").select("_row", "anchor", "first", "last", "gram", F.col("_one").isNotNull().alias("whole"), F.coalesce(F.col("_one") == F.struct("_row", "anchor"), F.lit(True)).alias("goes"))
    one = stored(one, "op1-one")
    drop_stored(again, copies)
    hot = stored(one.where("goes").groupBy("gram").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_anchors).select("gram", F.lit(True).alias("hot")), "op1-hot", small=True)
    way = F.when(~F.col("goes"), STAYS).when(F.col("hot").isNotNull(), WINDOWS).otherwise(SUFFIX).alias("way")
    again = one.join(hot, "gram", "left").select("_row", "anchor", "first", "last", way)
    schema = f"n_bytes long, n_removed long, removed_runs array<array<int>>, {'kept_sha256 string' if digests else 'kept binary'}"

    def whole(texts, asked):
        raw = [(t or "").encode() for t in texts]
        return _columns(asked, [len(r) for r in raw], [0] * len(raw), [[] for _ in raw], raw, digests)

    beside = repeats.beside_candidates(rows, again, ["anchor", "first", "last", "way"], whole, schema, "op1-beside")
    copied = stored(one.where("whole").select("_row", F.col("first").alias("start"), F.col("last").alias("end")), "op1-copied", small=True)
    drop_stored(one, hot)
    asked = beside.where(F.col("_candidates").isNotNull()).select("_row", "_text", "_candidates")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked.rdd.getNumPartitions())

    def dealt(key: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest()) % parts

    def runs(batches):
        mine: dict[int, list] = {}
        size = 0

        def flush():
            keys = sorted(mine)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([front_coded(sorted(mine[k])) for k in keys], pa.binary())], names=["part", "run"])
            mine.clear()

        for batch in batches:
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("_row", "_text", "_candidates")), strict=True):
                raw = text.encode()
                for c in found:
                    anchor, first, last = c["anchor"], c["first"], c["last"]
                    if c["way"] == SUFFIX:
                        suffix = raw[anchor : last + width]
                        mine.setdefault(dealt(suffix[:gram]), []).append((suffix, raw[first:anchor][::-1], row, anchor))
                        size += last + width - first
                    elif c["way"] == WINDOWS:
                        for at in range(first, last + 1):
                            window = raw[at : at + width]
                            mine.setdefault(parts + dealt(window), []).append((window, b"", row, at))
                        size += (last + 1 - first) * width
                if size > RUN_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(key, table):
        stream = merged([decoded(r) for r in table.column("run").to_pylist()])
        found = equal_windows(stream, width) if key[0].as_py() >= parts else (r for group in groups(stream, gram) if len(group) > 1 for r in repeated_starts(group, width))
        out: tuple[list, list, list] = ([], [], [])
        for one in found:
            for values, x in zip(out, one, strict=True):
                values.append(x)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["_row", "start", "end"])

    met = asked.mapInArrow(runs, "part int, run binary").repartition(2 * parts, "part").groupBy("part").applyInArrow(merge, "_row long, start int, end int")
    found = stored(met.unionByName(copied), "op1-runs")
    drop_stored(copied)

    def cutter(texts, found):
        raws = [(t or "").encode() for t in texts]
        removed, runs, kept = [], [], []
        for raw, own in zip(raws, found, strict=True):
            spans = repeats.covered(own, width).tolist()
            stay, at = [], 0
            for start, end in spans:
                stay.append(raw[at:start])
                at = end
            stay.append(raw[at:])
            kept.append(b"".join(stay))
            removed.append(len(raw) - len(kept[-1]))
            runs.append(spans)
        return _columns([True] * len(raws), [len(r) for r in raws], removed, runs, kept, digests)

    columns = [f.split()[0] for f in schema.split(", ")]
    return repeats.cut(beside, found, columns, schema, cutter).withColumnRenamed("_id", id_col)
