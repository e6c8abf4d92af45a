"""N-gram Jaccard join: sets of word shingles that are alike, by a size-aware heavy-light plan.

Shingles are ordered with those of long inverted lists (the heavy ones, a bounded list) last, others by hash. Of a set
of n shingles any partner shares at least o = ceil(t n), so two partners share a shingle among their first n - o + 1, and
two of them among their first n - o + 2. Small sets enumerate the pairs of that beginning and meet in equal pairs; large
sets, and the small ones just below the boundary, meet in the inverted lists of single shingles. The boundary is the
size up to which a set has fewer pairs than its lists are expected to hold postings.

Sets that meet under a key are first checked against one hub per key and size, the set with the most shingles that many
sets have, since what it is linked with becomes one component. Hubs among those left outside a key's largest component
follow, for keys with far more pairs of different components than postings, while that joins sets. The pairs still apart meet
in a join whose condition compares parity sketches, so what can't be alike never becomes a row. All that pass are
checked by their shingles, which 62-bit hashes modulo a prime tell apart.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import components, drop_stored, keyed, merged_components, most_frequent, numbered, steady, stored
from .repeats import repeated_keys
from .text import Prints, U64, WordHash, chunks, free_name, lean, mix, word_bounds

WORDS, PERCENT = 5, 75
SKETCH = 512
#: Longs of a parity sketch.
PARITY = 16
#: Most sets whose numbers are broadcast to texts, sketches and postings; of more, those are exchanged.
CHOSEN = 1_000_000
#: Most rounds of further hubs, and the pairs a posting from which a key gets one; both change the cost, not the links.
HUB_ROUNDS, CROWDED = 4, 16
#: Longest inverted lists that are put last in the order; only an order, so any list of them gives the same links.
HEAVY = 100_000
_WORD, _SHINGLE = WordHash(701, fold_case=True), Prints(702)


def least_overlap(n, percent: int = PERCENT):
    return -(-percent * n // 100)


def shingle_sets(column: pa.Array, words: int = WORDS):
    """Per document its sorted distinct shingle hashes; a text of fewer words has one, a text without words none."""
    for _, _, data, offsets in chunks(column):
        starts, ends, bounds = word_bounds(data, offsets)
        hashes = _WORD.spans(data, starts, ends)
        grams = _SHINGLE.windows(hashes, words)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield _SHINGLE.windows(hashes[a:b], b - a)
            else:
                yield hashes[:0]


def sketch(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall into each of SKETCH ranges of the hash; None where one holds more than a byte can say.

    Two sets share at most the sum of the lesser counts, which rules out most pairs that aren't alike.
    """
    counts = np.bincount((shingles >> U64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def parity(shingles: np.ndarray) -> np.ndarray:
    """Of each of 64 * PARITY ranges of a scrambled hash, whether an odd number of shingles falls into it.

    The sketches of two sets differ in no more bits than shingles are in one set alone.
    """
    odd = np.bincount((mix(shingles) >> U64(64 - (64 * PARITY).bit_length() + 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), signed=True)


def _survey(words: int):
    """Rows of sets (_row, n, sid, sketch, parity) and of shingles that are frequent within some megabytes (shingle, seen)."""
    names = ["_row", "n", "sid", "sketch", "parity", "shingle", "seen"]

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        value = np.unique(every[:-3][every[3:] == every[:-3]]) if len(every) > 3 else every[:0]
        count = np.searchsorted(every, value, "right") - np.searchsorted(every, value)
        none = [pa.nulls(len(value), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*none, pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names=names)

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ns, sids, sketches, odd = [], [], [], []
            for own in shingle_sets(batch.column("_text"), words):
                ns.append(len(own))
                sids.append(set_id(own))
                sketches.append(sketch(own))
                odd.append(parity(own))
                held.append(own)
                size += len(own)
                if size > 3_000_000:
                    yield frequent(held)
                    held, size = [], 0
            n = len(ns)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PARITY), pa.array(np.concatenate(odd) if odd else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(ns, pa.int32()), pa.array(sids, pa.int64()), pa.array(sketches, pa.binary()), lists, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
        if held:
            yield frequent(held)

    return run


def boundary(heavy_counts: np.ndarray, percent: int = PERCENT) -> int:
    """The largest size whose pairs are no more than the postings its lists are expected to hold."""
    mean = float((heavy_counts**2).sum() / heavy_counts.sum()) if len(heavy_counts) else 2.0
    mean = min(max(math.sqrt(mean), 2.0), 8.0)
    best = 4
    for n in range(4, 200):
        p = n - least_overlap(n, percent) + 1
        if (p + 1) * p / 2 <= mean * p:
            best = n
    return best


def _postings(heavy, small: int, words: int, percent: int):
    """Rows (key, sid, n, pos, core) of every set: single shingles (pos from 0) and, of small sets, pairs (pos -1).

    ``core`` says how many of a thousand of the set's shingles are heavy ones.
    """

    def run(batches):
        value, rank = heavy.value
        for batch in batches:
            keys, sids, ns, places, cores = [], [], [], [], []
            for own in shingle_sets(batch.column("_text"), words):
                n = len(own)
                if not n:
                    continue
                sid, o = set_id(own), least_overlap(n, percent)
                at = np.minimum(np.searchsorted(value, own), max(len(value) - 1, 0))
                known = value[at] == own if len(value) else np.zeros(n, bool)
                core = int(1000 * known.sum() // n)
                if known.any():
                    last = own[known][np.lexsort((own[known], rank[at[known]]))]
                    own = np.concatenate([own[~known], last])
                if n <= small and o >= 2:
                    begin = own[: n - o + 2]
                    i, j = np.triu_indices(len(begin), 1)
                    a, b = np.minimum(begin[i], begin[j]), np.maximum(begin[i], begin[j])
                    keys.append(mix(a * U64(0x9E3779B97F4A7C15) + mix(b + U64(1))))
                    places.append(np.full(len(i), -1, np.int32))
                    cores.append(np.full(len(i), core, np.int16))
                    sids.append(np.full(len(i), sid))
                    ns.append(np.full(len(i), n, np.int32))
                if n > small or n >= least_overlap(small + 1, percent):
                    begin = own[: n - o + 1]
                    keys.append(begin)
                    places.append(np.arange(len(begin), dtype=np.int32))
                    cores.append(np.full(len(begin), core, np.int16))
                    sids.append(np.full(len(begin), sid))
                    ns.append(np.full(len(begin), n, np.int32))
            if keys:
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(sids), np.concatenate(ns), np.concatenate(places), np.concatenate(cores)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "sid", "n", "pos", "core"])

    return run


def _possible(a: str, b: str, percent: int):
    """Whether sizes and places allow the overlap; true at the first shingle two partners share."""
    na, nb, pa_, pb = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    sizes = (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    need = F.lit(percent) * (na + nb)
    rest = F.lit(1) + F.least(na - pa_ - 1, nb - pb - 1)
    return sizes & ((pa_ < 0) | (rest * (100 + percent) >= need))


def _may_be_alike(percent: int):
    """Of pairs with sizes and sketches, those whose sketches allow the overlap."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            both = np.minimum(na, nb)
            x, y = batch.column("x"), batch.column("y")
            known = np.flatnonzero(~(np.asarray(x.is_null()) | np.asarray(y.is_null())))
            if len(known):
                left, right = (np.frombuffer(b"".join(c.take(pa.array(known)).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (x, y))
                both[known] = np.minimum(left, right).sum(axis=1)
            keep = 100 * both >= percent * (na + nb - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _parities_allow(percent: int):
    """Whether the parity sketches of two postings (p0.., q0..) of n and m shingles leave room for the overlap."""
    differ = F.bit_count(F.col("p0").bitwiseXOR(F.col("q0")))
    for i in range(1, PARITY):
        differ += F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}")))
    # With d shingles in one set alone, the overlap is (n + m - d) / 2 and the union (n + m + d) / 2.
    return F.lit(100) * (F.col("n") + F.col("m") - differ) >= F.lit(percent) * (F.col("n") + F.col("m") + differ)


def links(postings: DataFrame, sketches: DataFrame, sets_of, percent: int, rounds: int = HUB_ROUNDS) -> DataFrame | None:
    """Components (node, component) of the sets that are alike; sets without a partner don't appear.

    ``sketches`` has (sid, n, sketch, parity) of every set; ``sets_of(ids)`` gives (sid, shingles) for a table of sids.
    """
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int")

    def alike(pairs: DataFrame) -> DataFrame:
        """The links (a, b) among candidate pairs."""
        ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        wanted = sketches.select("sid", "n", "sketch").join(F.broadcast(ids) if pairs.count() <= CHOSEN // 2 else ids, "sid", "left_semi")
        one = wanted.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
        two = wanted.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
        left = stored(pairs.join(one, "a").join(two, "b").mapInArrow(lean(_may_be_alike(percent)), "a long, b long"), "op7-likely", small=True)
        sets = sets_of(left.select(F.col("a").alias("sid")).union(left.select("b")).distinct())
        one, two = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
        exact = left.join(one, "a").join(two, "b").withColumn("o", F.size(F.array_intersect("x", "y")))
        out = stored(exact.where(F.lit(100) * F.col("o") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("o"))).select("a", "b"), "op7-links")
        drop_stored(left, sets)
        return out

    def to_hubs(own: DataFrame) -> DataFrame:
        """Of postings, each set beside the hub that it meets under the most keys."""
        hubs = own.groupBy("key", band.alias("band")).agg(F.min(F.struct(-F.col("core"), "sid", "n", "pos", "component")).alias("b"))
        near = own.withColumn("band", F.explode(F.array(band, band - 1, band + 1))).join(hubs, ["key", "band"]).select(F.struct("sid", "n", "pos", "component").alias("a"), "b")
        near = near.where((F.col("a.component") != F.col("b.component")) & _possible("a", "b", percent))
        votes = near.groupBy(F.col("a.sid").alias("s"), F.col("b.sid").alias("hub")).agg(F.count("*").alias("votes"))
        best = votes.groupBy("s").agg(F.max(F.struct("votes", "hub")).alias("top"))
        return best.select(F.least("s", "top.hub").alias("a"), F.greatest("s", "top.hub").alias("b")).distinct()

    def mixed(own: DataFrame) -> DataFrame:
        """(key, largest, crowded) of the keys with several components: the largest one, and whether pairs of different
        ones far outnumber the postings."""
        sizes = own.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
        crowded = (F.col("all") * F.col("all") - F.col("same")) / 2 > CROWDED * F.col("all")
        return sizes.where("top.m < all").select("key", F.col("top.component").alias("largest"), crowded.alias("crowded"))

    def named(own: DataFrame, labels: DataFrame) -> DataFrame:
        labels = labels.select(F.col("node").alias("sid"), "component")
        labels = F.broadcast(labels) if labels.count() <= CHOSEN else labels
        return own.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))

    candidates = stored(to_hubs(postings.withColumn("component", F.col("sid"))), "op7-candidates", small=True)
    parts = components(alike(candidates))
    drop_stored(candidates)
    apart = named(postings, parts)
    several = stored(mixed(apart), "op7-mixed", small=True)
    apart = stored(apart.join(several, "key"), "op7-apart", small=True)
    drop_stored(several)
    own, crowd = apart, apart.where("crowded")
    for _ in range(rounds):
        if not crowd.head(1):
            break
        more = alike(stored(to_hubs(crowd.where("component <> largest")), "op7-candidates", small=True))
        if not more.head(1):
            break
        parts = merged_components(parts, more)
        crowd = named(crowd.drop("component", "largest", "crowded"), parts)
        crowd = stored(crowd.join(mixed(crowd).where("crowded"), "key"), "op7-crowd", small=True)
        own = named(apart.drop("component"), parts)
    bits = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY)]
    own = own.join(sketches.select("sid", *bits), "sid").select("key", "sid", "n", "pos", "component", *[f"p{i}" for i in range(PARITY)])
    beside = own.toDF("key2", "sid2", "m", "pos2", "component2", *[f"q{i}" for i in range(PARITY)])
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    rest = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("m") - F.col("pos2") - 1)
    places = (F.col("pos") < 0) | (rest * (100 + percent) >= percent * (F.col("n") + F.col("m")))
    meet = own.join(beside, (F.col("key") == F.col("key2")) & (F.col("sid") < F.col("sid2")) & (F.col("component") != F.col("component2")) & sizes & places & _parities_allow(percent))
    last = alike(stored(meet.select(F.col("sid").alias("a"), F.col("sid2").alias("b")).distinct(), "op7-candidates"))
    return merged_components(parts, last) if last.head(1) else parts


def clustered(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _id, n, component, component_id): rows of one component share ``component``, which is null without shingles."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    survey = stored(rows.select("_row", "_text").mapInArrow(lean(_survey(words)), "_row long, n int, sid long, sketch binary, parity array<bigint>, shingle long, seen long"), "op7-survey")
    counts = stored(survey.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen")), "op7-heavy", small=True)
    heavy = most_frequent(counts, "seen", HEAVY).toArrow()
    drop_stored(counts)
    value, seen = heavy["shingle"].to_numpy().view(np.uint64), heavy["seen"].to_numpy()
    order = np.argsort(value)
    shared = spark.sparkContext.broadcast((value[order], seen[order]))
    small = boundary(seen.astype(float), percent)
    postings = stored(rows.select("_text").mapInArrow(lean(_postings(shared, small, words, percent)), "key long, sid long, n int, pos int, core short"), "op7-postings")
    # Keys are counted first with nothing beside them; copies of one set make some more keys pass, which go next.
    twice = stored(repeated_keys(postings, "key").select("key"), "op7-repeated", small=True)
    met = stored(postings.join(twice, "key", "left_semi").distinct(), "op7-met")
    drop_stored(twice)
    alone = met.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("key")
    met = stored(met.join(stored(alone, "op7-keys", small=True), "key", "left_semi"), "op7-met")
    drop_stored(postings)
    sets_of = survey.where("shingle IS NULL").select("_row", "n", "sid")
    sketches = stored(survey.where("shingle IS NULL").join(met.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")), "op7-sketches")

    def shingles(batches):
        for batch in batches:
            own = [s.view(np.int64) for s in shingle_sets(batch.column("_text"), words)]
            bounds = np.append(0, np.cumsum([len(s) for s in own])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("sid"), lists], names=["sid", "shingles"])

    def with_shingles(ids: DataFrame) -> DataFrame:
        """Only texts of sets whose pairs are likely are read for their shingles, in place where a list of them can travel."""
        chosen = stored(sketches.join(ids, "sid", "left_semi").select("sid", "_row"), "op7-chosen", small=True)
        few = chosen.count() <= CHOSEN
        return stored(rows.join(F.broadcast(chosen) if few else chosen, "_row").select("sid", "_text").mapInArrow(lean(shingles), "sid long, shingles array<bigint>"), "op7-sets")

    parts = links(met, sketches, with_shingles, percent)
    named = rows.select("_row", "_id").join(sets_of, "_row")
    lone = F.col("n") == 0
    nodes = named.where(~lone).groupBy("sid").agg(F.min("_id").alias("least"))
    nodes = nodes.join(parts.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = nodes.join(least, "component").select("sid", "component", "component_id")
    return named.join(by_set, "sid", "left").select("_row", "_id", "n", F.when(~lone, F.col("component")).alias("component"), F.when(lone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def cluster(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id under ``id_col``, n_shingles and component_id, the least id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their sets of ``words``-word shingles (A-Z in lower
    case; fewer words make one shingle). Null, empty and blank texts have no shingle and link with nothing, so
    component_id is their own id. Rows with equal sets, repeated rows included, are one node; null ids never are the
    least unless no other is there. No partner is given up: hubs only spare checks inside a
    component, sketches only pairs that they prove unlike.
    """
    out = clustered(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component: the one of least id, of equal ids the first row.

    Rows without shingles link with nothing and all stay.
    """
    docs = steady(docs)
    out = clustered(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    first = out.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row")).alias("f"))
    stay = first.select(F.col("f._row").alias("_row")).unionByName(out.where("component IS NULL").select("_row"))
    row = free_name(docs.columns, "_row")
    return numbered(docs, row).join(stay.withColumnRenamed("_row", row), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
