"""Exact encoding and decoding with a SentencePiece BPE model, without its own encoder.

The text falls into stretches that no piece crosses. In each, Aho-Corasick finds the longest piece at every position; a
left-to-right walk takes it when it can stand beside the piece before it, else tries shorter ones, else steps back. A
bitfield keeps the positions from which no way on was found, so none is tried twice. Two pieces can stand side by side
when undoing their merges, latest first, never shows a pair at the boundary that would have merged earlier.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import HELD, free_name, lean

SPACE = "▁"
#: About what the stretches that a worker remembers may take; two workers share what the heap leaves of an executor.
CACHE_BYTES = 32 << 20
#: Field numbers of the model file's messages, and its kinds of pieces.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """The (number, value) pairs of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at : at + size]
        at += size


class Model:
    def __init__(self, raw: bytes):
        import struct

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(raw):
            if number == _PIECES:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == _TRAINER:
                trainer = dict(_fields(value))
            elif number == _NORMALIZER:
                normalizer = dict(_fields(value))
        self.add_prefix = bool(normalizer.get(3, 1))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or not trainer.get(35) or trainer.get(24):
            raise ValueError("only BPE models with byte fallback, no character map and kept spaces")
        if USER_DEFINED in self.kinds or any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece is user-defined or runs over the start of a word")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: Order of merging: the higher the score, the earlier.
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        order = sorted(set(scores), reverse=True)
        place = {x: n for n, x in enumerate(order)}
        self.rank = [place[x] for x in scores]
        #: Of each piece, the two pieces its last merge joins; absent for single characters.
        self.halves: dict[int, tuple[int, int]] = {}
        matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1:
                parts = self._merge(piece)
                if parts is None:
                    continue  # merging never makes this piece
                self.halves[i] = parts
            matcher.add_word(piece, (len(piece), i))
        matcher.make_automaton()
        self.matcher = matcher
        self._fits: dict[int, bool] = {}

    def _merge(self, text: str) -> tuple[int, int] | None:
        """The last pair when the characters of a piece merge by rank into the piece itself, else None."""
        parts, last = list(text), None
        while len(parts) > 1:
            pairs = [(self.rank[i], n) for n in range(len(parts) - 1) if (i := self.ids.get(parts[n] + parts[n + 1])) is not None]
            if not pairs:
                return None
            _, n = min(pairs)
            last = (parts[n], parts[n + 1])
            parts[n : n + 2] = ["".join(last)]
        return (self.ids[last[0]], self.ids[last[1]]) if all(x in self.ids for x in last) else None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps the boundary between two neighbouring pieces."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 250_000:
                self._fits.clear()
            known = self._fits[key] = self._boundary_holds(left, right)
        return known

    def _boundary_holds(self, a: int, b: int) -> bool:
        rank, halves, pieces, ids = self.rank, self.halves, self.pieces, self.ids
        horizon = 1 << 60  # merges of this order and later are undone
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and rank[joined] < horizon:
                return False
            in_a, in_b = halves.get(a), halves.get(b)
            if in_a is None and in_b is None:
                return True
            if in_b is None or (in_a is not None and rank[a] > rank[b]):
                horizon, a = rank[a], in_a[1]
            else:  # of equal merges the left one comes first, so a pair at the boundary may come before this one
                horizon, b = rank[b] + 1, in_b[0]

    def _longest(self, text: str) -> list[int] | None:
        """The longest piece at each place, from left to right, if they cover the text and each can stand beside the one
        before: then no step back is needed, as there is one way only to cover a text with pieces that can."""
        out: list[int] = []
        at, before, known = 0, -1, self._fits
        for end, (size, i) in self.matcher.iter_long(text):
            if end + 1 - size != at or (before >= 0 and not (known.get(before << 32 | i) or self.fits(before, i))):
                return None
            out.append(i)
            at, before = end + 1, i
        return out if at == len(text) else None

    def _stretch(self, text: str) -> list[int]:
        """Ids of a stretch; characters that no piece knows become bytes."""
        quick = self._longest(text)
        return self._searched(text) if quick is None else quick

    def _searched(self, text: str) -> list[int]:
        """The same by trying the longest piece first, shorter ones next, and stepping back."""
        n = len(text)
        at_start: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.matcher.iter(text):
            at_start[end - size + 1].append((size, i))
        failed = bytearray((n >> 3) + 1)  # a bit for each position that no way leads on from
        path: list[tuple[int, int, int]] = []  # (start, which of the pieces there, id)
        at, choice = 0, None
        while at < n:
            options = at_start[at]
            if not options:
                path.append((at, 0, -1))
                at += 1
                choice = None
                continue
            choice = len(options) - 1 if choice is None else choice
            before = path[-1][2] if path else -1
            while choice >= 0:
                size, i = options[choice]
                after = at + size
                if not failed[after >> 3] >> (after & 7) & 1 and (before < 0 or self.fits(before, i)):
                    break
                choice -= 1
            if choice >= 0:
                path.append((at, choice, i))
                at += size
                choice = None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, taken, i = path.pop()
                while i < 0:  # an unknown character has no other reading
                    at, taken, i = path.pop()
                choice = taken - 1
        out: list[int] = []
        for start, _, i in path:
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in text[start].encode())
        return out

    def stretches(self, text: str) -> list[str]:
        """The normalised text, cut where a space follows something else."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.add_prefix:
            text = SPACE + text
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.stretches(text or "") for i in self._stretch(part)]

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids: control pieces are silent, runs of byte pieces are read as UTF-8."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(_utf8(bytes(raw)))
        text = "".join(out)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if self.add_prefix and first is not None and self.kinds[first] == NORMAL and text.startswith(" "):
            text = text[1:]
        return text


def _utf8(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that starts no character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Seen:
    """Stretches that a worker has met: their ids as text, and the decoded text of those that don't decode to themselves.

    Two generations of at most half the bytes each: where the younger one is full it becomes the elder, whose stretches
    are forgotten unless they were met again.
    """

    def __init__(self, model: Model):
        self.model, self.ids, self.odd, self.elder, self.elder_odd, self.size = model, {}, {}, {}, {}, 0

    def add(self, part: str) -> str:
        """The ids of a stretch that the younger generation doesn't have."""
        own = self.elder.get(part)
        if own is None:
            ids = self.model._longest(part)
            if ids is None:
                ids = self.model._searched(part)
                if (decoded := _text_of(self.model, ids)) != part.replace(SPACE, " "):
                    self.odd[part] = decoded
            own = ",".join(map(str, ids))
        elif part in self.elder_odd:
            self.odd[part] = self.elder_odd[part]
        self.size += 200 + 2 * len(part) + len(own)
        if len(part) <= 64:
            self.ids[part] = own
        return own

    def age(self, most: int) -> None:
        """Between texts: a text's own stretches stay until it is decoded."""
        if 2 * self.size > most:
            self.elder, self.elder_odd, self.ids, self.odd, self.size = self.ids, self.odd, {}, {}, 0


@lru_cache(2)
def _loaded(name: str) -> Seen:
    with open(SparkFiles.get(name), "rb") as file:
        return Seen(Model(file.read()))


HELD["sentencepiece"] = _loaded.cache_clear


def encode_documents(docs: DataFrame, model_path: str, *, keep: list[str], text_col: str = "text", ids_col: str | None = "ids", digests: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """The columns ``keep`` and the encoding of each text: ids (array<int>) and/or digests (n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no ids and decode to an empty text. Every document is encoded whole, in time that grows
    with its length; a stretch (a word with its space) of up to 64 characters seen before is taken from a cache of about
    ``cache_bytes`` bytes a worker. The model file travels to the executors with the job. Repeated rows give repeated
    results, and no choice between equal merges is left open; columns of the added names are replaced.
    """
    import os

    spark = docs.sparkSession
    spark.sparkContext.addFile(model_path)
    name = os.path.basename(model_path)
    added = ([f"{ids_col} array<int>"] if ids_col else []) + (["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else [])
    names = {a.split()[0] for a in added}
    keep = [c for c in keep if c not in names]
    name_of_text = free_name(keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(name_of_text))
    schema = StructType([*source.drop(name_of_text).schema.fields, *StructType.fromDDL(", ".join(added)).fields])

    def run(batches):
        seen = _loaded(name)
        model, add = seen.model, seen.add
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for text in batch.column(name_of_text).to_pylist():
                seen.age(cache_bytes)
                get = seen.ids.get
                parts = model.stretches(text or "")
                joined = ",".join([get(p) or add(p) for p in parts])
                odd = seen.odd
                if ids_col:
                    out[ids_col].append([int(x) for x in joined.split(",")] if parts else [])
                if digests:
                    decoded = "".join([odd.get(p, p) for p in parts] if odd else parts).replace(SPACE, " ")
                    if model.add_prefix and decoded[:1] == " ":
                        decoded = decoded[1:]
                    out["n_tokens"].append(joined.count(",") + 1 if parts else 0)
                    out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            arrays = [batch.column(c) for c in keep] + [pa.array(out[a.split()[0]], _ARROW[a.split()[1]]) for a in added]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + [a.split()[0] for a in added])

    return source.mapInArrow(lean(run, "sentencepiece"), schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _text_of(model: Model, ids: list[int]) -> str:
    """What the ids of one stretch add to the decoded text; bytes never run on into the next stretch's."""
    prefix, model.add_prefix = model.add_prefix, False
    try:
        return model.decode(ids)
    finally:
        model.add_prefix = prefix
