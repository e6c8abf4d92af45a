"""Vectorised kernels over Arrow text columns: chunking, word bounds, polynomial hashes, sliding minima.

A chunk is a run of whole documents laid end to end: ``data`` holds their UTF-8 bytes and ``offsets``
(one more than there are documents) their bounds. Null texts read as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from ctypes import CDLL
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of the class [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 18


#: What a worker keeps between tasks: how to let go of it, by the name of the operator.
HELD: dict[str, Callable[[], object]] = {}


def lean(run: Callable, keep: str | None = None) -> Callable:
    """``run`` (batches to batches) in a worker that first lets go of what other operators left in it, and in the end of
    memory it has freed.

    Spark hands workers from stage to stage, so tables, caches and free memory would add up in an executor.
    """

    def trim():
        with suppress(OSError, AttributeError):  # where the C library can do that
            CDLL(None).malloc_trim(0)

    def alone(batches):
        held = [clear for name, clear in HELD.items() if name != keep]
        for clear in held:
            clear()
        if held:
            trim()
        yield from run(batches)
        trim()

    return alone


def free_name(taken: list[str], name: str = "_text") -> str:
    """The name, with underscores added until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row exclusive, data, offsets); a longer document makes a chunk of its own."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, values = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per document the bounds of its words (one more than documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    opens = offsets[:-1][offsets[:-1] < n]
    closes = offsets[1:][offsets[1:] > 0] - 1
    first[opens] = inside[opens]
    last[closes] = inside[closes]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of byte spans and of windows of values, from prefix sums.

    Quick, but texts that collide can be constructed whatever the seed, so they only choose candidates, anchors and
    features: a collision may cost work and never decides a result. What decides one is told apart by :class:`Prints`.
    """

    def __init__(self, seed: int, fold_case: bool = False):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        if fold_case:
            self.table[65:91] = self.table[97:123]
        self.base = int(rng.integers(2**40, 2**60)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self._up[:n], self._down[:n]

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums, and the powers that shift a difference of two of them to its start."""
        up, down = self._powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=total[1:])
        return total, down

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte span."""
        sums, down = self.sums(self.table[data])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of ``width`` consecutive values."""
        if len(values) < width:
            return np.zeros(0, np.uint64)
        sums, down = self.sums(values)
        return mix((sums[width:] - sums[:-width]) * down[: len(values) - width + 1])

    def byte_windows(self, data: np.ndarray, width: int) -> np.ndarray:
        return self.windows(self.table[data], width)


_PRIME = U64((1 << 31) - 1)


def _folded(x: np.ndarray) -> np.ndarray:
    """Congruent modulo the prime 2**31 - 1 and much smaller."""
    return (x & _PRIME) + (x >> U64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.where(x >= _PRIME, x - _PRIME, x)


class Prints:
    """62-bit hashes of runs of bytes and windows of values: two polynomials modulo 2**31 - 1, each with a base of its own.

    Two different ones of n units agree with a chance of at most (n / 2**31)**2 over the bases, whatever the texts.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.tables = rng.integers(1, int(_PRIME), (2, 256), dtype=np.uint64)
        self.key = U64(rng.integers(1, 2**63))
        self.bases = [int(b) for b in rng.integers(1 << 20, int(_PRIME) - 1, 2)]
        self._up, self._down = ([np.ones(1, np.uint64)] * 2 for _ in range(2))

    def _powers(self, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up[lane]) < n:
            size, prime = 1 << (n - 1).bit_length(), int(_PRIME)
            for held, base in ((self._up, self.bases[lane]), (self._down, pow(self.bases[lane], -1, int(_PRIME)))):
                powers = np.ones(1, np.uint64)
                while len(powers) < size:
                    powers = np.concatenate([powers, _reduced(powers * U64(pow(base, len(powers), prime)))])
                held[lane] = powers[:size]
        return self._up[lane][:n], self._down[lane][:n]

    def _lane(self, lane: int, values: np.ndarray, width: int) -> np.ndarray:
        """Of values below 2**31, the polynomial of each window."""
        up, down = self._powers(lane, len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(_folded(values * up[:-1]), out=total[1:])
        return _reduced(_reduced(total[width:] - total[:-width]) * down[: len(values) - width + 1])

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each run of bytes."""
        out = np.zeros(len(starts), np.uint64)
        for lane in range(2):
            up, down = self._powers(lane, len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_folded(self.tables[lane][data] * up[:-1]), out=total[1:])
            out = out << U64(31) | _reduced(_reduced(total[ends] - total[starts]) * down[starts])
        return mix(out ^ mix((ends - starts).astype(np.uint64)))

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of ``width`` consecutive values."""
        if len(values) < width:
            return np.zeros(0, np.uint64)
        own = mix(values ^ self.key)
        return mix(self._lane(0, own >> U64(33), width) << U64(31) | self._lane(1, own & _PRIME, width))


class WordHash:
    """64-bit hashes of words: their bytes, eight at a time, stirred into a keyed state that starts with the length.

    The scramble isn't linear, so no text collides by its shape. Words of more than ``LONG`` bytes go through BLAKE2.
    """

    LONG = 256
    _MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, seed: int, fold_case: bool = False):
        rng = np.random.default_rng(seed)
        self.key, self.step = (U64(x) | U64(1) for x in rng.integers(1, 2**63, 2, dtype=np.uint64))
        self.fold_case = fold_case

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte span."""
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[:-8] = LOWER[data] if self.fold_case else data
        eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
        size = ends - starts
        out = mix(self.key ^ (size.astype(np.uint64) * self.step) ^ (eights[starts] & self._MASKS[np.minimum(size, 8)]))
        more, at = np.flatnonzero((size > 8) & (size <= self.LONG)), 8
        while len(more):
            left = size[more] - at
            out[more] = mix((out[more] + self.step) ^ (eights[starts[more] + at] & self._MASKS[np.minimum(left, 8)]))
            more, at = more[left > 8], at + 8
        for i in np.flatnonzero(size > self.LONG):
            out[i] = int.from_bytes(blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(self.key).to_bytes(8)).digest())
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def starts_within(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose window of ``width`` stays inside its document, and the document of each."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(doc)) - before[doc] + offsets[:-1][doc], doc


def anchors(hashes: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers of all windows of ``width`` positions: document, anchor, first and last window start it serves.

    ``hashes[i]`` is the hash of the gram at i. The anchor of a window is its leftmost gram of least hash, so equal
    windows have their anchors at the same place and every window has one. A document's windows that share an anchor
    are consecutive.
    """
    starts, doc = starts_within(offsets, width)
    if not len(starts):
        return doc, starts, starts, starts
    bits = U64(31)  # for places: no string has more bytes; the other 33 order the hashes
    packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(packed, width - gram + 1)[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    return doc[first], anchor[first], starts[first], starts[last]


def merge_runs(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal runs covered by windows of ``width`` at the sorted ``starts``, as rows (start, end)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + width)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + width], axis=1)
