"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Documents stream through the automaton word by word; it always knows the longest suffix read so far that occurs in
some item. Where that suffix reaches the window length, its last words are hit. Spans of hit words are removed where
they exceed a length, or where all of them exceed a share of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lean

WINDOW = 13
#: Words of items in one automaton, which takes about a kilobyte a word in a worker.
BLOCK_WORDS = 200_000
#: Words of a benchmark passage that is removed whatever its share of the document.
LONGEST = 50
#: Bytes that separate words, and the fold of A-Z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """Of the word sequences of items; one state stands for substrings that end at the same places."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.items: list[set[str]] = [set() for _ in self.next]
        #: Per state, the whole items shorter than a window that end there: (words, item).
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for name, sequence in items:
            state = 0
            for word in sequence:
                state = self.next[state][word]
                up = state
                while up > 0 and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
            if 0 < len(sequence) < window:
                self.short[state].append((len(sequence), name))
        self.shortest = min([window, *(n for own in self.short for n, _ in own)])
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[state] = sorted(set(self.short[state] + self.short[self.link[state]]))

    def _new(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """The state for what leads from ``state`` to ``target`` when the target also holds longer substrings."""
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, word, self.next[last][word])
        return state

    def scan(self, sequence: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal runs of hit words as [start, end], and the items with a window among them."""
        after, link, length, window, shortest = self.next, self.link, self.length, self.window, self.shortest
        state = matched = 0
        runs: list[list[int]] = []
        found: set[str] = set()
        for i, word in enumerate(sequence):
            target = after[state].get(word)
            if target is None:
                while state and target is None:
                    state = link[state]
                    target = after[state].get(word)
                if target is None:
                    matched = 0
                    continue
                matched = length[state]
            state = target
            matched += 1
            if matched < shortest:
                continue
            hit = 0
            if matched >= window:
                hit, up = window, state
                while length[link[up]] >= window:
                    up = link[up]
                found |= self.items[up]
            for n, name in self.short[state]:
                if n <= matched:
                    hit = max(hit, n)
                    found.add(name)
            if hit:
                if runs and runs[-1][1] >= i + 1 - hit:
                    runs[-1][0] = min(runs[-1][0], i + 1 - hit)
                    runs[-1][1] = i + 1
                    while len(runs) > 1 and runs[-2][1] >= runs[-1][0]:
                        start, end = runs.pop()
                        runs[-1] = [min(runs[-1][0], start), end]
                else:
                    runs.append([i + 1 - hit, i + 1])
        return runs, found


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words (an item alone may be longer), streamed to the driver one by one."""
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    rows = items.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`"))
    for name, text in rows.toLocalIterator():
        sequence = words(text)
        if not sequence:
            continue
        if block and size + len(sequence) > block_words:
            yield block
            block, size = [], 0
        block.append((name, sequence))
        size += len(sequence)
    if block:
        yield block


def shared_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> list:
    """A broadcast per block: the driver holds one block at a time, and of all others what Spark stores of a broadcast."""
    context = items.sparkSession.sparkContext
    return [context.broadcast(block) for block in item_blocks(items, item_col, text_col, block_words)]


def _by_name(names: set) -> list:
    """Sorted, the items without a name last."""
    return sorted(names, key=lambda x: (x is None, x or ""))


def find_hits(docs: DataFrame, items: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, blocks: list | None = None) -> DataFrame:
    """The columns ``keep`` (default all) of each document, and hit_words (all its words), hit_runs (array of [start, end)
    word positions), hit_items (sorted ids).

    Words are folded and split as the contract says; a null text has none, and with no items nothing is hit. Repeated
    rows are judged alike. Items of one id count as one; items whose id is null count as one, named null and last. Columns that ``docs`` already has under the three names are replaced. The items are a query
    set taken in blocks of ``block_words`` words, which bounds every automaton and broadcast; each block is one more
    pass over the rows in the same stage.
    """
    own = ("hit_words", "hit_runs", "hit_items")
    rest = [c for c in docs.columns if c not in own]
    keep = [c for c in (keep or rest) if c not in own]
    carried = list(dict.fromkeys([*keep, text_col]))
    out = docs.select(*[F.col(f"`{c}`") for c in carried], F.lit(0).cast("long").alias("hit_words"), F.array().cast("array<array<bigint>>").alias("hit_runs"), F.array().cast("array<string>").alias("hit_items"))
    last = out.select(*[F.col(f"`{c}`") for c in keep], *own).schema
    blocks = blocks if blocks is not None else shared_blocks(items, item_col, item_text_col, block_words)
    blocks = blocks or [docs.sparkSession.sparkContext.broadcast([])]
    for i, shared in enumerate(blocks):
        schema = last if i == len(blocks) - 1 else out.schema
        out = out.mapInArrow(lean(_scanner(shared, text_col, window, schema.names)), schema)
    return out


def _scanner(shared, text_col: str, window: int, names: list[str]):
    def scan(batches):
        automaton = SuffixAutomaton(shared.value, window)
        for batch in batches:
            texts, old_runs, old_items = (batch.column(c).to_pylist() for c in (text_col, "hit_runs", "hit_items"))
            counts, runs, found = [], [], []
            for text, run, before in zip(texts, old_runs, old_items, strict=True):
                sequence = words(text)
                new, more = automaton.scan(sequence)
                counts.append(len(sequence))
                runs.append(union_runs(run + new) if run else new)
                found.append(_by_name(more.union(before)))
            yield replaced(batch, {"hit_words": counts, "hit_runs": runs, "hit_items": found}).select(names)

    return scan


def replaced(batch: pa.RecordBatch, values: dict[str, list]) -> pa.RecordBatch:
    columns = [pa.array(values[f.name], f.type) if f.name in values else batch.column(i) for i, f in enumerate(batch.schema)]
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def union_runs(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut_words(text: str, runs: list[list[int]]) -> str:
    """The text without the words of the runs and what lies between them; what is left is joined by a space."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for start, end in runs:
        kept.append(raw[at : spans[start][0]].strip())
        at = spans[end - 1][1]
    kept.append(raw[at:].strip())
    return b" ".join(x for x in kept if x).decode()


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.05, longest: int = LONGEST, drop_coverage: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without benchmark passages, in the columns they came with, whatever their names.

    A document whose hit words are at least ``coverage`` of its words loses them; otherwise it loses the runs of more
    than ``longest`` hit words. That is done again and again, until what is left stays under both limits. From
    ``drop_coverage`` on, or when no word is left, the document goes. Others stay as they are, null and empty texts
    included; repeated rows are treated alike; with no items nothing changes.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)
    blocks = shared_blocks(items, item_col, item_text_col, block_words)
    one = len(blocks) < 2  # then a document is scanned and cut in one go
    source = plain if one else find_hits(plain, items, text_col=text, window=window, blocks=blocks)

    def cut(batches):
        automata: list[SuffixAutomaton] = [SuffixAutomaton(blocks[0].value, window)] if one and blocks else []

        def hits(text: str | None) -> tuple[int, list[list[int]]]:
            sequence = words(text)
            return len(sequence), union_runs([run for automaton in automata for run in automaton.scan(sequence)[0]])

        def beyond(hit: list[list[int]], total: int) -> list[list[int]]:
            if sum(e - s for s, e in hit) >= coverage * total:
                return hit
            return [[s, e] for s, e in hit if e - s > longest]

        for batch in batches:
            texts = batch.column(text).to_pylist()
            first = map(hits, texts) if one else zip(*(batch.column(c).to_pylist() for c in ("hit_words", "hit_runs")), strict=True)
            keep, changed = [], False
            for i, (total, hit) in enumerate(first):
                n, any_hit = sum(e - s for s, e in hit), bool(hit)
                if n and n >= drop_coverage * total:
                    keep.append(False)
                    continue
                while hit and (gone := beyond(hit, total)):
                    automata = automata or [SuffixAutomaton(block.value, window) for block in blocks]
                    texts[i], changed = cut_words(texts[i], gone), True
                    total, hit = hits(texts[i])
                keep.append(total > 0 or not any_hit)
            out = replaced(batch, {text: texts}) if changed else batch
            yield out.filter(pa.array(keep, pa.bool_())).select(names)

    return source.mapInArrow(lean(cut), plain.schema).toDF(*docs.columns)
