"""Secret scans: fixed patterns, and formats inferred from the credentials they find.

The patterns' matches are labelled credentials. Per kind, a prefix tree of a bounded sample of them (as sequences of
character classes) is folded into a probabilistic automaton by merging states whose outgoing shares are compatible under
the Hoeffding bound. Every other run of credential characters, from the shortest credential's length on, is a candidate;
where an automaton makes its format likelier than the ordinary runs' does, by a margin a character and by the odds
against any run being a credential, it is a span of kind ``format``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import free_name, lean

#: The patterns of the kinds, in the order of their listing, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_KEYWORD = re.compile("password|passwd|secret|token|api_?key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Classes of characters: digits, a-f, g-z, A-F, G-Z, each mark by itself; the number of characters in each.
CLASS = {c: n for n, cs in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")) for c in cs}
_SIZES = Counter(CLASS.values())
_END = len(_SIZES)
SAMPLE = 400
#: Credentials and ordinary runs of more characters are scored like all others but not learned from.
LEARNED = 4096
#: In nats: by how much a format must beat ordinary runs, a character and altogether (odds of 1 to e**12).
MARGIN, ODDS = 0.5, 12.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, the credential) of the patterns' matches, in code points."""
    out = []
    if _KEYWORD.search(text.lower()):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def classes(value: str) -> list[int]:
    return [CLASS[c] for c in value]


class FormatAutomaton:
    """A probabilistic automaton over character classes, inferred from examples by state merging."""

    def __init__(self, examples: list[list[int]], alpha: float = 0.05):
        #: Per state: successor by class; counts by class, _END for stopping.
        self.next: list[dict[int, int]] = [{}]
        self.counts: list[Counter] = [Counter()]
        for sequence in examples:
            state = 0
            for c in sequence:
                self.counts[state][c] += 1
                after = self.next[state].get(c)
                if after is None:
                    after = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.counts.append(Counter())
                state = after
            self.counts[state][_END] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _infer(self) -> None:
        red, blue = [0], sorted(self.next[0].values())
        parents = {after: (state, c) for state, own in enumerate(self.next) for c, after in own.items()}
        while blue:
            state = blue.pop(0)
            into = next((r for r in red if self._compatible(r, state)), None)
            if into is None:
                red.append(state)
            else:
                parent, c = parents[state]
                self.next[parent][c] = into
                self._fold(into, state)
            kept = set(red)
            blue = sorted({after for r in red for after in self.next[r].values()} - kept)
            for r in red:
                for c, after in self.next[r].items():
                    parents[after] = (r, c)

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            na, nb = self.counts[a].total(), self.counts[b].total()
            if na and nb:
                limit = self._bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
                if any(abs(self.counts[a][c] / na - self.counts[b][c] / nb) > limit for c in self.counts[a].keys() | self.counts[b].keys()):
                    return False
            pairs += [(self.next[a][c], after) for c, after in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, into: int, state: int) -> None:
        pairs = [(into, state)]
        while pairs:
            into, state = pairs.pop()
            if into == state:
                continue
            self.counts[into] += self.counts[state]
            for c, after in self.next[state].items():
                if c in self.next[into]:
                    pairs.append((self.next[into][c], after))
                else:
                    self.next[into][c] = after

    def log_likelihood(self, sequence: list[int]) -> float:
        """Of a sequence and its end; every class keeps a small share in every state."""
        state, total = 0, 0.0
        for c in [*sequence, _END]:
            if state < 0:
                total += math.log(1e-4)
                continue
            counts = self.counts[state]
            total += math.log((counts[c] + 1e-3) / (counts.total() + 1e-3 * (_END + 1)))
            if c != _END:
                total -= math.log(_SIZES[c])
                state = self.next[state].get(c, -1)
        return total


class Background:
    """How ordinary runs of candidate characters go on: a chain of classes."""

    def __init__(self, examples: list[list[int]]):
        self.counts: dict[int, Counter] = {c: Counter() for c in range(_END + 1)}
        for sequence in examples:
            for a, b in zip([_END, *sequence], [*sequence, _END], strict=True):
                self.counts[a][b] += 1

    def log_likelihood(self, sequence: list[int]) -> float:
        total = 0.0
        for a, b in zip([_END, *sequence], [*sequence, _END], strict=True):
            own = self.counts[a]
            total += math.log((own[b] + 0.5) / (own.total() + 0.5 * (_END + 1))) - (math.log(_SIZES[b]) if b != _END else 0)
        return total


class Formats:
    def __init__(self, examples: dict[str, list[str]], ordinary: list[str], margin: float = MARGIN, odds: float = ODDS, least: int = 8):
        """An automaton for each kind with at least ``least`` examples; without any, no run is likely to be a credential."""
        self.margin, self.odds = margin, odds
        learned = {kind: values for kind, values in sorted(examples.items()) if len(values) >= least}
        self.automata = [FormatAutomaton([classes(v) for v in values]) for values in learned.values()]
        self.shortest = min((len(v) for values in learned.values() for v in values), default=0)
        self.ordinary = Background([classes(v) for v in ordinary])
        self._known: dict[str, bool] = {}

    def likely(self, value: str) -> bool:
        """Whether some format beats ordinary runs by the margin a character and by the odds."""
        known = self._known.get(value)
        if known is None:
            own = classes(value)
            best = max(a.log_likelihood(own) for a in self.automata)
            known = best - self.ordinary.log_likelihood(own) > max(self.margin * len(own), self.odds)
            if len(value) <= 64:
                if len(self._known) > 200_000:
                    self._known.clear()
                self._known[value] = known
        return known

    def spans(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
        """Candidates that some format makes likely and no pattern's match touches; marks at a run's end aren't part of it."""
        if not self.automata:
            return []
        out, at = [], 0
        taken = sorted((start, end) for start, _, end, _ in base)
        for m in re.finditer(f"[A-Za-z0-9+/_.=-]{{{self.shortest},}}", text):
            value = m[0].rstrip(".=-_/+") or m[0]
            start, end = m.start(), m.start() + len(value)
            if len(value) < self.shortest or not self.likely(value):
                continue
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if not any(s < end and start < e for s, e in taken[at:]):
                out.append((start, len(KINDS), end, value))
        return out


def learn(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> Formats:
    """Formats from at most ``sample`` distinct credentials a kind and ``10 * sample`` distinct ordinary runs, those with
    the least hashes over all documents (ties by the value) of those of up to LEARNED characters. Each task sends no more
    than that many; the bound doesn't grow. Null and empty texts have none; an empty table gives formats that nothing has."""
    source = docs.select(F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        least: dict[str, dict[str, str]] = {k: {} for k in (*KINDS, "ordinary")}

        def add(kind: str, value: str, most: int) -> None:
            own = least[kind]
            if len(value) <= LEARNED and value not in own:
                own[value] = hashlib.md5(value.encode()).hexdigest()
                if len(own) > 4 * most:
                    least[kind] = dict(sorted(own.items(), key=lambda x: x[1])[:most])

        for batch in batches:
            for text in batch.column("_text").to_pylist():
                base = base_spans(text or "")
                for _, kind, _, value in base:
                    add(KINDS[kind], value, sample)
                taken = {value for *_, value in base}
                for value in CANDIDATE.findall(text or ""):
                    if value not in taken:
                        add("ordinary", value, 10 * sample)
        rows = [(k, h, v) for k, own in least.items() for v, h in sorted(own.items(), key=lambda x: x[1])[: sample * (10 if k == "ordinary" else 1)]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, names=["kind", "hash", "value"])

    found = source.mapInArrow(lean(run), "kind string, hash string, value string").distinct()
    examples: dict[str, list[str]] = {}
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("hash", "value")))
    for row in ranked.where(F.col("n") <= F.when(F.col("kind") == "ordinary", 10 * sample).otherwise(sample)).orderBy("kind", "n").toLocalIterator():
        examples.setdefault(row["kind"], []).append(row["value"])
    ordinary = examples.pop("ordinary", [])
    return Formats(examples, ordinary)


SPAN_TYPE = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, formats: Formats, *, keep: list[str], text_col: str = "text", mask: bool = False, digests: bool = False) -> DataFrame:
    """The columns ``keep`` and what was found in each text: ``secret_spans`` (by start, in code points, end exclusive).

    With ``digests``, instead n_assign, n_access, n_hex, base_sha256 and spans; with ``mask``, instead the text itself with
    every span replaced by ``[kind]``. Null texts have no spans and stay null; each row stands alone, so repeated rows
    give repeated results. Columns of the added names are replaced.
    """
    if digests:
        added = {"n_assign": ("long", pa.int64()), "n_access": ("long", pa.int64()), "n_hex": ("long", pa.int64()), "base_sha256": ("string", pa.string()), "spans": ("string", pa.string())}
    elif mask:
        added = {text_col: ("string", pa.string())}
    else:
        added = {"secret_spans": (SPAN_TYPE, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))}
    kept = [c for c in keep if c not in added]
    name_of_text = free_name(kept)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(name_of_text))
    schema = source.drop(name_of_text).schema
    for name, (kind, _) in added.items():
        schema = schema.add(name, kind if kind != SPAN_TYPE else _SPAN_SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    names = (*KINDS, "format")

    def run(batches):
        formats = shared.value
        for batch in batches:
            out: dict[str, list] = {n: [] for n in added}
            for text in batch.column(name_of_text).to_pylist():
                base = base_spans(text or "")
                every = sorted(base + formats.spans(text or "", base))
                if digests:
                    for n, kind in enumerate(KINDS):
                        out[f"n_{kind}"].append(sum(1 for s in base if s[1] == n))
                    out["base_sha256"].append(hashlib.sha256(_joined(base, names).encode()).hexdigest())
                    out["spans"].append(_joined(every, names))
                elif mask:
                    out[text_col].append(None if text is None else masked(text, every, names))
                else:
                    out["secret_spans"].append([{"start": s, "end": e, "kind": names[k]} for s, k, e, _ in every])
            arrays = [batch.column(c) for c in kept] + [pa.array(out[n], kind) for n, (_, kind) in added.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])

    return source.mapInArrow(lean(run), schema)


def _joined(spans: list[tuple[int, int, int, str]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in spans)


def masked(text: str, spans: list[tuple[int, int, int, str]], names: tuple[str, ...]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{names[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _span_schema():
    from pyspark.sql import types as T

    return T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


_SPAN_SCHEMA = _span_schema()
