"""The operators against brute force on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from girder.llm import decontamination, fingerprint, jaccard, ppm, secrets, sentencepiece_bpe, substring_dedup, suffix_dedup, text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _row long, _text string, start string"


def frame(spark, texts, ids=None):
    """Documents with nulls and extra columns whose names clash with the operators' own."""
    rows = [(i if ids is None else ids[i], t, None, "s", None, 9.0, 7, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def shared_texts(seed, alphabet, sep=""):
    rng = random.Random(seed)
    base = [[rng.choice(alphabet) for _ in range(rng.randint(5, 300))] for _ in range(6)]
    out = []
    for _ in range(40):
        own = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b))
            own += b[i : rng.randint(i, len(b))] if rng.random() < 0.7 else [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
        out.append(sep.join(own))
    return [*out, None, "", out[3], out[3], sep.join(alphabet[:1] * 120)]


def brute_cut(units, width):
    count = Counter()
    for u in units:
        for i in range(len(u) - width + 1):
            count[tuple(u[i : i + width])] += 1
    kept = []
    for u in units:
        gone = set()
        for i in range(len(u) - width + 1):
            if count[tuple(u[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept.append([x for i, x in enumerate(u) if i not in gone])
    return kept


@pytest.mark.parametrize(("seed", "hot"), [(0, 20_000), (1, 3)])
def test_suffix_dedup(spark, seed, hot):
    texts = shared_texts(seed, "ab" if seed else "abcdefgh é\n")
    want = brute_cut([list((t or "").encode()) for t in texts], 40)
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, texts), width=40, gram=13, hot_anchors=hot).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert bytes(out[i]["kept"]) == bytes(want[i])
        assert out[i]["n_removed"] == len((t or "").encode()) - len(want[i]) == sum(b - a for a, b in out[i]["removed_runs"])


def test_loser_tree_reports_common_prefixes():
    rng = random.Random(5)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 20))) for _ in range(7)]
    coded = [suffix_dedup.decoded(suffix_dedup.front_coded([(s, b"", 0, 0) for s in run])) for run in runs]
    out = list(suffix_dedup.merged(coded))
    assert [x[1] for x in out] == sorted(s for run in runs for s in run)
    for a, b in zip(out, out[1:], strict=False):
        assert b[0] == suffix_dedup.shared_prefix(a[1], b[1])


def test_substring_dedup(spark):
    texts = shared_texts(2, [f"w{i}" for i in range(9)], " ")
    want = brute_cut([(t or "").encode().split() for t in texts], 12)
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, texts), width=12).collect()}
    assert {i: r["kept"] for i, r in out.items()} == {i: b" ".join(w).decode() for i, w in enumerate(want)}


def test_empty_tables(spark):
    none = frame(spark, []).where("false")
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert jaccard.cluster(none).count() == 0
    assert ppm.score(none).count() == 0
    assert fingerprint.edited_fingerprints(none).count() == 0
    assert secrets.scan(none, secrets.learn(none), keep=["doc_id"]).count() == 0


def test_jaccard_components(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", " \n ", "A b c", "a B c", "one two three four five", "one two three four five"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 10, 30, 120]))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.cluster(frame(spark, texts)).collect()}
    assert out == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    kept = {r["doc_id"] for r in jaccard.one_of_each(frame(spark, texts)).collect()}
    assert kept == {find(i) for i in range(len(texts))}


def test_row_numbers_do_not_follow_the_splits(spark, tmp_path):
    from pyspark.sql import functions as F

    from girder.llm import cluster

    spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).repartition(7).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    sources = {"files": docs, "chosen": docs.where("doc_id % 3 > 0"), "shuffled": docs.repartition(5), "random": docs.where(F.rand() < 0.5), "exploded": docs.select("doc_id", F.explode(F.array(F.lit("p"), F.lit("q"))).alias("text"))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, source in sources.items():
        rows = cluster.keyed(source, "doc_id", "text")
        seen = []
        for most in ("128m", "1k"):
            try:
                spark.conf.set("spark.sql.files.maxPartitionBytes", most)
                seen.append(sorted(map(tuple, rows.select("_row", "_id", "_text").where("_row >= 0").collect())))
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert seen[0] == seen[1] and len({r[0] for r in seen[0]}) == len(seen[0]), name
        assert name == "random" or len(seen[0]) == source.count()


def test_sentencepiece_matches_the_library(spark):
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        model = sentencepiece_bpe.Model(file.read())
    rng = random.Random(1)
    texts = ["", " ", "  a", "▁", "a" * 40, "<s>", "<0x41>", "a\x00b"] + ["".join(rng.choice(" ▁aabeehtinos\n\tñ梦é😀Zz.,1 23  ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == library.decode(ids)
    for _ in range(300):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999), 259]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)
    some = [*texts[:60], None]
    out = {r["doc_id"]: r for r in sentencepiece_bpe.encode_documents(frame(spark, some), path, keep=["doc_id"], digests=True).collect()}
    for i, t in enumerate(some):
        ids = library.encode(t or "")
        assert out[i]["ids"] == ids and out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_decontamination_against_windows(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(f"i{n}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 13, 14, 30])))) for n in range(25)] + [("null", None), ("empty", "-- ")]
    docs = [None, "", "..."] + [" ".join([*(rng.choice(vocabulary) for _ in range(20)), *(rng.choice(items[:25])[1].upper().split()), *(f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 400)))]) for _ in range(60)]
    table = spark.createDataFrame(items, "item_id string, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = defaultdict(set)
    for name, t in items:
        w = norm(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(name)
    sizes = {len(w) for w in windows}
    for block in (1_000_000, 60):
        out = {r["doc_id"]: r for r in decontamination.find_hits(frame(spark, docs), table, block_words=block).collect()}
        for d, t in enumerate(docs):
            w, hit, names = norm(t), set(), set()
            for n in sizes:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in windows:
                        hit |= set(range(i, i + n))
                        names |= windows[tuple(w[i : i + n])]
            got = out[d]
            assert got["hit_words"] == len(w) and {p for a, b in got["hit_runs"] for p in range(a, b)} == hit and got["hit_items"] == sorted(names)
            assert got["text"] == t
    clean = decontamination.decontaminate(frame(spark, docs), table)
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    again = {r["doc_id"]: r for r in decontamination.find_hits(clean, table).collect()}
    for d, t in enumerate(docs):
        got = out[d]
        n = sum(b - a for a, b in got["hit_runs"])
        if not (n and 20 * n >= got["hit_words"]):
            assert left[d] == t  # clean documents stay as they are
        elif d in left:
            m = sum(b - a for a, b in again[d]["hit_runs"])
            assert 20 * m < again[d]["hit_words"]


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile("[0-9a-f]+"), 24, 0),
]


def test_secret_base_spans_and_learned_formats(spark):
    rng = random.Random(8)
    texts = [None, "", "token = abc", "Password: 'hunter2x' é token=\"" + "a1" * 20 + '"', "AKIA" + "A1" * 8 + " AKIAX", "ſecret: longenough", "api_key=secret=token=abcdef"]
    for _ in range(80):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        texts.append(f"some ordinary words {''.join(rng.choice('abdehinorst') for _ in range(18))} token = \"{key}\" and more")
    hidden = "".join(rng.choice("0123456789abcdef") for _ in range(22))  # too short for a pattern
    texts += [f"key AKIA{''.join(rng.choice('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ') for _ in range(16))} x" for _ in range(40)]
    texts.append(f"the id {hidden} was left here")
    docs = frame(spark, texts)
    formats = secrets.learn(docs)
    out = {r["doc_id"]: r for r in secrets.scan(docs, formats, keep=["doc_id"], digests=True).collect()}
    for i, t in enumerate(texts):
        base = sorted((m.start(), n, m.end()) for n, (_, p, least, group) in enumerate(BASE) for m in p.finditer(t or "") if len(m[group]) >= least)
        joined = ",".join(f"{BASE[n][0]}:{s}:{e}" for s, n, e in base)
        assert out[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(out[i]["spans"].split(","))
    assert out[len(texts) - 1]["spans"] == f"format:7:{7 + len(hidden)}"
    masked = {r["doc_id"]: r["text"] for r in secrets.scan(docs, formats, keep=docs.columns, mask=True).collect()}
    assert masked[0] is None and masked[2] == "token = abc" and hidden not in masked[len(texts) - 1]


def test_fingerprints(spark):
    a, b = fingerprint.fingerprint("x\ny\nz"), fingerprint.fingerprint("z\nx\ny")
    assert (a == b).all() and fingerprint.likeness(a, b) == 1.0
    assert (fingerprint.delete(fingerprint.insert(a, "new"), "new") == a).all()
    assert (fingerprint.from_text(fingerprint.as_text(a)) == a).all()
    many = [f"line {i}" for i in range(200)]
    half = fingerprint.likeness(fingerprint.fingerprint("\n".join(many)), fingerprint.fingerprint("\n".join(many[:100] + [f"other {i}" for i in range(100)])))
    assert 0.15 < half < 0.55
    texts = ["aé\nb" * 9, None, "", "q", "ab", "x\ny\n" * 30, "last one here"]
    ids = [5, 9, None, 2, 2, 7, 100]
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, -(ids[i] or 0), texts[i] or ""))
    docs = frame(spark, texts, ids)
    for rows in (fingerprint.edited_fingerprints(docs), fingerprint.edited_fingerprints(docs.repartition(3))):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in rows.collect())
        want = []
        for n, i in enumerate(order):
            own, nxt = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
            edited = own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]
            prints = [fingerprint.as_text(fingerprint.fingerprint(t)) for t in (own, edited)]
            want.append((ids[i] is None, ids[i] or 0, len(own), hashlib.sha256(edited.encode()).hexdigest(), *prints))
        assert got == sorted(want)


def test_fingerprints_of_very_long_texts():
    text_of = lambda name, n: "\n".join(f"{name} {i}" for i in range(n))
    for n in (1000, 20_000, 70_000):
        a, b, half = (fingerprint.fingerprint(t) for t in (text_of("a", n), text_of("b", n), text_of("a", n // 2) + "\n" + text_of("c", n - n // 2)))
        assert fingerprint.count(a) == n
        assert fingerprint.likeness(a, b) < 0.2 and 0.15 < fingerprint.likeness(a, half) < 0.55
    assert (fingerprint.delete(fingerprint.insert(a, "x", "y"), "y", "x") == a).all()


def brute_ppm(train, texts, order, min_share):
    lower = lambda t: bytes(order) + bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()) + b"\0"
    full = [Counter() for _ in range(order + 1)]
    for t in train:
        raw = lower(t)
        for i in range(order, len(raw)):
            for k in range(order + 1):
                full[k][raw[i - k : i + 1]] += 1
    least = max(1, math.ceil(sum(full[0].values()) * min_share))
    trie = defaultdict(dict)
    total = Counter()
    for grams in full:
        for g, c in grams.items():
            total[g[:-1]] += c
            if c >= least:
                trie[g[:-1]][g[-1]] = c
    out = []
    for t in texts:
        raw, score = lower(t), 0.0
        for i in range(order, len(raw)):
            excluded: dict = {}
            for k in range(order, -1, -1):
                context = raw[i - k : i]
                if context not in trie:
                    continue
                left = {s: c for s, c in trie[context].items() if s not in excluded}
                mass = total[context] - sum(trie[context][s] for s in excluded) + len(left)
                if raw[i] in left:
                    score += math.log10(left[raw[i]] / mass)
                    break
                if mass > 0:
                    score += math.log10(max(total[context] - sum(trie[context].values()) + len(left), 1e-9) / mass)
                excluded = trie[context]
            else:
                score += -math.log10(256 - len(trie[b""]))
        out.append(score)
    return out


@pytest.mark.parametrize(("order", "share"), [(2, 1e-9), (3, 0.004), (5, 0.002)])
def test_ppm_against_a_plain_trie(spark, order, share):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "Thing", "on", "é", "zq\n", "over"]) for _ in range(rng.randint(0, 40))) for _ in range(25)] + [None, "", "~|~ unseen"]
    docs = frame(spark, texts)
    train = docs.where("doc_id % 3 <> 0")
    out = {r["doc_id"]: r for r in ppm.score(docs, train, order=order, min_share=share, heavy_words=3).collect()}
    kept = [t for i, t in enumerate(texts) if i % 3]
    want = brute_ppm(kept, texts, order, share)
    count = Counter(w for t in kept for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        tokens = [*(t or "").encode().lower().split(), None]
        assert out[i]["score"] == pytest.approx(want[i], rel=1e-4, abs=1e-4)
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)


@pytest.mark.parametrize("heavy", [0, 40, 10**6])
def test_ppm_keeps_rare_grams_whatever_the_corpus(spark, heavy):
    # Of 2.4 million training symbols some are met once: a cut by share would drop them.
    common, rare = "abcde fghij " * 10_000, "qwxyz vkjq"
    texts = [rare, *[common] * 20, "qwxyz vkjq", "qwxzz", None]
    docs = frame(spark, texts)
    out = {r["doc_id"]: r["score"] for r in ppm.score(docs, docs.where("doc_id <= 20"), heavy_codes=heavy).collect()}
    few = brute_ppm_counts([(rare, 1), (common, 20)])
    for i in (0, 21, 22, 23):
        assert out[i] == pytest.approx(few(texts[i]), rel=1e-4, abs=1e-4)
    assert out[21] > -15


def brute_ppm_counts(train, order=5):
    """Scores from the full counts of (text, times)."""
    lower = lambda t: bytes(order) + (t or "").encode() + b"\0"
    seen = defaultdict(Counter)
    for t, times in train:
        for i in range(order, len(raw := lower(t))):
            for k in range(order + 1):
                seen[raw[i - k : i]][raw[i]] += times

    def score(t):
        total, raw = 0.0, lower(t)
        for i in range(order, len(raw)):
            excluded: Counter = Counter()
            for k in range(order, -1, -1):
                if not (here := seen.get(raw[i - k : i])):
                    continue
                left = {s: c for s, c in here.items() if s not in excluded}
                mass = sum(left.values()) + len(left)
                if raw[i] in left:
                    total += math.log10(left[raw[i]] / mass)
                    break
                total += math.log10(len(left) / mass) if left else 0.0
                excluded = here
            else:
                total -= math.log10(256 - len(seen[b""]))
        return total

    return score


def test_text_kernels():
    import numpy as np
    import pyarrow as pa

    texts = ["", " a  b", None, "c\td\n", "", "é"]
    words, at = [], 0
    for first, last, data, offsets in text.chunks(pa.array(texts), 3):
        starts, ends, bounds = text.word_bounds(data, offsets)
        assert first == at
        at = last
        words += [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)]
        assert len(bounds) == last - first + 1
    assert at == len(texts) and words == [b"a", b"b", b"c", b"d", "é".encode()]
    values = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 7, 50):
        assert (text.sliding_min(values, width) == [values[i : i + width].min() for i in range(51 - width)]).all()
