"""The pipeline's stages, and the quality score, against plain Python over small tables."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from girder.llm import quality, secrets
from girder.llm.text import WordHash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["one", "two", "Three", "four,", "FIVE!", "six6", "sieben", "åtta"]) + rng.choice(["", "", "x", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    root = tmp_path_factory.mktemp("hand")
    items = [f"{n} " + " ".join(f"b{n}w{i}" for i in range(rng.choice([4, 13, 70]))) for n in range(6)]
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(40)]
    for i in range(25):
        base = texts[rng.randrange(40)].split(" ")
        if len(base) > 3:
            base[rng.randrange(len(base))] = "changed"
        texts.append(" ".join(base))
        long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 300, 3000])))
        texts.append(f"{long} {rng.choice(items)} {long[:200]}")
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts += [f"has token = {key()} here {i}" for i in range(12)] + ["AKIA" + "A1B2" * 5, None, "", "  "]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(bool(t) and "FIVE" not in t[:40]), 0) for i, t, *_ in docs if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(f"i{n}", t) for n, t in enumerate(items)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, items


def read(spark, tables):
    return spark.read.parquet(f"{tables[0]}/documents.parquet")


def test_quality_by_hand(spark, tables):
    """Every feature and every pair of features, one at a time."""
    docs = read(spark, tables)
    model = quality.train(docs, spark.read.parquet(f"{tables[0]}/labels.parquet"))
    p, hasher = model.params, WordHash(501, fold_case=True)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, tables[0]).collect()}
    for doc_id, text, *_ in tables[1]:
        raw = (text or "").encode()
        words = raw.split()
        n, size = len(words), len(raw)
        fold = [w.lower() for w in words]
        count = lambda test: sum(map(test, raw)) / max(size, 1)  # noqa: B023, E731
        lengths = [len(w) for w in words]
        mean = sum(lengths) / max(n, 1)
        spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean**2, 0))
        mark = lambda b: 33 <= b < 127 and not chr(b).isalnum()
        share = lambda test: sum(map(test, words)) / max(n, 1)  # noqa: B023, E731
        stats = [math.log1p(size), math.log1p(n), count(lambda b: 65 <= b <= 90), count(lambda b: 48 <= b <= 57), count(mark), count(lambda b: b >= 128), count(lambda b: b == 10), count(lambda b: b in b" \t\n\v\f\r")]
        stats += [mean, spread, share(lambda w: len(w) <= 3), share(lambda w: mark(w[-1])), sum(a == b for a, b in zip(fold, fold[1:], strict=False)) / max(n, 1), len(set(fold)) / max(n, 1)]
        z = np.clip((np.array(stats) - model.center) / model.scale, -4, 4)
        hashes = [int(hasher.spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) % quality.BUCKETS for w in words]
        x = 1 / math.sqrt(max(n, 1))
        factors = [p["v"][h].astype(float) * x for h in hashes] + [v * s for v, s in zip(p["vs"], z, strict=True)]
        score = p["bias"][0] + sum(p["w"][h] * x for h in hashes) + float(z @ p["ws"])
        score += sum(float(factors[i] @ factors[j]) for i in range(len(factors)) for j in range(i)) if len(factors) < 60 else 0.5 * float((np.sum(factors, axis=0) ** 2).sum() - sum((f**2).sum() for f in factors))
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        assert model.scores(pa.array([text], pa.string()))[0] == pytest.approx(want, abs=1e-4), doc_id
        if abs(want - corpus_pipeline.LEAST_QUALITY) > 1e-3:
            assert (doc_id in kept) == (want >= corpus_pipeline.LEAST_QUALITY)


def test_near_duplicates_by_hand(spark, tables):
    sets = {}
    for doc_id, text, *_ in tables[1]:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    name = {d: d for d in sets}
    for _ in sets:
        before = dict(name)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
        if before == name:
            break
    out = corpus_pipeline.drop_near_duplicates(spark, read(spark, tables), tables[0]).collect()
    assert {r["doc_id"] for r in out} == {d for d in name if name[d] == d} and len(name) - len(out) > 5
    assert all(tuple(r) == tables[1][r["doc_id"]] for r in out)


def test_decontamination_by_hand(spark, tables):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in tables[2]:
        w = pattern.findall(t)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    sizes = {len(w) for w in windows}

    def hits(text):
        w = pattern.findall(text.lower())
        return len(w), {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}

    def runs(hit):
        out = []
        for p in sorted(hit):
            if out and out[-1][1] == p:
                out[-1][1] = p + 1
            else:
                out.append([p, p + 1])
        return out

    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_benchmark(spark, read(spark, tables), tables[0]).collect()}
    went = cut = 0
    for doc_id, text, *_ in tables[1]:
        n, hit = hits(text or "")
        if not hit:
            assert out[doc_id] == text
            continue
        if len(hit) >= 0.5 * n:
            assert doc_id not in out
            went += 1
            continue
        while True:
            gone = hit if len(hit) >= 0.05 * n else {p for a, b in runs(hit) if b - a > 50 for p in range(a, b)}
            if not gone:
                break
            cut += 1
            spans, parts, at = [m.span() for m in pattern.finditer(text.lower())], [], 0
            for a, b in runs(gone):
                parts.append(text[at : spans[a][0]].strip(" \n"))
                at = spans[b - 1][1]
            text = " ".join(x for x in [*parts, text[at:].strip(" \n")] if x)
            n, hit = hits(text)
        assert out[doc_id] == text
    assert went and cut


def test_secrets_by_hand(spark, tables):
    docs = read(spark, tables)
    formats = secrets.learn(docs)
    assert formats.automata
    out = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, docs, tables[0]).collect()}
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]
    masked = 0
    for doc_id, text, *_ in tables[1]:
        if text is None:
            assert out[doc_id]["text"] is None
            continue
        found = [(m.start(), n, m.end(), k) for n, (k, p, least, group) in enumerate(kinds) for m in p.finditer(text) if len(m[group]) >= least]
        taken = list(found)
        for m in re.finditer("[A-Za-z0-9+/_.=-]+", text):
            value = m[0].rstrip(".=-_/+") or m[0]
            free = not any(s < m.start() + len(value) and m.start() < e for s, _, e, _ in taken)
            if len(value) >= formats.shortest and free and formats.likely(value):
                found.append((m.start(), 3, m.start() + len(value), "format"))
        want, at = "", 0
        for start, _, end, kind in sorted(found):
            if start >= at:
                want += text[at:start] + f"[{kind}]"
            at = max(at, end)
        want += text[at:]
        masked += want != text
        assert (out[doc_id]["text"], out[doc_id]["n_chars"]) == (want, len(want))
    assert masked >= 13


def test_stretches_that_a_tokenizer_worker_remembers_are_few():
    import sys

    import public_tokenizers

    from girder.llm import sentencepiece_bpe as S

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        seen = S.Seen(S.Model(file.read()))
    most = 0
    for start in range(0, 400_000, 20_000):
        seen.age(S.CACHE_BYTES)
        for i in range(start, start + 20_000):
            seen.add(f"{S.SPACE}{i:06d}")
        most = max(most, len(seen.ids) + len(seen.elder))
    one = sum(sys.getsizeof(x) for x in (f"{S.SPACE}{1:06d}", seen.add(f"{S.SPACE}{1:06d}"))) + 100
    assert most * one < 48 << 20
