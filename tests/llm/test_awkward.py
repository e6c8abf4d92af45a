"""Cases that went wrong once or easily could: colliding words, neighbours, clashing names, odd ids, very long texts."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from girder.llm import decontamination, fingerprint, jaccard, ppm, quality, secrets, sentencepiece_bpe, substring_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string"


def opposite_words() -> tuple[str, str]:
    """Two words whose polynomials modulo 2**64 agree whatever the base."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_opposite_words_are_told_apart(spark):
    a, b = opposite_words()
    fill = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{a} {fill}"), (2, f"{b} {fill}")], SCHEMA)
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {0}
    docs = spark.createDataFrame([(1, f"{a} x1 x2 x3 x4"), (2, f"{b} x1 x2 x3 x4")], SCHEMA)
    assert {r["component_id"] for r in jaccard.cluster(docs).collect()} == {1, 2}
    out = {r["doc_id"]: r["n_known"] for r in ppm.score(docs, docs.where("doc_id = 1")).collect()}
    assert out == {1: 6, 2: 5}


def test_null_characters_are_symbols_of_their_own(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "ab\0ab"), (3, "ab\x01ab")], SCHEMA)
    out = {r["doc_id"]: r["score"] for r in ppm.score(docs, docs.where("doc_id = 1")).collect()}
    assert out[2] == pytest.approx(out[3])


def test_quality_reads_no_neighbour():
    texts = ["same word word", "word other words here", "", None, "here again", "again"]
    whole = [stats for _, _, stats in quality.featurise(pa.array(texts))]
    alone = [stats for t in texts for _, _, stats in quality.featurise(pa.array([t], pa.string()))]
    assert np.allclose(np.concatenate(whole), np.concatenate(alone))
    words = (texts[0] or "").split()
    size = len(texts[0])
    want = [math.log1p(size), math.log1p(3), 0, 0, 0, 0, 0, 2 / size, 4.0, 0.0, 0.0, 0.0, 1 / 3, 2 / 3]
    assert len(words) == 3 and np.allclose(alone[0][0], want)


def test_convolution_by_hand():
    rng = np.random.default_rng(3)
    model = toxicity.TextCnn()
    for name, value in model.params.items():
        model.params[name] = rng.normal(size=value.shape).astype(np.float32)
    texts = ["One two, three-four five", "", "single", "deux mots", None, "repeat repeat repeat repeat"]
    features = [(words[a:b]) for words, bounds in toxicity.featurise(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(f) for f in features] == [5, 0, 1, 2, 0, 4]
    p, want = model.params, []
    for words in features:
        vectors = [sum(p["e"][i].astype(float) for i in row) for row in words]
        pooled = []
        for k in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                found = [sum(vectors[at + j] @ p[f"f{k}"][j][:, f] for j in range(k)) + p[f"b{k}"][f] for at in range(len(vectors) - k + 1)]
                pooled.append(max([0.0, *found]))
        want.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(pooled, p["out"])) + float(p["bias"][0]))))))
    assert np.allclose(model.scores(pa.array(texts)), want, atol=1e-4)


def test_fitting_follows_the_gradient():
    """Steps lower the loss, and cut-offs come from the rows they are given."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50, (int(rng.integers(3, 9)), 4)) for _ in range(60)]
    target = np.array([float(7 in d[:, 0]) for d in docs])
    model = toxicity.TextCnn()
    loss = lambda: np.mean([-(y * np.log(s) + (1 - y) * np.log(1 - s)) for d, y in zip(docs, target, strict=True) for s in model.score(d, np.array([0, len(d)]))])
    before = loss()
    model.fit(docs, target, epochs=20)
    assert loss() < before / 2
    toxicity.calibrate(model, np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1, 0, 0]), ["en", "en", "de", None], least=2)
    assert model.cutoffs == {None: pytest.approx(0.5), "en": pytest.approx(0.4, abs=0.41)}


def test_benchmark_ids_and_clashing_columns(spark):
    passage = [" ".join(f"{c}{i}" for i in range(13)) for c in "pqr"]
    items = spark.createDataFrame([(None, passage[0]), ("None", passage[1]), (None, passage[2])], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(passage), "mine", 5), (2, "plain", None, None)], "doc_id long, text string, hit_words string, Hit_Runs int")
    hits = {r["doc_id"]: r for r in decontamination.find_hits(docs.drop("hit_words", "Hit_Runs"), items).collect()}
    assert hits[1]["hit_items"] == ["None", None] and hits[2]["hit_items"] == []
    out = decontamination.decontaminate(docs, items)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "plain", None, None)]


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_long_passages_go_whatever_their_share(spark, block_words):
    passage = " ".join(f"p{i}" for i in range(200))
    short = " ".join(f"s{i}" for i in range(20))
    rest = [f"w{i}" for i in range(10_000)]
    text = " ".join([*rest[:3000], passage, *rest[3000:6000], short, *rest[6000:]])
    items = spark.createDataFrame([(1, passage), (2, short)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], SCHEMA)
    left = decontamination.decontaminate(docs, items, block_words=block_words).first()["text"].split()
    assert left == [*rest[:6000], *short.split(), *rest[6000:]]


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    name = list(range(len(texts)))
    for _ in texts:
        before = list(name)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    name[i] = name[j] = min(name[i], name[j])
        if before == name:
            return name


@pytest.mark.parametrize("with_base", [True, False])
def test_clouds_of_near_copies(spark, with_base):
    rng = random.Random(12)
    texts = []
    for cloud in range(2):
        base = [f"c{cloud}w{rng.randrange(400)}" for _ in range(120)]
        texts += [" ".join(base)] if with_base else []
        for _ in range(70):
            own = list(base)
            for _ in range(rng.randint(0 if with_base else 2, 8)):
                own[rng.randrange(len(own))] = f"m{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = brute_components(texts)
    assert len(set(want)) > 4
    assert {r["doc_id"]: r["component_id"] for r in jaccard.cluster(docs).collect()} == dict(enumerate(want))


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "hit_words", "hit_runs", "hit_items", "_row", "_id", "_text", "n", "component", "start", "secret_spans", "c0"]
    rows = [(i, t, "en", "s", 0, *["mine"] * 12) for i, t in enumerate(["some plain words that stay here", "other plain words that remain there", None, "", "other plain words that remain there"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names[5:]))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "nothing of the kind")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names
        assert {tuple(r)[5:] for r in out.collect()} == {("mine",) * 12}, name
        assert sorted(r["doc_id"] for r in out.collect()) == ([0, 1, 2, 3] if name == "near_duplicates" else [0, 1, 2, 3, 4])
    assert sorted(r["n_tokens"] for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).collect())[:2] == [0, 0]


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "p q"), (None, "z"), ("c", "r s")], "doc_id string, text string")
    out = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    assert set(out) == {"a", "b", "c", None}
    assert out["b"]["edited_fingerprint"] == fingerprint.as_text(fingerprint.fingerprint("x p"))
    assert [jaccard.cluster(docs).count(), ppm.score(docs).count(), suffix_dedup.remove_repeats(docs).count(), substring_dedup.remove_repeats(docs).count()] == [4] * 4


def test_very_long_texts(spark):
    """Texts of more than a chunk (1 MiB), whole."""
    rng = random.Random(5)
    long = " ".join(f"{rng.randrange(10**9)}" for _ in range(130_000))
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, long), (2, long + " and an end"), (3, long[-300:] + " tail")], SCHEMA)
    cut = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[1] == b"" and bytes(cut[2]) == b"and an end" and bytes(cut[3]) == b"tail"
    few = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs, width=20).collect()}
    assert few[1] == (130_000, 130_000) and few[2] == (130_003, 130_000) and few[3][1] >= 20
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.cluster(docs.where("doc_id < 3")).collect()} == {1: (129_996, 1), 2: (129_999, 1)}
    passage = long.split()[100_000:100_013]
    hits = {r["doc_id"]: r["hit_runs"] for r in decontamination.find_hits(docs, spark.createDataFrame([("i", " ".join(passage))], "item_id string, text string")).collect()}
    assert hits[1] == hits[2] == [[100_000, 100_013]] and hits[3] == []
    scored = {r["doc_id"]: r["n_tokens"] for r in ppm.score(docs).collect()}
    assert scored[1] == 130_001
    key = long[:400_000].replace(" ", "")
    spans = secrets.base_spans(f"{long} token = {key} {long}")
    assert [(k, e - s) for s, k, e, _ in spans if k == 0] == [(0, len(key) + 8)]


def test_long_stretches_take_linear_time():
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        model = sentencepiece_bpe.Model(file.read())
    rng = random.Random(0)
    text = "".join(rng.choice("abdehinorst") for _ in range(300_000))
    assert model.encode(text[:20_000]) == library.encode(text[:20_000])
    model.encode(text)
    began = time.thread_time()
    model.encode(text[:100_000])
    short = time.thread_time() - began
    began = time.thread_time()
    model.encode(text)
    assert time.thread_time() - began < 6 * short + 0.2


def test_candidates_are_scored_whole_and_of_any_class():
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(100)) for _ in range(60)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(6, 20))) for _ in range(600)]
    formats = secrets.Formats({"hex": [h[:24] + h for h in hexes], "assign": ["".join(rng.choice("BCDFGHJKLMNPQRSTVWXZ") for _ in range(8)) for _ in range(60)]}, words)
    assert formats.shortest == 8
    found = secrets.Formats.spans(formats, f"plain {hexes[0]} words internationalisation QXZVKJWB end", [])
    assert [f[3] for f in found] == [hexes[0], "QXZVKJWB"]
    assert secrets.Formats({}, words).spans("a" * 50, []) == []
