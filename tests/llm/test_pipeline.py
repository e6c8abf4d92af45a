"""Classifiers by held-out accuracy, the pipeline's stages, and the library without the subpackage."""

from __future__ import annotations

import random
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from girder.llm import decontamination, quality, secrets, toxicity

REPO = Path(__file__).parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 420):
    """Ordinary prose, junk that repeats or shouts, and prose with a few rude words."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdehinorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        good = i % 4 != 0
        if not good:
            body = [w.upper() + "!!" for w in body] if i % 8 else [w + rng.choice(["###", "$$$", "%%%"]) for w in body]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.choices(["zgrub", "zgrubbig", "wretchy", "mudface"], k=6):
                body.insert(rng.randrange(len(body)), w)
        docs.append((i, " ".join(body), ["en", "de", None][i % 3], "s", 0))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs, labels = corpus()
    key = "".join(random.Random(2).choice("0123456789abcdef") for _ in range(40))
    passage = " ".join(f"bench{i}" for i in range(14))
    long = docs[1][1]
    docs += [(900, long + " extra", "en", "s", 0), (901, long, "en", "s", 0), (902, passage + " " + long[:400], "en", "s", 0), (903, None, "en", "s", 0), (904, "", None, None, 0), (905, " ".join(docs[3][1].split()[::-1]) + f" token = \"{key}\" after", "en", "s", 0)]
    labels += [(1, None, None), (5000, 1, 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("b1", passage)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def held_out_accuracy(rows, labels, column, modulus, rest, limit):
    truth = {d: dict(quality=q, toxic=t)[column] for d, q, t in labels if q is not None}
    out = [((r["score"] >= limit) == bool(truth[r["doc_id"]])) for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest]
    return np.mean(out)


def test_quality_and_toxicity_on_held_out_rows(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    truth = corpus()[1]
    scored = quality.classify(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert held_out_accuracy(scored, truth, "quality", 5, 0, 0.3) > 0.95
    rude = toxicity.classify(docs, labels).collect()
    assert held_out_accuracy(rude, truth, "toxic", 3, 1, 0.5) > 0.95
    assert {r["toxic"] for r in rude} == {True, False}


def test_scores_do_not_read_the_other_columns(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    import pyarrow as pa

    column = pa.array([r["text"] for r in docs.orderBy("doc_id").limit(50).collect()])
    whole = model.scores(column)
    assert np.allclose(whole, np.concatenate([model.scores(column.slice(i, 1)) for i in range(50)]))


def test_without_labels_every_score_is_a_half(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    rows = toxicity.classify(docs, none).collect()
    assert {(r["score"], r["toxic"]) for r in rows} == {(0.5, False)}


def test_factorisation_identity():
    model = quality.FactorisationMachine(3)
    rng = np.random.default_rng(0)
    model.params["v"] = rng.normal(size=model.params["v"].shape)
    model.params["vs"] = rng.normal(size=model.params["vs"].shape)
    words, stats = rng.integers(0, 50, 6), rng.normal(size=(1, 3))
    score, _ = model.forward(words, np.array([6]), stats)
    v = np.concatenate([model.params["v"][words] / np.sqrt(6), model.params["vs"] * stats[0][:, None]])
    assert np.isclose(score[0], sum(v[i] @ v[j] for i in range(9) for j in range(i)))


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        columns = docs.columns
        out = stage(spark, docs, tables)
        path = f"{tables}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "quality":
            truth = {d: q for d, q, _ in corpus()[1]}
            assert np.mean([(d in after) == bool(q) for d, q in truth.items()]) > 0.95
        if name == "near_duplicates":
            assert len({1, 900, 901} & set(after)) == 1 and all(after[d] == before[d] for d in after)
        if name == "decontamination":
            assert "bench3" not in (after[902]["text"] if 902 in after else "")
            assert all(after[d]["text"] == before[d]["text"] for d in before if d != 902)
        if name == "secrets":
            assert "[assign]" in after[905]["text"] and "token = " not in after[905]["text"]
            assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "sentencepiece":
            assert all(len(r["ids"]) == r["n_tokens"] for r in after.values())


def test_stages_take_empty_tables_and_repeated_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), tables).count() == 0
    twice = docs.where("doc_id in (1, 2)").union(docs.where("doc_id in (1, 2)"))
    twice.write.parquet(f"{tables}/twice")
    assert corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tables}/twice"), tables).count() == 2


def test_masks_nothing_without_secrets(spark):
    docs = spark.createDataFrame([(1, "plain words only", "en", "s", 16)], SCHEMA)
    assert corpus_pipeline.mask_secrets(spark, docs, "").collect() == docs.collect()
    assert secrets.masked("abc", [], ()) == "abc"
    assert decontamination.cut_words("a b  c, d", [[1, 3]]) == "a , d"


def test_the_rest_works_without_the_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k[:2] == 'op' and k[2:3].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin"})
