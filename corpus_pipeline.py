"""The corpus pipeline: five stages from ``documents`` to token ids, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import decontamination, jaccard, quality, secrets, sentencepiece_bpe
from girder.llm.cluster import drop_stored, stored
from girder.llm.text import free_name
from girder.session import ship

#: Documents whose quality score is lower go.
LEAST_QUALITY = 0.3
#: Benchmark words that make a document contaminated, as a share of its words.
CONTAMINATED = 0.05


def _shaped(out: DataFrame, docs: DataFrame) -> DataFrame:
    """In the columns the stage was given, n_chars counted anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, in the columns they came with, whatever their names.

    Null and empty texts are scored by their statistics and may go; repeated rows are judged alike; with no labelled
    rows every score is 0.5 and all stay; an empty table stays empty.
    """
    ship(spark)
    score = free_name(docs.columns, "score")
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_col=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id, of rows with one id the first.

    Null, empty and blank texts are like nothing and all stay; null ids come after all others; an empty table stays
    empty; all columns stay, whatever their names.
    """
    ship(spark)
    return jaccard.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: contaminated ones lose them, or go where little else is left.

    Null and empty texts have no words and stay; repeated rows are treated alike; an empty table, or an empty benchmark,
    changes nothing; all columns stay, whatever their names, but n_chars is counted anew.
    """
    ship(spark)
    return _shaped(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), coverage=CONTAMINATED), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind in brackets.

    Null texts stay null, empty ones empty; repeated rows are masked alike; of spans that overlap the first one
    names the kind, of those that start together the kind listed first; an empty table stays empty; all columns stay, whatever their names, but n_chars is counted anew.
    """
    ship(spark)
    return _shaped(secrets.scan(docs, secrets.learn(docs), keep=docs.columns, mask=True), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and digests of the ids and of what they decode to, beside doc_id, lang and source.

    Null and empty texts have no ids; repeated rows are encoded alike; an empty table stays empty; other columns go.
    """
    ship(spark)
    import public_tokenizers

    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=keep, digests=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL can't train the classifier or infer the formats, so each stage is held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage keeps is written to the shared folder, and goes when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
