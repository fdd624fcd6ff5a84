"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import exact_dedup, language, mixing, pieces, simhash_sets
from linkloom.llm.common import delete, own_folder, place, positions, scratch
from linkloom.llm.queries import model_path

#: Share of a document's language below which no language is accepted.
LEAST_SHARE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that are null, have no letter or fit no language; a missing language is filled in."""
    names, n = docs.columns, len(docs.columns)
    labelled = positions(language.label(docs, language.fit(docs)))  # by position, as names may clash
    found, score, lang = F.col(f"_{n}"), F.col(f"_{n + 1}"), f"_{place(docs, 'lang')}"
    kept = labelled.filter((found != language.UNKNOWN) & (score >= LEAST_SHARE))
    return kept.withColumn(lang, F.coalesce(lang, found)).drop(f"_{n}", f"_{n + 1}").toDF(*names)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more the one with the smallest id stays."""
    return simhash_sets.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them; one taken twice comes twice."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, as counts and digests, with the digest of the decoded text."""
    return pieces.token_digests(docs, model_path())


STAGES = [
    ("language", identify_language),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: SQL has no gated recurrent network, knapsack or byte-pair merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every one but the last is written and read again.

    What a stage stashes is deleted once its result is written, and that once the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{own_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
