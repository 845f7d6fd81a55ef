"""A training-data pipeline over `documents`: each stage calls one operator of ledgerframe.llm.

Stages: language identification (undetermined texts go), near-duplicate removal (one document of each group stays),
benchmark decontamination, mixing of the sources to target weights, token-id output. All but the last return the columns of documents; every stage's
result is written as Parquet and read again. The language model is trained on the labelled rows of the stage's own input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import decontaminate, language_id, mixing, near_dedup, packing
from ledgerframe.llm._common import as_written, shared_dir, table
from ledgerframe.llm.queries import OTHER_WEIGHT, WEIGHTS

#: Tokens packed at once: about what a block of the mixture holds, so that packing moves a document by no more than that.
PACK_TOKENS = 1 << 17


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go, and those that no learned language explains better than chance."""
    model = language_id.fit(docs)
    if not model.languages:  # no row names a language: only texts without a letter are undetermined
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns})  # columns of docs may be called like those of the operator
    found = language_id.identify(named, model, text="own_text", reject_unlike=True)
    return found.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*[F.col(f"`own_{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8 or more): that of smallest doc_id. Rows are told apart
    by themselves, so unlike texts under one doc_id all stay, and copies under null ids go."""
    return near_dedup.drop_copies(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixing.in_order(mixing.mix(docs, WEIGHTS, OTHER_WEIGHT)).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token-id rows with segment lengths and position resets; by pack_id they follow the mixture."""
    return packing.pack(as_written(docs), batch_tokens=PACK_TOKENS, in_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_packing", pack_tokens),
]

#: Hashing, a trained model and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
