"""The corpus pipeline over `documents`: language ID, near-dedup, decontamination, mixing, token output.

Every stage but the last returns the columns of its input documents. A stage's result is written as Parquet to the shared
folder and read again as the next one's documents; its own intermediate tables are deleted then, and those of the stage before.

Defined cases: an empty table passes through; documents with null ids stay (a null id is near to nothing and is stored as one id
of null documents); further columns, whatever their names, pass all stages but the last, which returns its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, langid, mixing, neardup, store, tokens
from corvane.llm.queries import table, token_vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The columns that stages read; a stage gets the others as one.
READ = ["doc_id", "text", "lang", "source"]


def passing_columns(stage: Stage) -> Stage:
    """The stage on tables with further columns: these are packed into one for it, so that no name of its own meets theirs."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in READ]
        if not others:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*[c for c in READ if c in docs.columns], F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"))
        kept = stage(spark, packed, sf_dir)
        return kept.select(*[F.col(f"_others.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns])

    return run


@passing_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; those in no language (null text or no letter) go."""
    model = langid.fit(langid.sample_labelled(docs))
    return langid.identify_languages(docs, model).where("lang_pred <> 'und'").select(docs.columns)


@passing_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.keep_one_of_each(docs, k=5, percent=80)


@passing_columns
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


@passing_columns
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of as many rows as there are documents."""
    return mixing.poisson_replicate(docs).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as id shards with their index, read back: doc_id, start, n_tokens, ids_crc32."""
    # The stages share workers, so the encoder keeps fewer words than where it runs alone.
    return tokens.write_and_digest(docs, store.fresh_dir(spark, "pipeline-tokens"), token_vocabulary(), cache_words=100_000)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with store.workspace(spark) as keep:
            kept = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        store.discard(docs)  # the stage before; the input is no table of ours
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: Suffix automata, MinHash, tiling and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
