"""From raw documents to training records: profile, verdict, clean, chunk, filter, deduplicate, export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import chunk, clean, dedup, export, profile_text, qa_rules, verdicts
from corvane.operators.providers import required


@dataclass(frozen=True)
class Prepared:
    """The tables of a preparation, each lazy but the links of deduplication."""

    profiles: DataFrame
    verdict: DataFrame
    chunks: DataFrame
    pairs: DataFrame
    records: DataFrame


def feasibility_rows(profiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text profiles in the form that the feasibility rules read."""
    none = lambda kind: F.lit(None).cast(kind)
    return profiles.select(F.col(key).cast("string").alias("file"), F.lit("txt").alias("file_kind"), none("bigint").alias("row_count"), "word_count", none("int").alias("n_columns"), none("int").alias("mostly_null_columns"), none("int").alias("near_constant_columns"), none("double").alias("duplicate_ratio"), "garbled_ratio", "boilerplate_ratio", "risk_flags")


def quality_by(docs: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """(by, documents, mean_suitability, blocked, warned): profiles and feasibility findings of documents, by a column."""
    profiles = profile_text.text_profile(docs, key)
    worst = verdicts.feasibility_findings(feasibility_rows(profiles, key)).groupBy("file").agg(F.max("severity").alias("severity"))
    joined = profiles.withColumn("file", F.col(key).cast("string")).join(worst, "file", "left").join(docs.select(key, by), key)
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("suitability"), 6).alias("mean_suitability"), F.count_if(F.col("severity") == 2).alias("blocked"), F.count_if(F.col("severity") == 1).alias("warned"))


def prepare(docs: DataFrame, generate: Callable[[DataFrame], DataFrame] | None, task: str = "question-answering", model: str = "", key: str = "doc_id") -> Prepared:
    """generate: from chunks (key, chunk_id, text, prev_context, next_context) to pairs (pair_id, question, answer, source_file, confidence); it must be given."""
    profiles = profile_text.text_profile(docs, key)
    verdict = verdicts.merge_verdict(verdicts.feasibility_findings(feasibility_rows(profiles, key)))
    chunks = chunk.sentence_chunks(clean.clean_documents(docs, key), key).where(chunk.boilerplate_rule("text").isNull())
    raw = qa_rules.shape_pairs(required(generate, "generate")(chunks)).where(qa_rules.filter_reason().isNull())
    pairs = dedup.lexical_dedup(raw).where("drop_rule IS NULL").drop("drop_rule")
    records = export.assign_splits(export.export_records(pairs, task, model), "pair_id")
    return Prepared(profiles, verdict, chunks, pairs, records)
