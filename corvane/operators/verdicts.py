"""Feasibility and readiness verdicts, as rules over profile rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import col, contains_any, word_count, ws_strip

# Verdicts by severity; risk flags that warn; tasks, tones and words that name a task.
SEVERITY = ["GO", "WARNING", "BLOCKED"]
WARNING_FLAGS = ["empty_dataset", "high_garbled_text", "marker_timeout_fitz_fallback"]
TIMEOUT_FLAG = "profile_extraction_timed_out"
TASK_WORDS = {"conversational-qa": ["chat", "conv", "dialogue"], "summarization": ["summar", "resume", "tl;dr"], "classification": ["classif", "label", "sentiment", "categor"], "code-generation": ["code", "program"]}
VALID_TASKS = ["question-answering", "conversational-qa", "chatbot", "summarization", "instruction-following", "classification", "text-classification", "code-generation", "translation"]
VALID_TONES = ["academic", "conversational", "technical", "simplified"]
READY, READY_WITH_WARNINGS, DEFAULT_ALIGNMENT = 0.80, 0.65, 0.7


def _percent(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)


def feasibility_findings(profiles: DataFrame) -> DataFrame:
    """(file, rule, severity, message) of profiles (file, file_kind, row_count, word_count, n_columns, mostly_null_columns, near_constant_columns, duplicate_ratio, garbled_ratio, boilerplate_ratio, risk_flags); missing figures are null.

    severity: 1 warns, 2 blocks.
    """
    table, text = F.col("file_kind").isin("csv", "excel"), F.col("file_kind").isin("txt", "pdf")
    flags = F.coalesce("risk_flags", F.array().cast("array<string>"))
    timed_out = F.array_contains(flags, TIMEOUT_FLAG)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, dup, bad, same = F.col("n_columns"), zero("duplicate_ratio"), zero("garbled_ratio"), zero("boilerplate_ratio")
    rules = [
        ("empty_table", 2, ~timed_out & table & (zero("row_count") == 0), F.lit("no rows")),
        ("empty_text", 2, ~timed_out & text & (zero("word_count") == 0), F.lit("no words")),
        ("few_rows", 2, table & (F.col("row_count") <= 50), F.concat(F.col("row_count").cast("string"), F.lit(" rows, 51 needed"))),
        ("null_columns", 2, table & (n > 0) & (F.col("mostly_null_columns") > n / 2), F.concat_ws("/", "mostly_null_columns", "n_columns")),
        ("duplicates", 2, table & (dup > 0.80), _percent(dup)),
        ("duplicates", 1, table & (dup > 0.50) & (dup <= 0.80), _percent(dup)),
        ("near_constant", 1, table & (n > 0) & (F.col("near_constant_columns") > n / 2), F.concat_ws("/", "near_constant_columns", "n_columns")),
        ("garbled", 2, text & (bad > 0.3), _percent(bad)),
        ("garbled", 1, text & (bad > 0.2) & (bad <= 0.3), _percent(bad)),
        ("boilerplate", 1, text & (same > 0.5), _percent(same)),
        ("timeout", 2, timed_out, F.lit(TIMEOUT_FLAG)),
        *[("risk_flag", 1, ~timed_out & F.array_contains(flags, f), F.lit(f)) for f in WARNING_FLAGS],
    ]
    found = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("at"), F.lit(rule).alias("rule"), F.lit(s).alias("severity"), F.concat(F.lit(rule + ": "), m).alias("message"))) for i, (rule, s, test, m) in enumerate(rules)])
    return profiles.select("file", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("file", "x.*")


def verdict_counts(findings: DataFrame) -> DataFrame:
    """One row: status (the worst), n_blocking and n_warnings; for any number of findings, whose messages stay rows."""
    sums = findings.agg(F.max("severity").alias("worst"), F.count_if(F.col("severity") == 2).cast("int").alias("n_blocking"), F.count_if(F.col("severity") == 1).cast("int").alias("n_warnings"))
    return sums.select(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce("worst", F.lit(0)) + 1).alias("status"), "n_blocking", "n_warnings")


def merge_verdict(findings: DataFrame) -> DataFrame:
    """One row for the files of one request: status (the worst), blocking_reasons and warnings in the order of files and rules; GO without findings.

    All messages meet in this row; for a corpus, take verdict_counts and keep the findings as they are.
    """
    packed = findings.agg(F.max("severity").alias("worst"), F.array_sort(F.collect_list(F.struct("file", "at", "severity", "message"))).alias("all"))
    of = lambda s: F.transform(F.filter("all", lambda x: x["severity"] == s), lambda x: x["message"])
    return packed.select(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce("worst", F.lit(0)) + 1).alias("status"), of(2).alias("blocking_reasons"), of(1).alias("warnings"))


def prompt_is_vague(prompt: Column | str) -> Column:
    return word_count(ws_strip(F.coalesce(col(prompt), F.lit("")))) <= 2


def assess(profiles: DataFrame, prompt: str) -> DataFrame:
    """The verdict on a request: a vague prompt blocks, no profiles is GO, else the merged findings."""
    vague = profiles.sparkSession.range(1).select(prompt_is_vague(F.lit(prompt)).alias("vague"))
    merged = merge_verdict(feasibility_findings(profiles))
    return merged.crossJoin(F.broadcast(vague)).select(F.when(F.col("vague"), "BLOCKED").otherwise(F.col("status")).alias("status"), F.when(F.col("vague"), F.array(F.lit("prompt: too short"))).otherwise(F.col("blocking_reasons")).alias("blocking_reasons"), F.when(F.col("vague"), F.array().cast("array<string>")).otherwise(F.col("warnings")).alias("warnings"))


def volume_score(n: Column, least: Column, target: Column, saturate: Column) -> Column:
    return F.when(n >= saturate, 1.0).when(n >= target, 0.85).when(n >= least, 0.70).otherwise(0.70 * n / F.greatest(least, F.lit(1)))


def diversity(pairs: DataFrame) -> DataFrame:
    """One row: n_pairs, n_sources, avg_answer_words, diversity."""
    sums = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(F.coalesce("source_file", F.lit(""))).alias("n_sources"), F.coalesce(F.avg(word_count(F.coalesce("answer", F.lit("")))), F.lit(0.0)).alias("avg_answer_words"))
    score = 0.4 * F.least(F.lit(1.0), F.col("n_sources") / 3) + 0.6 * F.least(F.lit(1.0), F.col("avg_answer_words") / 80)
    return sums.withColumn("diversity", F.when(F.col("n_pairs") == 0, 0.0).otherwise(score))


def alignment(reply: Column | str) -> Column:
    """The first number in [0, 1] of a judge's reply, 0.7 if there is none."""
    found = F.regexp_extract(F.coalesce(col(reply), F.lit("")), r"\b(0?\.\d+|1\.0|0|1)\b", 1)
    return F.coalesce(found.try_cast("double"), F.lit(DEFAULT_ALIGNMENT))


def readiness(pairs: DataFrame, least: int, target: int, saturate: int, judge_reply: str | None = None) -> DataFrame:
    """One row: the three axes, their mean, verdict, blocking issues, warnings, recommendations."""
    d = diversity(pairs)
    n = F.col("n_pairs")
    axes = d.withColumn("volume", volume_score(n, F.lit(least), F.lit(target), F.lit(saturate))).withColumn("alignment", alignment(F.lit(judge_reply)))
    scored = axes.withColumn("score", F.when(n == 0, 0.0).otherwise((F.col("volume") + F.col("diversity") + F.col("alignment")) / 3))
    blocked = n < least
    verdict = F.when(blocked | (n == 0) | (F.col("score") < READY_WITH_WARNINGS), "NOT_READY").when(F.col("score") >= READY, "READY").otherwise("READY_WITH_WARNINGS")
    advice = F.filter(F.array(F.when(F.col("volume") < 0.7, F.lit("more_pairs")), F.when(F.col("diversity") < 0.6, F.lit("more_diverse_answers")), F.when(F.col("alignment") < 0.6, F.lit("review_task_alignment"))), lambda x: x.isNotNull())
    tag = lambda test, text: F.filter(F.array(F.when(test, F.lit(text))), lambda x: x.isNotNull())
    return scored.select("*", verdict.alias("verdict"), tag(blocked | (n == 0), "volume_sufficiency").alias("blocking_issues"), tag(~blocked & (n < target), "below_target").alias("warnings"), F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("ready"))).alias("recommendations"))


def intent_task(goal: Column | str) -> Column:
    """The task that a goal's words name, else question-answering."""
    return reduce(lambda acc, kv: acc.when(contains_any(goal, kv[1]), F.lit(kv[0])), TASK_WORDS.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit("question-answering"))


def valid_intent(task: Column | str, tone: Column | str) -> Column:
    """struct<task,tone> with defaults for what is not valid."""
    return F.struct(F.when(col(task).isin(VALID_TASKS), col(task)).otherwise("question-answering").alias("task"), F.when(col(tone).isin(VALID_TONES), col(tone)).otherwise("conversational").alias("tone"))
