"""Scores of generated texts against references. Null texts count as empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import col, ratio, words, ws_strip

EDGE_MARKS = ".,!?;:'\"()[]{}"


def _text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def rouge_tokens(c: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9; other letters split words."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[a-z0-9]+"), F.lit(0))


def lower_words(c: Column | str) -> Column:
    return words(F.lower(_text(c)))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def clipped_overlap(pairs: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """(key, overlap): common members of two arrays, as multisets."""
    count = lambda c, name: pairs.select(key, F.explode(c).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias(name))
    return count(a, "na").join(count(b, "nb"), [key, "g"]).groupBy(key).agg(F.sum(F.least("na", "nb")).alias("overlap"))


def _f(overlap: Column, n: Column, m: Column) -> Column:
    return ratio(2 * overlap, n + m)


@F.pandas_udf(T.IntegerType())
def lcs_length(a: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence of two token arrays (bit-parallel in Python integers)."""

    def length(x: np.ndarray, y: np.ndarray) -> int:
        where: dict[str, int] = {}
        for i, t in enumerate(x):
            where[t] = where.get(t, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for t in y:
            hit = row & where.get(t, 0)
            row = (row + hit | row - hit) & full
        return len(x) - row.bit_count()

    for x, y in a:
        yield pd.Series([length(p, q) for p, q in zip(x, y, strict=True)])


def rouge(pairs: DataFrame, key: str, reference: str = "reference", generated: str = "generated", with_l: bool = True) -> DataFrame:
    """(key, rouge1, rouge2, rougeL): F of clipped n-gram overlap, and of the longest common subsequence."""
    t = pairs.select(key, rouge_tokens(reference).alias("r"), rouge_tokens(generated).alias("g"))
    out = t
    for n in (1, 2):
        overlap = clipped_overlap(t, key, ngrams(F.col("r"), n), ngrams(F.col("g"), n)).withColumnRenamed("overlap", f"o{n}")
        out = out.join(overlap, key, "left")
    size = lambda c, n: F.greatest(F.size(c) - n + 1, F.lit(0))
    scores = [_f(F.coalesce(f"o{n}", F.lit(0)), size("r", n), size("g", n)).alias(f"rouge{n}") for n in (1, 2)]
    if with_l:
        scores.append(_f(lcs_length("r", "g"), F.size("r"), F.size("g")).alias("rougeL"))
    return out.select(key, *scores)


def bleu4(pairs: DataFrame, key: str, reference: str = "reference", generated: str = "generated") -> DataFrame:
    """(key, bleu4): four n-gram precisions with equal weights and the brevity penalty; 0.1 in place of a zero overlap, 0 without a common word."""
    t = pairs.select(key, lower_words(reference).alias("r"), lower_words(generated).alias("g"))
    out = t
    for n in range(1, 5):
        out = out.join(clipped_overlap(t, key, ngrams(F.col("r"), n), ngrams(F.col("g"), n)).withColumnRenamed("overlap", f"o{n}"), key, "left")
    overlap = [F.coalesce(F.col(f"o{n}"), F.lit(0)).cast("double") for n in range(1, 5)]
    total = [F.greatest(F.size("g") - n + 1, F.lit(1)) for n in range(1, 5)]
    logs = sum((F.ln(F.when(o == 0, F.lit(0.1)).otherwise(o) / n) for o, n in zip(overlap, total, strict=True)), F.lit(0.0))
    brevity = F.when(F.size("g") > F.size("r"), 1.0).otherwise(F.exp(1 - F.size("r") / F.greatest(F.size("g"), F.lit(1))))
    return out.select(key, F.when((F.size("g") == 0) | (overlap[0] == 0), 0.0).otherwise(brevity * F.exp(logs / 4)).alias("bleu4"))


def token_f1(reference: Column | str, generated: Column | str) -> Column:
    """F of the distinct common words over the lengths of both texts."""
    r, g = lower_words(reference), lower_words(generated)
    return _f(F.size(F.array_intersect(r, g)), F.size(r), F.size(g))


def exact_match(reference: Column | str, generated: Column | str) -> Column:
    return (F.lower(ws_strip(_text(reference))) == F.lower(ws_strip(_text(generated)))).cast("double")


def metric_means(scores: DataFrame, names: list[str]) -> DataFrame:
    """One row: the mean of each metric, 4 decimals; 0 without rows."""
    return scores.agg(*[F.coalesce(F.round(F.avg(n), 4), F.lit(0.0)).alias(n) for n in names])


def optional_score(pairs: DataFrame, scorer=None, **columns) -> DataFrame:
    """`pairs` with the columns of an injected scorer (a function from DataFrame to DataFrame); unchanged without one."""
    return pairs if scorer is None else scorer(pairs, **columns)


def inverse_document_weights(tokens: DataFrame, document: str, token: str) -> DataFrame:
    """(token, weight): log((documents + 1) / (documents with the token + 1)), so that a token of every document weighs nothing."""
    total = tokens.agg(F.count_distinct(document).alias("__n"))  # one row
    held = tokens.select(document, token).distinct().groupBy(token).agg(F.count(F.lit(1)).alias("__df"))
    return held.crossJoin(F.broadcast(total)).select(token, F.log((F.col("__n") + 1) / (F.col("__df") + 1)).alias("weight"))


def matched_scores(pairs: DataFrame, reference: str = "reference", generated: str = "generated", reference_weights: str | None = None, generated_weights: str | None = None) -> DataFrame:
    """`pairs` with `precision`, `recall` and `f1` of texts as arrays of token vectors, which columns so named give way to.

    Each token is matched with the token of the other side whose cosine is largest; recall is the mean over the reference's tokens
    by their weights, precision over the generated ones, f1 their harmonic mean. The vectors come from the caller's encoder.
    Without tokens or weights on either side the scores are 0; a null or zero vector is near to nothing (cosine 0).
    """
    given = [c for c in (reference_weights, generated_weights) if c]
    rows = pairs.drop("precision", "recall", "f1")
    names = [*rows.columns, "precision", "recall", "f1"]
    at = {c: rows.columns.index(c) for c in (reference, generated, *given)}
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names[-3:]]])

    def unit(vectors: list | None) -> np.ndarray:
        size = max((len(v) for v in vectors or [] if v), default=1)
        m = np.array([v if v else [0.0] * size for v in vectors or []], float).reshape(-1, size)
        norm = np.sqrt((m**2).sum(1, keepdims=True))
        return m / np.where(norm > 0, norm, 1)

    def mean(best: np.ndarray, weights: list | None) -> float:
        w = np.ones(len(best)) if weights is None else np.array(weights, float)
        return float((best * w).sum() / w.sum()) if w.sum() > 0 else 0.0

    def largest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest cosine of each row of either side, over blocks of one side's rows."""
        of_a, of_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
        for lo in range(0, len(a), 1024):
            cos = a[lo : lo + 1024] @ b.T
            of_a[lo : lo + 1024] = cos.max(1)
            of_b = np.maximum(of_b, cos.max(0))
        return of_a, of_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            weights = [batch.column(at[c]).to_pylist() if c else [None] * batch.num_rows for c in (reference_weights, generated_weights)]
            for x, y, wx, wy in zip(batch.column(at[reference]).to_pylist(), batch.column(at[generated]).to_pylist(), *weights, strict=True):
                a, b = unit(x), unit(y)
                if not len(a) or not len(b) or a.shape[1] != b.shape[1]:
                    got.append((0.0, 0.0, 0.0))
                    continue
                of_a, of_b = largest(a, b)
                p, r = mean(of_b, wy), mean(of_a, wx)
                got.append((p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0))
            columns = [pa.array([g[k] for g in got], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return rows.mapInArrow(run, schema)


def label_of(c: Column | str) -> Column:
    """The first word of the first line, lower case, without marks at its edges."""
    first = F.get(words(F.split(F.lower(ws_strip(_text(c))), "\n")[0]), 0)
    marks = "[" + "".join("\\" + m for m in EDGE_MARKS) + "]"
    return ws_strip(F.regexp_replace(F.coalesce(first, F.lit("")), f"^{marks}+|{marks}+$", ""))


def classification(pairs: DataFrame, reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy and macro precision, recall and F1 over the labels of both columns; zeros without rows."""
    cells = pairs.groupBy(F.col(reference).alias("r"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.col("r").alias("label"), F.when(F.col("r") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("in_reference"), F.lit(0).alias("in_predicted")).union(cells.select("p", F.lit(0), F.lit(0), "n"))
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("in_reference").alias("r"), F.sum("in_predicted").alias("p"))
    scored = per.select("tp", "r", ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("r")).alias("recall"), ratio(2 * F.col("tp"), F.col("p") + F.col("r")).alias("f1"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.agg(zero(F.try_divide(F.sum("tp").cast("double"), F.sum("r"))).alias("accuracy"), zero(F.avg("precision")).alias("precision"), zero(F.avg("recall")).alias("recall"), zero(F.avg("f1")).alias("f1_macro"))


def entities(c: Column | str) -> Column:
    """Distinct TYPE:value entries of a `|` list; parts without a colon do not count."""
    parts = F.filter(F.transform(F.split(_text(c), r"\|"), ws_strip), lambda p: F.contains(p, F.lit(":")))
    return F.array_distinct(F.transform(parts, lambda p: F.concat(F.upper(ws_strip(F.substring_index(p, ":", 1))), F.lit(":"), F.lower(ws_strip(F.substring(p, F.instr(p, ":") + 1, F.length(p)))))))


def entity_scores(pairs: DataFrame, reference: str = "reference", generated: str = "generated") -> DataFrame:
    """One row: micro precision and recall of entities (4 decimals) and the F1 of these rounded values."""
    r, g = entities(reference), entities(generated)
    sums = pairs.select(F.size(F.array_intersect(r, g)).alias("tp"), F.size(r).alias("r"), F.size(g).alias("g")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "r", "g")])
    p, q = F.round(ratio(F.col("tp"), F.col("g")), 4), F.round(ratio(F.col("tp"), F.col("r")), 4)
    return sums.select(p.alias("entity_precision"), q.alias("entity_recall")).withColumn("entity_f1", F.round(ratio(2 * F.col("entity_precision") * F.col("entity_recall"), F.col("entity_precision") + F.col("entity_recall")), 4))


def _object(reply: Column | str) -> Column:
    return F.from_json(F.regexp_extract(_text(reply), r"(?s)\{.*?\}", 0), "map<string,string>")


def judged_dimensions(replies: DataFrame, dimensions: list[str], reply: str = "reply") -> DataFrame:
    """(dimension, n, score): mean of ratings clamped to 1..5, over 5; keys may carry a `g_` prefix. Replies without numbers do not count."""
    m = _object(reply)
    value = lambda d: F.coalesce(F.try_element_at(m, F.lit("g_" + d)), F.try_element_at(m, F.lit(d))).try_cast("double")
    each = replies.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), value(d).alias("v")) for d in dimensions])).alias("x")).select("x.*").where("v IS NOT NULL")
    return each.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("v")))) / 5, 4).alias("score"))


def judged_overall(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg("score"), 4).alias("g_eval_overall"))


def faithfulness(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row: mean of `faithfulness` clamped to 0..1 (0.5 where an object lacks it), over replies that hold an object; null without any."""
    m = _object(reply)
    v = F.coalesce(F.try_element_at(m, F.lit("faithfulness")).try_cast("double"), F.lit(0.5))
    return replies.where(m.isNotNull()).agg(F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))), 4).alias("faithfulness"))


def strip_generation(generated: Column | str, prompt: Column | str) -> Column:
    """Without the prompt at the start and what follows the end tag, stripped."""
    g, p = _text(generated), _text(prompt)
    rest = F.when(F.startswith(g, p), F.substring(g, F.length(p) + 1, F.length(g))).otherwise(g)
    return ws_strip(F.regexp_replace(rest, r"(?s)<\|im_end\|>.*", ""))


def tier(value: Column, good: Column, acceptable: Column) -> Column:
    return F.when(value >= good, "good").when(value >= acceptable, "acceptable").otherwise("poor")


def is_suspicious(value: Column, good: Column) -> Column:
    return value > good * 1.9


def tier_with_tolerance(value: Column, good: Column, acceptable: Column, pairs: Column) -> Column:
    """A tenth under `acceptable` still is; under 2000 pairs good counts as acceptable."""
    return F.when((value >= good) & (pairs >= 2000), "good").when(value >= acceptable * 0.9, "acceptable").otherwise("poor")


def recommendation(value: Column, good: Column, acceptable: Column, pairs: Column, stagnates: Column) -> Column:
    """What to do after an evaluation."""
    t = tier_with_tolerance(value, good, acceptable, pairs)
    return (
        F.when(is_suspicious(value, good), "check_leakage")
        .when(t == "good", "export")
        .when((t == "acceptable") & (value < acceptable), "accept_borderline")
        .when((t == "acceptable") & stagnates, "stop_stagnation")
        .when((pairs < 2000) | (value < acceptable * 0.5), "generate_pairs")
        .when(value < acceptable, "adjust_hyper_parameters")
        .when(value < good, "continue_lower_rate")
        .otherwise("review")
    )


def parse_thresholds(reply: Column | str) -> Column:
    """struct<good,acceptable> of a reply's object, clamped to [0, 1]; null where one is missing."""
    m = _object(reply)
    v = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_element_at(m, F.lit(k)).try_cast("double")))
    good, ok = v("good_threshold"), v("acceptable_threshold")
    return F.when(F.try_element_at(m, F.lit("good_threshold")).try_cast("double").isNotNull() & F.try_element_at(m, F.lit("acceptable_threshold")).try_cast("double").isNotNull(), F.struct(good.alias("good"), ok.alias("acceptable")))
