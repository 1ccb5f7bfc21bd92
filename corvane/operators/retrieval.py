"""Choosing model cards: texts, exact top-k by cosine among the eligible, and post-filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import col
from corvane.operators.registry import incompatibility, methods_that_fit

BLOCK = 2048


def size_class(words: Column, rows: Column) -> Column:
    n = F.coalesce(words, rows)
    return F.when(n.isNull(), "unknown dataset size").when(n < 500, "very small dataset").when(n < 5000, "small dataset").when(n < 50000, "medium dataset").otherwise("large dataset")


def query_text(task, domain, description, language, modality, size, objective, memory_gb) -> Column:
    """The text by which cards are searched; empty domain and description are left out."""
    part = lambda label, c: F.when(F.coalesce(col(c), F.lit("")) != "", F.concat(F.lit(label + ": "), col(c).cast("string"), F.lit(".")))
    return F.concat_ws(" ", part("Task", task), part("Domain", domain), part("Description", description), part("Data language", language), part("Modality", modality), part("Dataset", size), part("Objective", objective), F.concat(F.lit("Hardware: "), col(memory_gb).cast("string"), F.lit("GB VRAM available.")), F.lit("Select a model that fits within VRAM and performs well on the task."))


def card_text() -> Column:
    listed = lambda c, default: F.concat_ws(", ", F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c)).otherwise(F.array(F.lit(default))))
    return F.concat(F.lit("Model: "), F.coalesce("model_id", F.lit("")), F.lit(". Parameters: "), F.coalesce(F.col("parameters_b"), F.lit(0)).cast("string"), F.lit("B. Supported tasks: "), listed("supported_tasks", "text-generation"), F.lit(". Supported languages: "), listed("supported_languages", "en"), F.lit(". Tags: "), F.concat_ws(", ", F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 10)), F.lit("."))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(items: DataFrame, vector: str, query: list[float], k: int, key: str) -> DataFrame:
    """The k nearest rows of `items` to one query vector: `items` with score and rank, ties by key.

    Filter `items` first; each partition keeps its own k, and only these meet.
    """
    from pyspark.sql.window import Window

    q = F.array(*[F.lit(float(x)) for x in query])
    best = items.withColumn("score", cosine(F.col(vector), q)).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def top_k_each(items: DataFrame, queries: DataFrame, vector: str, k: int, key: str, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the k nearest rows of `items` to each row of `queries`, its own key left out, ties (to 12 digits) by key.

    Exact. Every block of queries meets every block of rows of its dimension in one group of bounded size, which keeps its own k
    a query; only these meet. Null and zero vectors are neither found nor find.
    """
    import math

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.window import Window

    vectors = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("d", F.size("v"))
    rows, asked = vectors(items), vectors(queries)
    nx, ny = (max(1, math.ceil(df.count() / block)) for df in (asked, rows))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("d", dealt(nx).alias("x"), every(ny).alias("y"), F.lit(0).alias("side"), "id", "v")
    right = rows.select("d", every(nx).alias("x"), dealt(ny).alias("y"), F.lit(1).alias("side"), "id", "v")

    def best(got: pa.Table) -> pa.Table:
        got = got.sort_by("id")
        side, ids = got.column("side").to_numpy(), got.column("id").to_numpy()
        m = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        norm = np.sqrt((m**2).sum(1))
        usable = (norm > 0) & np.isfinite(norm)
        a, b = np.flatnonzero((side == 0) & usable), np.flatnonzero((side == 1) & usable)
        score = np.round((m[a] / norm[a, None]) @ (m[b] / norm[b, None]).T, 12)
        score[ids[a][:, None] == ids[b][None, :]] = -np.inf
        order = np.argsort(-score, 1, kind="stable")[:, :k]
        found = np.take_along_axis(score, order, 1)
        q, at = np.nonzero(np.isfinite(found))
        return pa.table({"query_id": pa.array(ids[a[q]], pa.int64()), key: pa.array(ids[b[order[q, at]]], pa.int64()), "score": pa.array(found[q, at], pa.float64())})

    near = left.union(right).groupBy("d", "x", "y").applyInArrow(best, f"query_id bigint, `{key}` bigint, score double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def eligible_cards(cards: DataFrame, memory_gb: float) -> DataFrame:
    """Cards of known size without a reason against them that some method fits."""
    fit = methods_that_fit(cards.where("parameters_b IS NOT NULL"), F.lit(memory_gb))
    return fit.where(incompatibility().isNull() & (F.size("feasible") > 0))


def candidates(ranked: DataFrame, tried: DataFrame, cached: DataFrame, k: int = 3, only_cached: bool = False) -> DataFrame:
    """The first k ranked models that were not tried (model_id), cached ones (model_id, cached) first."""
    left = ranked.join(tried.select("model_id").distinct(), "model_id", "left_anti").join(cached, "model_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    if only_cached and not left.where("cached").isEmpty():
        left = left.where("cached")
    return left.orderBy(F.desc("cached"), "rank", "model_id").limit(k)


def picked(chosen: DataFrame, answer: str | None) -> DataFrame:
    """The candidate that a judge named, else the first."""
    named = (F.col("model_id") == F.lit(answer)).cast("int")
    return chosen.orderBy(F.desc(F.coalesce(named, F.lit(0))), F.desc("cached"), "rank").limit(1)
