"""Mixing sources to target weights by hash-seeded Poisson replication.

Each document is kept a Poisson-distributed number of times whose mean is its source's repetition rate; the draw is the
inverse of the distribution at a uniform number hashed from seed and id, so a lost task repeats it exactly. Copies are
then dealt out globally by a second hash.

Defined cases: a null source is a source of its own; a null id hashes as the word "null"; repeated rows get the same
count each; a weight that is missing, null or not above 0 gives rate 0; null or empty texts are replicated like others;
an empty table gives an empty table. Columns named like `copy_col` or `place_col` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of the rate table up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def hash_uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def hash_place(*parts: Column | str) -> Column:
    """A long from the first 60 bits of an md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """(source, cdf): P(X <= k) for k = 0, 1, ... as an array that ends where the rest is below double precision. rates: source, rate."""
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    each = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k")
    log_p = F.col("k") * F.ln("rate") - F.col("rate") - F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(upto)
    summed = each.withColumn("log_p", log_p).select("source", "k", F.sum(F.exp("log_p")).over(upto).alias("c"))
    return summed.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n_docs, rate): expected copies of a source's documents, so that its share of the result is its weight.

    weights: None gives every source the same weight. epochs: rows of the result over rows of the input.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "source string, weight double")
        weighted = counts.join(given.withColumnRenamed("source", "given"), F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n_docs", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    totals = weighted.agg(F.sum("n_docs").alias("all_docs"), F.sum("weight").alias("all_weight"))
    return weighted.crossJoin(F.broadcast(totals)).select("source", "n_docs", F.coalesce(F.try_divide(F.col("weight") * F.col("all_docs") * F.lit(float(epochs)), F.col("all_weight") * F.col("n_docs")), F.lit(0.0)).alias("rate"))


def poisson_replicate(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy", place_col: str = "place") -> DataFrame:
    """Documents times their Poisson counts, shuffled globally: partitions by a hash of (seed, id, copy), sorted by it."""
    rates = poisson_cdf(source_rates(docs, weights, epochs, source_col)).toDF("__mix_source", "__mix_cdf")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in (copy_col, place_col)]
    u = hash_uniform(seed, F.col(id_col))
    counted = docs.join(rates, F.col(source_col).eqNullSafe(F.col("__mix_source")), "left").withColumn("__mix_u", u)
    times = F.size(F.filter(F.coalesce("__mix_cdf", F.array(F.lit(1.0))), lambda c: c <= F.col("__mix_u")))
    copies = counted.withColumn("__mix_n", times).where(F.col("__mix_n") > 0).select(*columns, F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1)).alias(copy_col))
    placed = copies.withColumn(place_col, hash_place(seed, "place", F.col(id_col), F.col(copy_col)))
    return placed.repartition(F.col(place_col)).sortWithinPartitions(place_col)
