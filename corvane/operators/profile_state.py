"""Profiles that grow with their table: a state for each file, made once and stored, and united for the whole.

A state is a row a column: exact counts, sums and bounds; a HyperLogLog sketch of the values and a KLL sketch of the numbers, whose
unions are those of all rows. A new file costs its own scan, and the profile of the table costs its states.

Errors: distinct counts are about 1.6 % off (one standard deviation, sketches of 2**12 registers); a quantile is a value whose rank is
off by less than about 0.7 % of the rows; all else is exact. Defined cases: a column that only some files have counts the rows of
those; a file without rows has a state of zeros; a file whose state is written again has the newer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import ratio, ws_strip
from corvane.operators.profile_table import QUANTILES, _c, is_sentinel, numeric_columns, string_columns

REGISTERS, RANKS = 12, 400
STATE = "column string, inferred_type string, row_count bigint, null_count bigint, distinct binary, n_values bigint, mean double, m2 double, min double, max double, ranks binary, sentinel_count bigint, padded_count bigint, spaces bigint"


def profile_state(df: DataFrame) -> DataFrame:
    """A row a column as STATE says, in one scan of `df`."""
    numbers, strings = set(numeric_columns(df)), set(string_columns(df))

    def of(name: str, kind: str) -> Column:
        c, v = _c(name), _c(name).cast("double")
        number, text = name in numbers, name in strings
        n = F.count(v) if number else F.lit(None)
        parts = {
            "column": F.lit(name), "inferred_type": F.lit(kind), "row_count": F.count(F.lit(1)), "null_count": F.count_if(c.isNull()), "distinct": F.hll_sketch_agg(c.cast("string"), REGISTERS),
            "n_values": n, "mean": F.avg(v) if number else F.lit(None), "m2": F.var_pop(v) * F.count(v) if number else F.lit(None), "min": F.min(v) if number else F.lit(None), "max": F.max(v) if number else F.lit(None),
            "ranks": F.kll_sketch_agg_double(v, F.lit(RANKS)) if number else F.lit(None),
            "sentinel_count": F.count_if(is_sentinel(c)) if text else F.lit(None), "padded_count": F.count_if(c != ws_strip(c)) if text else F.lit(None), "spaces": F.sum(F.size(F.split(c, " ", -1))) if text else F.lit(None),
        }
        types = dict(x.split(" ") for x in STATE.split(", "))
        return F.struct(*[x.cast(types[k]).alias(k) for k, x in parts.items()])

    each = [of(f.name, f.dataType.simpleString()).alias(f"s{i}") for i, f in enumerate(df.schema.fields)]
    return df.agg(*each).select(F.explode(F.array(*[f"s{i}" for i in range(len(each))])).alias("s")).select("s.*")


def write_state(df: DataFrame, folder: str, source: str) -> None:
    """Store the state of one file under its name; of a job that is repeated one state stays."""
    profile_state(df).coalesce(1).write.mode("overwrite").parquet(f"{folder}/source={source}")


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{STATE}, source string").parquet(folder)


def sources_without_state(spark: SparkSession, folder: str, sources: list[str]) -> list[str]:
    """The names, of those given, that have no state yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s for s in sources if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/source={s}/_SUCCESS"))]


def united(states: DataFrame) -> DataFrame:
    """One state a column of any number of states, as if all their rows had been in one table."""
    every = Window.partitionBy("column")
    n = F.col("n_values")
    mean = F.sum(n * F.coalesce("mean", F.lit(0.0))).over(every) / F.nullif(F.sum(n).over(every), F.lit(0))
    moved = states.withColumn("all_mean", mean).withColumn("m2", F.coalesce("m2", F.lit(0.0)) + n * F.pow(F.coalesce(F.col("mean") - F.col("all_mean"), F.lit(0.0)), F.lit(2.0)))
    added = [F.sum(c).alias(c) for c in ("row_count", "null_count", "n_values", "m2", "sentinel_count", "padded_count", "spaces")]
    return moved.groupBy("column").agg(
        F.max("inferred_type").alias("inferred_type"), *added, F.first("all_mean").alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double(F.when(n > 0, F.col("ranks"))).alias("ranks"),
    )


def profile_of_states(states: DataFrame) -> DataFrame:
    """(column, inferred_type, row_count, null_count, null_ratio, unique_count, unique_ratio, min, max, mean, std, q25, q50, q75, sentinel_count, has_whitespace_issues, avg_word_count) of the rows of all states; distinct values and quantiles are estimated, a null is one more value."""
    x = united(states).withColumn("unique_count", F.hll_sketch_estimate("distinct") + (F.col("null_count") > 0).cast("int"))
    rows, some = F.greatest("row_count", F.lit(1)), F.col("n_values") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col("ranks")), F.lit(q))).alias(f"q{int(q * 100)}") for q in QUANTILES]
    return x.select(
        "column", "inferred_type", "row_count", "null_count", ratio(F.col("null_count"), rows).alias("null_ratio"), "unique_count", ratio(F.col("unique_count"), rows).alias("unique_ratio"),
        "min", "max", "mean", F.when(F.col("n_values") > 1, F.sqrt(F.col("m2") / (F.col("n_values") - 1))).alias("std"), *at,
        "sentinel_count", (F.col("padded_count") > 0).alias("has_whitespace_issues"), F.try_divide(F.col("spaces"), F.when(F.col("spaces").isNotNull(), F.col("row_count") - F.col("null_count"))).alias("avg_word_count"),
    )
