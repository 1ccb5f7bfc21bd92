"""Column and table profiles.

`column_profile` is the primary form: one row per column. Counts of values come from one grouping of (column, value), so no
plan multiplies its rows by the number of distinct aggregates; quantiles are exact order statistics found between
approximate bounds, so no sort of a whole column is needed.

Nulls: a null counts as one distinct value; statistics are over non-nulls; an empty table has ratio 0 everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.functions.text import ratio, spread, ws_strip
from corvane.operators.dedup import discard, written

# Words that stand for a missing value.
SENTINELS = ["n/a", "na", "null", "none", "unknown", "-", "--", "?", "nan", ""]
QUANTILES = (0.25, 0.5, 0.75)
ACCURACY = 10_000
SHORT_TEXT_WORDS, HIGH_NULL, NEAR_CONSTANT, SMALL_ROWS, ID_UNIQUE = 5, 0.30, 0.01, 30, 0.98
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def is_sentinel(c: Column) -> Column:
    return F.lower(ws_strip(c)).isin(SENTINELS)


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n): how often each value occurs, null included, over all columns at once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in df.columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    """The columns whose values are grouped as integers, as doubles, and as strings."""
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        whole, real = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)), isinstance(f.dataType, (T.FloatType, T.DoubleType))
        kinds.setdefault("bigint" if whole else "double" if real else "string", []).append(f.name)
    return kinds


def distinct_counts(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(column, row_count, null_count, unique_count), a null being one more value; values are grouped in their own type, integers and doubles without becoming strings.

    counted: the value counts of the columns that are grouped as strings, if they are known.
    """
    each = []
    for kind, names in columns_by_kind(df).items():
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast(kind).alias("value")) for c in names])
        counts = counted if counted is not None and kind == "string" else df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
        each.append(counts.groupBy("column").agg(F.sum("n").alias("row_count"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.count(F.lit(1)).alias("unique_count")))
    return reduce(DataFrame.unionByName, each)


def approximate_counts(df: DataFrame) -> DataFrame:
    """The same with distinct values estimated (HyperLogLog++, 1 % off): one scan without a shuffle of values, for tables whose columns are mostly unique."""
    return _per_column(df, df.columns, lambda c: {"row_count": F.count(F.lit(1)), "null_count": F.count_if(_c(c).isNull()), "unique_count": F.approx_count_distinct(_c(c), 0.01) + F.max(_c(c).isNull().cast("int"))})


def nearest_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, q25, q50, q75): the value at index round(q * (n - 1)) of the sorted non-nulls.

    Bounds from an approximate sketch keep a small part of each column; the rows below are only counted.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, q25 double, q50 double, q75 double")
    value = {c: _c(c).cast("double") for c in columns}
    sizes = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()

    def edges(n: int) -> list[float]:
        spread = 4 / ACCURACY + 2 / max(1, n)
        return [max(0.0, q - spread) for q in QUANTILES] + [min(1.0, q + spread) for q in QUANTILES]

    bounds = df.agg(*[F.struct(F.lit(sizes[f"n{i}"]).alias("n"), F.percentile_approx(value[c], edges(sizes[f"n{i}"]), ACCURACY).alias("e")).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    wanted = [(c, k, bounds[f"b{i}"]["n"], bounds[f"b{i}"]["e"][k], bounds[f"b{i}"]["e"][k + len(QUANTILES)]) for i, c in enumerate(columns) if bounds[f"b{i}"]["n"] for k in range(len(QUANTILES))]
    if not wanted:
        return df.sparkSession.createDataFrame([], "column string, q25 double, q50 double, q75 double")
    below = df.agg(*[F.count_if(value[c] < lo).alias(f"w{j}") for j, (c, _, _, lo, _) in enumerate(wanted)]).first()
    ranks = {j: int(QUANTILES[k] * (n - 1) + 0.5) - below[f"w{j}"] for j, (_, k, n, _, _) in enumerate(wanted)}
    near = F.array(*[F.struct(F.lit(j).alias("w"), F.lit(c).alias("column"), F.lit(k).alias("k"), F.when(value[c].between(lo, hi), value[c]).alias("v"), F.lit(ranks[j]).alias("rank")) for j, (c, k, _, lo, hi) in enumerate(wanted)])
    few = df.select(F.explode(near).alias("x")).select("x.*").where("v IS NOT NULL").groupBy("w", "column", "k", "rank", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("w").orderBy("v"))
    picked = few.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return picked.groupBy("column").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"q{int(q * 100)}") for k, q in enumerate(QUANTILES)])


def _per_column(df: DataFrame, columns: list[str], exprs) -> DataFrame:
    """One aggregation of the whole table, turned to a row per column. exprs(c) gives name → aggregate."""
    parts = [F.struct(F.lit(c).alias("column"), *[e.alias(k) for k, e in exprs(c).items()]).alias(f"s{i}") for i, c in enumerate(columns)]
    return df.agg(*parts).select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")


def outlier_counts(df: DataFrame, stats: DataFrame, columns: list[str], least: int = 4) -> DataFrame:
    """(column, outlier_count): values over 3 standard deviations from the mean; 0 for fewer than `least` values or no spread."""
    wide = stats.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.struct("n_values", "mean", "std"))).alias(f"t{i}") for i, c in enumerate(columns)])

    def expr(i: int, c: str) -> Column:
        t = F.col(f"t{i}")
        return F.count_if((t["n_values"] >= least) & (t["std"] > 0) & (F.abs(_c(c).cast("double") - t["mean"]) > 3 * t["std"]))

    parts = [F.struct(F.lit(c).alias("column"), expr(i, c).alias("outlier_count")).alias(f"s{i}") for i, c in enumerate(columns)]
    return df.crossJoin(F.broadcast(wide)).agg(*parts).select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")


def column_profile(df: DataFrame, sheet: bool = False, approximate: bool = False) -> DataFrame:
    """One row per column. sheet: the workbook variant, whose outlier count is null under four values. approximate: distinct values are estimated.

    A source of few files is dealt out once and kept for the scans, as are the counts of strings; both are deleted when the
    profile, a row a column, is written.
    """
    dealt = spread(df)
    storable = not any(isinstance(f.dataType, T.NullType) for f in df.schema.fields)
    kept = [written(dealt, "profile-input")] if dealt is not df and storable else []
    df = kept[0] if kept else dealt
    numbers, strings = numeric_columns(df), string_columns(df)
    as_strings = columns_by_kind(df).get("string", [])
    counted = written(value_counts(df.select(*[_c(c) for c in as_strings])), "profile-values") if as_strings and not (approximate and not strings) else None
    base = approximate_counts(df) if approximate else distinct_counts(df, counted)
    kinds = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "position int, column string, inferred_type string")
    out = kinds.join(base, "column", "left").na.fill(0, ["row_count", "null_count", "unique_count"])
    out = out.withColumn("null_ratio", ratio(F.col("null_count"), F.greatest("row_count", F.lit(1)))).withColumn("unique_ratio", ratio(F.col("unique_count"), F.greatest("row_count", F.lit(1))))
    if numbers:
        stats = _per_column(df, numbers, lambda c: {"n_values": F.count(_c(c)), "min": F.min(_c(c)).cast("double"), "max": F.max(_c(c)).cast("double"), "mean": F.avg(_c(c)).cast("double"), "std": F.stddev_samp(_c(c)).cast("double")})
        out = out.join(F.broadcast(stats), "column", "left").join(F.broadcast(nearest_quantiles(df, numbers)), "column", "left").join(F.broadcast(outlier_counts(df, stats, numbers)), "column", "left")
        if sheet:
            out = out.withColumn("outlier_count", F.when(F.col("n_values") >= 4, F.col("outlier_count")))
    if strings:
        signals = counted.where(F.col("column").isin(strings) & F.col("value").isNotNull())
        v, n = F.col("value"), F.col("n")
        spaces = F.size(F.split(v, " ", -1))
        texts = signals.groupBy("column").agg(F.sum(F.when(is_sentinel(v), n).otherwise(0)).alias("sentinel_count"), F.bool_or(v != ws_strip(v)).alias("has_whitespace_issues"), (F.sum(spaces * n) / F.sum(n)).alias("avg_word_count"))
        folded = signals.groupBy("column", ws_strip(v).alias("s")).agg(F.count(F.lit(1)).alias("n")).groupBy("column", F.lower("s").alias("l")).agg(F.count(F.lit(1)).alias("spellings")).groupBy("column").agg(F.bool_or(F.col("spellings") > 1).alias("has_case_inconsistency"))
        out = out.join(F.broadcast(texts), "column", "left").join(F.broadcast(folded), "column", "left")
    profile = written(out, "profile")
    for table in [*kept, *([counted] if counted is not None else [])]:
        discard(table)
    return profile


def column_roles(profile: DataFrame, sheet: bool = False) -> DataFrame:
    """Flags per column: short text, likely id, target candidate, high null share, near constant."""
    rows, unique = F.col("row_count"), F.col("unique_count")
    high = (F.col("unique_ratio") >= ID_UNIQUE) & (F.col("null_ratio") <= 0.05) & (rows > 0)
    named = F.contains(F.lower("column"), F.lit("id")) | F.col("inferred_type").isin("int", "bigint", "string")
    distinct = F.floor(F.round("unique_ratio", 4) * rows) if sheet else unique
    return profile.select(
        "*",
        (F.coalesce(F.col("avg_word_count") < SHORT_TEXT_WORDS, F.lit(False)) if "avg_word_count" in profile.columns else F.lit(False)).alias("is_short_text"),
        (high if sheet else high & named).alias("is_likely_id"),
        ((distinct > 1) & (distinct <= F.greatest(F.lit(20), F.floor(0.2 * rows)))).alias("is_target_candidate"),
        (F.col("null_ratio") >= HIGH_NULL).alias("is_high_null"),
        ((F.col("unique_ratio") <= NEAR_CONSTANT) & (rows >= SMALL_ROWS)).alias("is_near_constant"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: row_count, duplicate_rows (every member of a repeated group counts) and duplicate_ratio."""
    groups = df.groupBy(*[_c(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    sums = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("duplicate_rows"))
    return sums.withColumn("duplicate_ratio", ratio(F.col("duplicate_rows"), F.col("row_count")))


def total_missing(df: DataFrame) -> Column:
    """Aggregate: nulls in all columns together."""
    return reduce(lambda a, b: a + b, [F.count_if(_c(c).isNull()) for c in df.columns])


def table_warnings(profile: DataFrame, duplicates: DataFrame, sheet: bool = False) -> DataFrame:
    """One row: warnings and risk_flags, sorted and distinct, from the column profile and the duplicate row."""
    roles = column_roles(profile, sheet)
    c, four = F.col("column"), lambda x: F.format_string("%.4f", x)
    has = set(profile.columns)
    per = [
        F.when(F.col("null_ratio") >= 0.10, F.concat(F.lit("missing_values:"), c, F.lit(":"), four(F.col("null_ratio")))),
        F.when(F.col("is_near_constant"), F.concat(F.lit("low_variance_column:"), c)),
    ]
    if not sheet:
        per += [F.when(F.col("has_whitespace_issues"), F.concat(F.lit("whitespace_issues:"), c))] if "has_whitespace_issues" in has else []
        per += [F.when(F.col("has_case_inconsistency"), F.concat(F.lit("case_inconsistency:"), c))] if "has_case_inconsistency" in has else []
        per += [F.when(F.col("outlier_count") > 0, F.concat(F.lit("outliers_detected:"), c, F.lit(":"), F.col("outlier_count").cast("string")))] if "outlier_count" in has else []
    flags = [F.when(F.col("is_high_null"), F.concat(F.lit("high_missing_ratio:"), c)), F.when(F.col("is_near_constant"), F.concat(F.lit("near_constant_column:"), c))]
    sentinels = F.coalesce(F.sum("sentinel_count"), F.lit(0)) if "sentinel_count" in has else F.lit(0)
    gathered = roles.agg(F.flatten(F.collect_list(F.array(*per))).alias("w"), F.flatten(F.collect_list(F.array(*flags))).alias("f"), sentinels.alias("s"))
    rows, dup = F.col("row_count"), F.col("duplicate_ratio")
    own = [F.when((rows < SMALL_ROWS) & ((rows > 0) | F.lit(sheet)), F.concat(F.lit("small_dataset_rows:"), rows.cast("string")))]
    own += [F.when(rows == 0, F.lit("sheet_empty" if sheet else "csv_empty_dataset"))]
    own += [F.when(dup >= 0.10, F.concat(F.lit("duplicate_rows:"), four(dup)))] if sheet else [F.when(dup > 0, F.concat(F.lit("duplicate_rows_detected:"), four(dup))), F.when(F.col("s") > 0, F.concat(F.lit("sentinel_values_detected:"), F.col("s").cast("string")))]
    risks = [F.when(rows == 0, F.lit("empty_sheet" if sheet else "empty_dataset")), F.when(dup >= 0.10, F.lit("high_duplicate_row_ratio"))]
    tidy = lambda parts, more: F.array_sort(F.array_distinct(F.filter(F.concat(F.array(*parts), more), lambda x: x.isNotNull())))
    empty = F.array().cast("array<string>")
    more = lambda name: F.when(rows == 0, empty).otherwise(F.coalesce(F.col(name), empty))
    return duplicates.crossJoin(F.broadcast(gathered)).select(tidy(own, more("w")).alias("warnings"), tidy(risks, more("f")).alias("risk_flags"))


def sample_rows(df: DataFrame, key: str, k: int = 300, seed: int = 42) -> DataFrame:
    """At most k rows, by md5 of seed and key: the same rows on any partitioning."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string")))
    return df.orderBy(order, _c(key)).limit(k)


def clean_rows(df: DataFrame) -> DataFrame:
    """Strings stripped; sentinels become null."""
    strings = set(string_columns(df))
    return df.select(*[F.when(~is_sentinel(_c(c)), ws_strip(_c(c))).alias(c) if c in strings else _c(c) for c in df.columns])


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """(column, value, n, rank): the k most frequent non-null values of each column, ties by value."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return value_counts(df).where("value IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def column_summary(df: DataFrame) -> DataFrame:
    """(column, summary): range, mean and spread of numbers (2 decimals), or the most frequent values."""
    numbers = numeric_columns(df)
    two = lambda x: F.format_string("%.2f", x)
    rest = df.select(*[_c(c) for c in df.columns if c not in numbers])
    parts = []
    if numbers:
        stats = _per_column(df, numbers, lambda c: {"lo": F.min(_c(c)).cast("double"), "hi": F.max(_c(c)).cast("double"), "m": F.avg(_c(c)).cast("double"), "s": F.stddev_samp(_c(c)).cast("double")})
        parts.append(stats.select("column", F.concat(F.lit("range="), two(F.col("lo")), F.lit(".."), two(F.col("hi")), F.lit(", mean="), two(F.col("m")), F.lit(", std="), two(F.coalesce("s", F.lit(0.0)))).alias("summary")))
    if rest.columns:
        tops = top_values(rest).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))).alias("t"))
        parts.append(tops.select("column", F.concat_ws(", ", F.transform("t", lambda x: x["t"])).alias("summary")))
    return reduce(DataFrame.unionByName, parts)


def dataset_size(docs: DataFrame, text_col: str = "text", file_col: str = "source") -> DataFrame:
    """One row over many files: n_files, n_rows, n_words, n_chars."""
    from corvane.functions.text import word_count

    return docs.agg(F.count_distinct(file_col).alias("n_files"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(word_count(text_col)), F.lit(0)).cast("bigint").alias("n_words"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("bigint").alias("n_chars"))
