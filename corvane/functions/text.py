"""Text expressions with Unicode white space and words, all of them built-in functions.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt to all cores where its source comes in fewer parts than there are cores, as a small file does; costly text work follows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or len(df._jdf.inputFiles()) >= cores:  # the names stay in the JVM, of which there may be very many
        return df
    return df.repartition(cores, *keys)


def ws_strip(c: Column | str) -> Column:
    """Strip Unicode white space at both ends (Spark's trim strips spaces only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """Runs between white space."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def stripped_lines(c: Column | str) -> Column:
    """The lines that are not blank, stripped."""
    return F.filter(F.transform(lines(c), ws_strip), lambda x: x != "")


def repeats(sorted_items: Column, item: Column, i: Column) -> Column:
    """Whether the i-th item of a sorted array occurs in it more than once."""
    return (item == F.get(sorted_items, i - 1)) | (item == F.get(sorted_items, i + 1))


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0)))


def literal_set(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column | str, needles: Iterable[str]) -> Column:
    """Plain substring test against lower-case needles."""
    return F.exists(literal_set(needles), lambda n: F.contains(F.lower(col(c)), n))


def count_contained(c: Column | str, needles: Iterable[str]) -> Column:
    return F.size(F.filter(literal_set(needles), lambda n: F.contains(F.lower(col(c)), n)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t)).astype(object)


def nfkc(c: Column | str) -> Column:
    """NFKC form. There is no built-in for it; texts of ASCII only do not need it, and Python gets nulls in their place."""
    return F.coalesce(_nfkc(F.when(col(c).rlike(r"[^\x00-\x7F]"), col(c))), col(c))
