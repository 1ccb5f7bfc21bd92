"""A sentence splitter that learns from the texts it splits.

No list of abbreviations is given. Counts over the whole corpus tell which words are abbreviations, which words open sentences
and which pairs of words stand on both sides of a full stop without a sentence ending there, all by log-likelihood ratios
(after Kiss and Strunk, "Unsupervised multilingual sentence boundary detection", 2006). The counts are Spark aggregations; what
they lead to is a small table, whose size is checked before it goes to the tasks.

Defined cases: null text counts as empty and has no sentences; equal texts count each; without texts nothing is learned, and the
rule then is that of `profile_text.sentences`, but that a stop before a small letter ends nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import spread, words

#: Least log-likelihood ratios of an abbreviation (after its corrections), a collocation and a sentence starter, and the least counts of the last two.
ABBREVIATION, COLLOCATION, STARTER, LEAST_COUNT = 0.3, 7.88, 30.0, 2
#: Words that a table may hold: above it, the strongest are sent.
MOST_WORDS = 200_000
OPENING, CLOSING = "\"'“”‘’«»([{", "\"'“”‘’»)]}"
BREAK = re.compile(rf"([.!?]+[{re.escape(CLOSING)}]*)(\s+)")


def tokens_of(text: Column | str) -> Column:
    """The words of a text without the marks around them, but with a full stop behind them."""
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}.]+|[^\p{L}\p{N}.]+$", "")
    return F.filter(F.transform(words(text), bare), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def token_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, stop, next, next_capital): each word in small letters, whether a full stop is behind it, and the word behind that."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    listed = spread(docs.select(t.alias("text"))).select(tokens_of("text").alias("w"))
    each = listed.select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("x"), F.get(F.col("w"), i + 1).alias("y")))).alias("p"))
    plain = lambda c: F.lower(F.regexp_replace(c, r"\.+$", ""))
    return each.select(plain(F.col("p.x")).alias("word"), F.col("p.x").endswith(".").alias("stop"), plain(F.col("p.y")).alias("next"), F.col("p.y").rlike(r"^\p{Lu}").alias("next_capital"))


def word_stops(pairs: DataFrame) -> DataFrame:
    """(word, n, stops, before_small): how often each word occurs, with a full stop, and with one before a small letter."""
    small = F.col("stop") & ~F.coalesce("next_capital", F.lit(True))
    return pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("stop").alias("stops"), F.count_if(small).alias("before_small"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Log likelihood of k of n at probability p."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return k * F.log(q) + (n - k) * F.log(1 - q)


def abbreviations(stops: DataFrame, least: float = ABBREVIATION) -> DataFrame:
    """(word, score) of the words that are abbreviations: a full stop follows them nearly always, they are short or have stops inside."""
    totals = stops.agg(F.sum("n").alias("all"), F.sum("stops").alias("all_stops"))  # one row
    x = stops.where("stops > 0").crossJoin(F.broadcast(totals))
    n, k = F.col("n").cast("double"), F.col("stops").cast("double")
    ratio = 2 * (_log_likelihood(k, n, F.lit(0.99)) - _log_likelihood(k, n, F.col("all_stops") / F.col("all")))
    inside = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    letters = F.length("word") - inside
    without = n - k
    # Short words, stops inside and few occurrences without a stop speak for it; each correction is a factor. A stop before a small letter shows it.
    score = ratio * F.exp(-letters) * (inside + 1) * F.pow(letters.cast("double"), -without) * (1 + F.col("before_small"))
    return x.withColumn("score", F.round(score, 6)).where((F.col("score") >= least) & F.col("word").rlike(r"\p{L}")).select("word", "score")


def _dependence(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of two events that occur together `both` times, by themselves `first` and `second` times of `total`."""
    p, p1, p2 = second / total, both / first, (second - both) / F.greatest(total - first, F.lit(1.0))
    return 2 * (_log_likelihood(both, first, p1) + _log_likelihood(second - both, total - first, p2) - _log_likelihood(both, first, p) - _log_likelihood(second - both, total - first, p))


def starters(pairs: DataFrame, short: DataFrame, least: float = STARTER) -> DataFrame:
    """(word, score) of the words that open sentences more often than chance has it: behind a full stop that is no abbreviation's."""
    ends = pairs.where("stop").join(F.broadcast(short.select("word").withColumn("short", F.lit(True))), "word", "left").where("short IS NULL")
    opened = ends.where("next IS NOT NULL AND next_capital").groupBy(F.col("next").alias("word")).agg(F.count(F.lit(1)).alias("both"))
    totals = pairs.agg(F.count(F.lit(1)).alias("total")).crossJoin(ends.agg(F.count(F.lit(1)).alias("breaks")))  # one row
    x = opened.join(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word").crossJoin(F.broadcast(totals))
    d = lambda c: F.col(c).cast("double")
    score = _dependence(d("both"), d("breaks"), d("n"), d("total"))
    usual = d("both") / d("breaks") > d("n") / d("total")
    return x.withColumn("score", F.round(score, 6)).where((F.col("both") >= LEAST_COUNT) & usual & (F.col("score") >= least)).select("word", "score")


def collocations(pairs: DataFrame, short: DataFrame, opening: DataFrame, least: float = COLLOCATION) -> DataFrame:
    """(word, next, score) of pairs around a stop behind an abbreviation, an initial or a number that depend on each other, as in `No. 5`; words that open sentences are in none."""
    known = pairs.join(F.broadcast(short.select("word").withColumn("short", F.lit(True))), "word", "left")
    around = known.where("stop AND next IS NOT NULL").where(F.col("short") | F.col("word").rlike(r"^(\p{L}|\p{N}+)$"))
    both = around.groupBy("word", "next").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= LEAST_COUNT).join(F.broadcast(opening.select(F.col("word").alias("next"))), "next", "left_anti")
    n = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.count(F.lit(1)).alias("total"))  # one row
    x = both.join(n, "word").join(n.toDF("next", "m"), "next").crossJoin(F.broadcast(total))
    d = lambda c: F.col(c).cast("double")
    usual = d("both") / d("n") > d("m") / d("total")
    return x.withColumn("score", F.round(_dependence(d("both"), d("n"), d("m"), d("total")), 6)).where(usual & (F.col("score") >= least)).select("word", "next", "score")


@dataclass
class SentenceModel:
    abbreviations: frozenset[str]
    starters: frozenset[str]
    collocations: frozenset[tuple[str, str]]


NOTHING_LEARNED = SentenceModel(frozenset(), frozenset(), frozenset())


def fit_sentences(docs: DataFrame, text_col: str = "text") -> SentenceModel:
    """Learn from all texts of `docs`. The pairs are counted once for each table; of more than MOST_WORDS rows of one the strongest stay."""
    pairs = token_pairs(docs, text_col)
    short = abbreviations(word_stops(pairs))
    strongest = lambda df, *c: df.orderBy(F.desc("score"), *c).limit(MOST_WORDS).collect()  # noqa: E731  bounded
    table = lambda found: docs.sparkSession.createDataFrame([(w,) for w in found], "word string")
    known = [r["word"] for r in strongest(short, "word")]
    opening = [r["word"] for r in strongest(starters(pairs, table(known)), "word")]
    fixed = [(r["word"], r["next"]) for r in strongest(collocations(pairs, table(known), table(opening)), "word", "next")]
    return SentenceModel(frozenset(known), frozenset(opening), frozenset(fixed))


def _plain(word: str) -> str:
    return word.strip(OPENING + CLOSING + ",;:").rstrip(".").lower()


def breaks(text: str, model: SentenceModel) -> Iterator[int]:
    """Where sentences end in a stripped text: behind marks and before white space."""
    for m in BREAK.finditer(text):
        before = re.search(r"\S*$", text[max(0, m.start() - 80) : m.start()])[0]
        after = re.match(r"\S*", text[m.end() : m.end() + 80])[0]
        word, following = _plain(before), _plain(after)
        first = after.lstrip(OPENING)[:1]
        if m[1][0] == "." and len(m[1].rstrip(CLOSING)) == 1:
            initial = len(word) == 1 and word.isalpha() and before[-1:].isupper()
            number = word.isdigit()
            if (word, following) in model.collocations:
                continue
            if word in model.abbreviations or initial:
                # Behind an abbreviation only a word that opens sentences, with a capital, begins one; behind an initial none does.
                if initial or not (first.isupper() and following in model.starters):
                    continue
            elif first.islower() or (number and not first.isupper()):
                continue
        elif first.islower() and (m[1].endswith(tuple(CLOSING)) or m[1].startswith("..")):
            continue
        yield m.end(1)


def split(text: str | None, model: SentenceModel = NOTHING_LEARNED, least: int = 1) -> list[str]:
    """The sentences of a text, stripped, of at least so many characters."""
    text = (text or "").strip()
    out, at = [], 0
    for end in [*breaks(text, model), len(text)]:
        s = text[at:end].strip()
        at = end
        if s and len(s) >= least:
            out.append(s)
    return out


def trained_sentences(docs: DataFrame, model: SentenceModel, text_col: str = "text", out_col: str = "sentences", least: int = 1) -> DataFrame:
    """`docs` with the sentences of each text, split in Arrow batches by the broadcast model."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        for s in batches:
            yield s.map(lambda t: split(t, known, least))

    return spread(docs).withColumn(out_col, cut(F.col(text_col)))
