"""Text quality, language, sentences, structure and snippets of documents, one row per document.

Null text counts as empty. All ratios are unrounded; messages round as printf does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import bound, col, literal_set, nfkc, ratio, repeats, spread, stripped_lines, word_count, word_tokens, words, ws_strip

# Frequent words that mark a language, in the order in which ties are settled.
LANGUAGE_MARKERS = {
    "fr": "le la les de du des un une est sont que qui dans avec pour sur par mais aussi cette tout plus pas au aux leur leurs".split(),
    "en": "the a an is are was were of in on at to for with this that it its be have has had not by from they we you".split(),
    "ar": "في من على إلى هذا هذه التي الذي كان مع عن أن لا ما كل قد إن عند بين".split(),
}
LANGUAGE_SAMPLE, LANGUAGE_LEAST = 3000, 3
#: Characters that are neither printable nor a line feed, tab or space: Unicode categories C and Z.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^\n\t ]]"


def _text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def printed(c: Column, digits: int) -> Column:
    """A number of at least 0 with so many decimals as printf has them: by its binary value, an exact half to the even digit."""
    p = float(10**digits)

    def nearest(x: Column) -> Column:
        t = x * p
        # Where the product looks like a half, its rounding error (x split in two, so that both products are exact) tells the side.
        high = x * 134217729.0 - (x * 134217729.0 - x)
        error = (high * p - t) + (x - high) * p
        low = F.floor(t)
        return F.when(t - low != 0.5, F.floor(t + 0.5)).when(error > 0, low + 1).when(error < 0, low).otherwise(low + low % 2)

    return F.format_string(f"%.{digits}f", bound(c.cast("double"), lambda x: nearest(x) / F.lit(p)))


def normalise(c: Column | str, compatibility: bool = True) -> Column:
    """Compatibility form (NFKC), then every run of white space as one space, stripped."""
    c = nfkc(c) if compatibility else col(c)
    return ws_strip(F.regexp_replace(c, r"(?U)\s+", " "))


def garbled_ratio(c: Column | str) -> Column:
    """Share of replacement and unprintable characters; 1 for empty text."""
    c = _text(c)
    bad = F.length(c) - F.length(F.regexp_replace(c, UNPRINTABLE, "")) + F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return F.when(c == "", 1.0).otherwise(ratio(bad, F.length(c)))


def repeated_lines(c: Column | str) -> Column:
    """struct<lines,repeated>: non-blank lines of a document, and how many of them occur more than once in it."""
    return bound(F.array_sort(stripped_lines(_text(c))), lambda l: F.struct(F.size(l).alias("lines"), F.size(F.filter(l, lambda x, i: repeats(l, x, i))).alias("repeated")))


def boilerplate_ratio(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, line_count, boilerplate_ratio): share of non-blank lines that occur more than once in their document."""
    counted = docs.select(key, repeated_lines(text_col).alias("l"))
    return counted.select(key, F.col("l.lines").cast("bigint").alias("line_count"), ratio(F.col("l.repeated"), F.col("l.lines")).alias("boilerplate_ratio"))


def language(c: Column | str) -> Column:
    """The language with most distinct marker words among the first characters; fewer than three: unknown."""
    tokens = word_tokens(F.left(_text(c), F.lit(LANGUAGE_SAMPLE)))
    votes = lambda t: F.struct(*[F.size(F.array_intersect(literal_set(v), t)).alias(k) for k, v in LANGUAGE_MARKERS.items()])

    def won(v: Column) -> Column:
        best = F.greatest(*[v[k] for k in LANGUAGE_MARKERS])
        return reduce(lambda acc, k: acc.when(v[k] == best, F.lit(k)), LANGUAGE_MARKERS, F.when(best < LANGUAGE_LEAST, F.lit("unknown")))

    return bound(bound(tokens, votes), won)


def sentences(c: Column | str, least: int = 6) -> Column:
    """Pieces behind `.`, `!` or `?` and white space, stripped, of at least so many characters."""
    pieces = F.transform(F.split(ws_strip(_text(c)), r"(?<=[.!?])(?U)\s+"), ws_strip)
    return F.filter(pieces, lambda s: F.length(s) >= least)


def lexical_diversity(c: Column | str, sample: int = 500) -> Column:
    return bound(F.slice(words(F.lower(_text(c))), 1, sample), lambda first: ratio(F.size(F.array_distinct(first)), F.size(first)))


def structure_hints(c: Column | str) -> Column:
    rows = stripped_lines(_text(c))
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    heading = lambda x: (F.length(x) < 120) & (upper(x) | x.rlike(r"^\d+(\.\d+)*(?U)\s+") | x.endswith(":"))
    headed = F.size(F.filter(F.slice(rows, 1, 300), heading)) >= 3
    contents = F.exists(F.slice(rows, 1, 60), lambda x: F.contains(F.lower(x), F.lit("table of contents")))
    found = F.filter(F.array(F.when(headed, F.lit("contains_heading_like_structure")), F.when(contents, F.lit("possible_table_of_contents"))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unstructured_or_light_structure")))


def snippets(c: Column | str) -> Column:
    """Head, middle and tail of 400 characters each."""
    c = _text(c)
    half = F.floor(F.length(c) / 2).cast("int")
    start = F.greatest(half - 200, F.lit(0))
    return F.struct(F.left(c, F.lit(400)).alias("head"), F.substring(c, start + 1, half + 200 - start).alias("middle"), F.right(c, F.lit(400)).alias("tail"))


def text_profile(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, quality, language, sentence statistics, suitability, warnings, risk flags."""
    text = _text(text_col)
    stripped = ws_strip(F.col("text"))
    measures = lambda p: F.struct(F.size(p).alias("n"), F.aggregate(p, F.lit(0), lambda a, x: a + x).alias("total"), F.size(F.filter(p, lambda x: x < 5)).alias("few"), F.size(F.filter(p, lambda x: x > 60)).alias("many"))
    per_sentence = bound(F.transform(sentences("text"), word_count), measures)
    counted = spread(docs.select(key, text.alias("text")), key).select(key, "text", per_sentence.alias("s"), repeated_lines("text").alias("l"), (F.length(stripped) < 50).alias("short"))
    n, short = F.col("s.n"), F.col("short")
    zero = lambda x: F.when(short, 0.0).otherwise(x)
    out = counted.select(
        key,
        F.length("text").alias("char_count"),
        word_count("text").alias("word_count"),
        F.col("l.lines").alias("line_count"),
        garbled_ratio("text").alias("garbled_ratio"),
        F.when(short, "unknown").otherwise(language("text")).alias("language"),
        F.when(short, 0).otherwise(n).alias("sentence_count"),
        zero(ratio(F.col("s.total"), n)).alias("avg_sentence_length"),
        zero(ratio(F.col("s.few"), n)).alias("short_sentence_ratio"),
        zero(ratio(F.col("s.many"), n)).alias("long_sentence_ratio"),
        zero(lexical_diversity("text")).alias("lexical_diversity"),
        short.alias("too_short"),
        (F.col("text") == "").alias("is_empty"),
        ratio(F.col("l.repeated"), F.col("l.lines")).alias("boilerplate_ratio"),
    )
    diversity, shorts, mean, count = (F.col(x) for x in ("lexical_diversity", "short_sentence_ratio", "avg_sentence_length", "sentence_count"))
    rules = [(diversity < 0.3, 3, F.concat(F.lit("low_lexical_diversity:"), printed(diversity, 2))), (shorts > 0.5, 2, F.concat(F.lit("many_short_fragments:"), F.concat(printed(shorts * 100, 0), F.lit("%")))), (mean < 5, 2, F.concat(F.lit("very_short_avg_sentence:"), printed(mean, 1), F.lit("_words"))), (count < 5, 2, F.concat(F.lit("very_few_sentences:"), count.cast("string")))]
    lost = reduce(lambda a, b: a + b, [F.when(test, tenths).otherwise(0) for test, tenths, _ in rules])
    notes = F.filter(F.array(*[F.when(test, note) for test, _, note in rules], F.when(F.col("language") == "unknown", F.lit("language_not_detected"))), lambda x: x.isNotNull())
    noise = F.filter(F.array(F.when(F.col("is_empty"), F.lit("empty_text")), F.when((F.col("garbled_ratio") > 0.1) & ~F.col("is_empty"), F.lit("high_garbled_ratio")), F.when(F.col("boilerplate_ratio") > 0.3, F.lit("high_boilerplate"))), lambda x: x.isNotNull())
    out = out.withColumn("suitability", F.when(F.col("too_short"), 0.0).otherwise((10 - lost) / 10)).withColumn("suitability_warnings", F.when(F.col("too_short"), F.array(F.lit("text_too_short"))).otherwise(notes)).withColumn("suspected_noise", noise)
    flags = F.array(F.when(F.col("garbled_ratio") > 0.2, F.lit("high_garbled_text")), F.when(F.col("boilerplate_ratio") > 0.3, F.lit("high_boilerplate_text")), F.when(F.col("suitability") < 0.4, F.lit("low_training_suitability")), F.when(F.col("is_empty"), F.lit("empty_extraction")))
    prefixed = F.concat(F.transform("suspected_noise", lambda x: F.concat(F.lit("text_noise:"), x)), F.transform("suitability_warnings", lambda x: F.concat(F.lit("training:"), x)))
    return out.withColumn("warnings", F.array_sort(F.array_distinct(prefixed))).withColumn("risk_flags", F.array_sort(F.filter(flags, lambda x: x.isNotNull()))).drop("too_short", "is_empty")
