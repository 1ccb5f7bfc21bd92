"""Cleaning of extracted text. Null stays null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import bound, col, lines, ratio, spread, words, ws_strip

# Image file endings, and openings of answers that name their source.
IMAGE_ENDINGS = "jpeg|jpg|png|gif|webp|svg|figure"
ANSWER_LEAKS = [
    r"^\s*(?:according to|per|as stated in|as per|based on)\s+(?:the\s+)?(?:text|document|abstract|article|paper|passage|timeline|figure|author)[,:\s]+",
    r"^\s*the\s+(?:text|document|abstract|article|paper|passage|timeline|figure)\s+(?:says|states|explains|mentions|describes|notes|indicates|reports|claims)[,:\s]+",
    r"^\s*(?:selon|d['’]après|comme (?:le )?(?:précise|indique|mentionne))\s+(?:le\s+)?(?:texte|document|article|passage|auteur)[,:\s]+",
    r"^\s*le\s+(?:texte|document|article|passage)\s+(?:dit|précise|explique|mentionne|décrit|indique)[,:\s]+",
]
# What converters leave behind, and what takes its place; lines that hold a page number only.
ARTEFACTS = [
    (rf"(?i)!\s*\[[^\]]*\]\([^)]*\.({IMAGE_ENDINGS})[^)]*\)", ""),
    (rf"(?im)^\s*\[\]\([^)]*\.({IMAGE_ENDINGS})[^)]*\)\s*$", ""),
    (r"(?is)<span[^>]*>.*?</span>", ""),
    (r"\[([^\]]*)\]\(#[^)]+\)", "$1"),
    (r"(?i)<sup>\d+</sup>", ""),
    (r"\n{3,}", "\n\n"),
]
NUMBER_LINE, PAGE_LINE = r"^[-\s]*\d{1,4}[-\s]*$", r"(?i)^page\s+\d+(\s+of\s+\d+)?$"


def strip_artefacts(c: Column | str) -> Column:
    """Image links, bare image lines, span anchors, internal links (their label stays), footnote marks."""
    return ws_strip(reduce(lambda acc, x: F.regexp_replace(acc, x[0], x[1]), ARTEFACTS, col(c)))


def pre_clean(c: Column | str) -> Column:
    """No byte order mark or control characters (form feeds too) but line feed, tab and return; line ends as \\n; words cut at a line end joined."""
    c = F.regexp_replace(F.replace(col(c), F.lit("﻿"), F.lit("")), r"[\x00-\x1F&&[^\n\t\r]]", "")
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def drop_noise_lines(c: Column | str) -> Column:
    """Without page numbers and lines that have no letter or digit; blank lines stay."""

    def keep(line: Column) -> Column:
        s = ws_strip(line)
        number = s.rlike(NUMBER_LINE) & (F.length(s) <= 8)
        page = s.rlike(PAGE_LINE)
        return ~number & ~page & ((s == "") | s.rlike(r"[a-zA-Z0-9؀-ۿ]"))

    return F.array_join(F.filter(lines(c), keep), "\n")


def squeeze(c: Column | str) -> Column:
    """Runs of spaces and tabs as one space, lines stripped, at most one blank line in a row."""
    tidy = F.transform(lines(c), lambda x: ws_strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.regexp_replace(F.array_join(tidy, "\n"), r"\n{3,}", "\n\n")


def drop_repeated_lines(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """`text_col` without any copy of the lines that repeat, where a document has ten or more lines of over three characters."""
    return docs.withColumn(text_col, without_repeated_lines(text_col))


def without_repeated_lines(c: Column | str) -> Column:
    """The same of one text: its lines are sorted, so a line repeats so often if the one so many places on is the same."""

    def kept(long: Column) -> Column:
        least = F.greatest(F.lit(3), F.floor(F.size(long) * 0.02)).cast("int")
        repeated = F.array_distinct(F.filter(long, lambda x, i: x == F.get(long, i + least - 1)))
        gone = bound(repeated, lambda g: F.map_from_arrays(g, F.array_repeat(F.lit(True), F.size(g))))
        return bound(gone, lambda g: F.array_join(F.filter(lines(c), lambda x: F.try_element_at(g, ws_strip(x)).isNull()), "\n"))

    long_lines = F.array_sort(F.filter(F.transform(lines(c), ws_strip), lambda x: F.length(x) > 3))
    return bound(long_lines, lambda long: F.when(F.size(long) >= 10, kept(long)).otherwise(col(c)))


def clean_documents(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, original_chars, cleaned_chars, removed_percent): the whole cleaning."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    staged = spread(docs, key).select(key, F.length(c).alias("original_chars"), drop_noise_lines(pre_clean(strip_artefacts(c))).alias("text"))
    done = drop_repeated_lines(staged, key, "text").withColumn("text", squeeze("text"))
    return with_report(done)


def with_report(df: DataFrame) -> DataFrame:
    """cleaned_chars and removed_percent (one decimal) beside original_chars and text."""
    size = F.length("text")
    return df.withColumn("cleaned_chars", size).withColumn("removed_percent", F.round(100 * (1 - F.coalesce(F.try_divide(size.cast("double"), F.col("original_chars")), F.lit(1.0))), 1))


def filter_paragraphs(c: Column | str) -> Column:
    """Paragraphs with spaces, emoji, tags and links tidied that have 5 to 50000 words, at most 0.4 symbols a word and at least 0.05 distinct words a word; the text itself if under a tenth stays."""
    c = col(c)
    tidy = lambda p: ws_strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"<[^>]+>|https?://\S+", ""), r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", ""), r"(?U)\s+", " "))

    def keep(p: Column) -> Column:
        n = F.size(words(p))
        symbols = F.size(F.regexp_extract_all(p, F.lit(r"#|\.\.\.|…"), F.lit(0)))
        return n.between(5, 50000) & (ratio(symbols, n) <= 0.4) & (ratio(F.size(F.array_distinct(words(F.lower(p)))), n) >= 0.05)

    kept = F.array_join(F.filter(F.transform(F.filter(F.split(c, "\n\n"), lambda p: ws_strip(p) != ""), tidy), keep), "\n\n")
    return F.when(F.length(kept) < 0.10 * F.length(c), c).otherwise(kept)


def sanitise_answer(c: Column | str) -> Column:
    """Without an opening that names the source; the first letter in upper case."""
    c = ws_strip(F.regexp_replace(col(c), "(?iu)" + "|".join(ANSWER_LEAKS), ""))
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.length(c)))
