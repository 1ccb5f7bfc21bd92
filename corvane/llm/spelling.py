"""Spelling variants of words: near words by letter parity, and the frequent form that each rare word stands for.

One inserted or deleted code point flips one bit of a word's letter parities, a replaced one flips two. The parities are
split into three bands, so words that are near agree in one band at least (in two, if their lengths differ). Common words share bands by the thousand, so
words meet on equal bands together with what an edit leaves alone: of three parts of the shorter word, two are unchanged.
Every meeting is verified by edit distance and counted once, at the first part and band on which the two agree.

Defined cases: null and empty texts have no words; a null id is written `null` where the id enters a hash; rows that repeat
count each time; equal counts go to the smaller word in code-point order; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
BANDS, PARTS = 3, 3
PARITIES = [f"p{i}" for i in range(BANDS)]


def lower_ascii(text: Column) -> Column:
    return F.when(text.rlike("[A-Z]"), F.translate(text, CAPITALS, SMALL)).otherwise(text)


def letter_runs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): each maximal run of at least `least` letters, A-Z in lower case."""
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))


def with_slips(runs: DataFrame, every: int = 31) -> DataFrame:
    """(word): the runs, but those whose hash with their document's id is divisible by `every` lack one code point."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def _bit(letter: Column) -> Column:
    """a-z are 0 to 25, the others follow by code point; a letter's band is its bit modulo three."""
    code = F.ascii(letter)
    return F.when(code >= 0xC0, code - 0xC0 + 26).otherwise(code - 97)


def _odd(bits: Column, band: int) -> Column:
    """The bits of a band that occur an odd number of times."""
    place = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), (b / BANDS).cast("int"))
    return F.aggregate(F.filter(bits, lambda b: b % BANDS == band), F.lit(0).cast("bigint"), lambda m, b: m.bitwiseXOR(place(b)))


def with_parities(words: DataFrame) -> DataFrame:
    """Adds `len` and, for each band, the letters that occur an odd number of times as bits: `p0`, `p1`, `p2`."""
    bits = F.transform(F.split("word", ""), _bit)
    bands = [_odd(F.col("bits"), band) for band in range(BANDS)]
    return words.withColumn("bits", bits).select("word", "n", F.length("word").alias("len"), *[m.cast("int").alias(p) for m, p in zip(bands, PARITIES, strict=True)])


def _cut(word: Column, shorter: Column, part: Column) -> tuple[Column, Column]:
    """(rest, middle): a word without and with only one of its parts, if the shorter of two near words has `shorter` letters."""
    head, tail = (F.floor(shorter * i / PARTS).cast("int") for i in (part, part + 1))
    behind = F.length(word) - shorter + tail
    return F.concat(F.substring(word, F.lit(1), head), F.lit("|"), F.substring(word, behind + 1, shorter - tail)), F.substring(word, head + 1, behind - head)


def _keyed(words: DataFrame, shorter: Column, bands: list[list[int]], name: str) -> DataFrame:
    """A row for each part and set of bands, with the key on which near words meet: length, part, equal bands, the word's rest."""
    parts = words.select("word", "n", *PARITIES, shorter.alias("shorter"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    rest, _ = _cut(F.col("word"), F.col("shorter"), F.col("part"))
    some = [F.struct(F.lit(k).alias("k"), *[F.col(f"p{b}").alias(f"x{i}") for i, b in enumerate(bs)]) for k, bs in enumerate(bands)]
    rows = parts.withColumn("rest", rest).select("*", F.explode(F.array(*some)).alias("band"))
    own = [F.col(c).alias(f"{name}_{c}") for c in ("word", "n", *PARITIES)]
    return rows.select(F.xxhash64("shorter", "part", "band", "rest").alias("key"), (F.col("part") * len(bands) + F.col("band.k")).cast("tinyint").alias("way"), F.col("shorter").cast("int").alias("shorter"), *own)


def _met(a: DataFrame, b: DataFrame, bands: list[list[int]], further: str) -> DataFrame:
    """Pairs at edit distance one, each once: at the first part and set of bands where both agree.

    Words that agree beside one part are as far apart as these parts.
    """
    flipped = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES), F.lit(0))
    same_bands = F.coalesce(*[F.when(F.expr(" AND ".join(f"a_p{x} = b_p{x}" for x in bs)), F.lit(k)) for k, bs in enumerate(bands)])
    cut = lambda side, part: _cut(F.col(f"{side}_word"), F.col("shorter"), part)
    same_rest = F.coalesce(*[F.when(cut("a", F.lit(i))[0] == cut("b", F.lit(i))[0], F.lit(i)) for i in range(PARTS)])
    part = F.floor(F.col("way") / len(bands))
    pairs = a.join(b, ["key", "way", "shorter"]).where(further).where(flipped <= 2).where(F.levenshtein(cut("a", part)[1], cut("b", part)[1], 1) == 1)
    # A key is a hash: what it stands for is compared here.
    return pairs.where(F.col("way") == same_rest * len(bands) + same_bands).select("a_word", "a_n", "b_word", "b_n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words (word, n) that one edit parts."""
    words = materialise(with_parities(words), "parities")
    one, two = [[0], [1], [2]], [[0, 1], [0, 2], [1, 2]]
    replaced = _met(_keyed(words, F.col("len"), one, "a"), _keyed(words, F.col("len"), one, "b"), one, "a_word < b_word")
    inserted = _met(_keyed(words, F.col("len"), two, "a"), _keyed(words, F.col("len") - 1, two, "b"), two, "true")
    pairs = replaced.unionByName(inserted)
    side = lambda x, y: F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_word").alias("near"), F.col(f"{y}_n").alias("near_n"))
    return pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: pointers are doubled until none moves."""
    found = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = F.col("next").isNotNull()
        step = found.join(found.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        if step.where(further).isEmpty():
            return found
        moved = materialise(step.select("word", F.coalesce("next", "root").alias("root")), "forms")
        discard(found)
        found = moved


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """For each word of (word, n): form, root, n, n_near, form_n.

    A word's form is its near word of largest count, if that is at least `times` the word's own; counts rise along forms, so
    that they have no cycle and end after the logarithm of the largest count.
    """
    words = materialise(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    best = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    wins = -F.col("best.order") >= times * F.col("n")
    best = materialise(best.select("word", "n_near", F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.order")).alias("form_n")), "near-words")
    ends = roots(best.where("form IS NOT NULL"))
    return words.join(best, "word", "left").join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
