"""Toxicity of whole texts behind a noisy channel: disguised spelling is undone first, then the restored words are scored.

Each token is a lattice: a symbol may stand for letters, be left out or part words; a letter written again may be one letter; single
characters with spaces between them may be one word. A Viterbi search finds the most probable restored text under a
character language model (four characters, counted over all documents) and the channel's costs. Log odds of the restored
words, counted by Spark over a bounded sample of the labelled texts (equal ones count once), and a logistic curve over a text's evidence score them.

Defined cases: null and empty texts have no words and get the score of none; rows that repeat and null ids get their scores each;
without a row of either label the score is the share of label 1 among the labelled rows, 0.5 without any; texts are restored whole; further columns stay as they are.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, materialise, small_batches, tidied

#: Symbols of the language model: 0 parts words, 1 to 26 are letters without their accents, 27 is any other character.
SYMBOLS, ORDER, OTHER = 28, 4, 27
#: What a symbol may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "¥": "y", "§": "s",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "α": "a", "ο": "o", "ι": "i", "*": "abcdefghijklmnopqrstuvwxyz",
}
#: Log probabilities of the channel.
STANDS, LEFT_OUT, PARTS_WORDS, ITSELF, WRITTEN_AGAIN, TWICE, KEPT_SPACE, SPACED_OUT = map(math.log, (0.3, 0.2, 0.4, 0.1, 0.1, 0.4, 0.5, 0.5))
#: Marks around a word are no disguise: punctuation behind it, stars that are more than one, whatever stands for no letter.
TAIL = ".,;:?!…\"'»”’)]}"
#: At least three single characters, each behind one to three spaces.
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S){2,}(?!\S)")
AGAIN = re.compile(r"(.)\1*", re.S)
REPEATED = re.compile(r"(.)\1+", re.S)
#: Tokens whose words a worker keeps.
CACHE_TOKENS = 400_000
#: The classifier: at most so many words, whose log odds are this at least after so many standard deviations are taken from them.
MOST_WORDS, LEAST_LOG_ODDS, DEVIATIONS = 2048, 1.0, 2.0
#: Labelled texts that the classifier learns from, about.
LABELLED_TEXTS = 20_000
#: A text's evidence is its most telling word's log odds and this share of the others': words of one text aren't independent.
OTHERS = 0.1


@functools.lru_cache(1 << 14)
def fold(char: str) -> str:
    """A small letter without accents and width; nothing for marks that are not seen; other characters as they are."""
    if unicodedata.category(char) in ("Cf", "Mn"):
        return ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) != "Mn").lower()
    return plain if plain and all("a" <= c <= "z" for c in plain) else "ss" if char == "ß" else char


def folded(text: str) -> str:
    text = text.lower()
    return text if text.isascii() else "".join(map(fold, text))


_MARKS = "".join(c for c in map(chr, range(0x21, 0x100)) if not c.isalnum() and c not in READINGS)


def bare(text: str) -> str:
    """A folded token without the marks around it."""
    text = text.rstrip(TAIL + _MARKS).lstrip(_MARKS)
    while text[-2:] == "**" or text[:2] == "**":
        text = text.strip("*").rstrip(TAIL + _MARKS).lstrip(_MARKS)
    return text


def skeleton(word: str) -> str:
    """A word whose equal neighbours are one letter: that of each of its readings, if it has letters only."""
    return REPEATED.sub(r"\1", word)


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """The symbol of each code point below U+0250 (others are 27): letters by their folded first letter, white space 0."""
    out = np.full(0x250, OTHER, np.uint8)
    for c in range(0x250):
        x = fold(chr(c).lower()[:1])
        out[c] = 0 if chr(c).isspace() else ord(x[0]) - 96 if x and "a" <= x[0] <= "z" else OTHER
    return out


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each run of ORDER symbols occurs in all texts; at most SYMBOLS ** ORDER rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        classes = _classes()
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            for at in range(0, len(texts), 256):
                codes = np.frombuffer(("   " + "    ".join(texts[at : at + 256]) + " ").encode("utf-32-le"), np.uint32)
                x = np.where(codes < len(classes), classes[np.minimum(codes, len(classes) - 1)], OTHER).astype(np.int32)
                grams = x[ORDER - 1 :].copy()
                for k in range(1, ORDER):
                    grams += x[ORDER - 1 - k : len(x) - k] * SYMBOLS**k
                total += np.bincount(grams, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(tidied(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the last symbol of each run of ORDER: each order is smoothed with the shorter one (Witten and Bell)."""
    c = counts.reshape([SYMBOLS] * ORDER).astype(float)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        n = c.sum(axis=tuple(range(ORDER - order)))
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        p = (n + kinds * p) / np.maximum(total + kinds, 1) + np.where(total == 0, p, 0)
    return np.log(p).ravel().astype(np.float32)


def fit_language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    for gram, n in gram_counts(docs, text_col).collect():  # bounded by the number of grams
        counts[gram] = n
    return language_model(counts)


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """The readings of each run of equal characters with their log probabilities; `spaced`: spaces may be left out."""
    out = []
    for m in AGAIN.finditer(token):
        c, n = m[1], len(m[0])
        if c.isspace():
            out.append([(" ", KEPT_SPACE), ("", SPACED_OUT)] if spaced else [(" ", 0.0)])
            continue
        if "a" <= c <= "z":
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, WRITTEN_AGAIN)] if n == 2 else [(c, 0.0), (c * 2, TWICE)])
            continue
        letters = READINGS.get(c, "")
        ways = [("", LEFT_OUT), (" ", PARTS_WORDS), ("\0", ITSELF)] if not c.isalpha() else [("\0", 0.0)]
        ways += [(x * k, STANDS - math.log(len(letters)) + (0.0 if k == 1 else TWICE)) for x in letters for k in range(1, min(n, 2) + 1)]
        out.append(ways)
    return out


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else OTHER


def viterbi(ways: list[list[tuple[str, float]]], model: list[float]) -> str:
    """The most probable text between two spaces; equal ones go to the smaller text."""
    size = SYMBOLS ** (ORDER - 1)
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # last symbols: log probability, readings, linked backwards
    for readings in [*ways, [(" ", 0.0)]]:
        further: dict[int, tuple[float, tuple]] = {}
        for state, (score, path) in states.items():
            for text, cost in readings:
                s, p = state, score + cost
                for c in text:
                    gram = s * SYMBOLS + _symbol(c)
                    p += model[gram]
                    s = gram % size
                known = further.get(s)
                if known is None or p > known[0]:
                    further[s] = (p, (path, text) if text else path)
        states = further
    _, path = max(states.values(), key=lambda x: x[0])
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


class Restorer:
    """Words of texts as they were meant; each distinct token is decoded once and kept."""

    def __init__(self, model: np.ndarray, known: frozenset[str] | None = None):
        self.model, self.known = model.tolist(), known  # if given, other words are left out
        self.skeletons = None if known is None else {skeleton(w) for w in known}
        self.words: dict[str, tuple[str, ...]] = {}

    def restore(self, token: str) -> str:
        """A token, or single characters with spaces between them, as words of letters with single spaces."""
        text = bare(folded(token))
        if text.isascii() and text.isalpha():
            if REPEATED.search(text) is None:
                return text
            if self.skeletons is not None and skeleton(text) not in self.skeletons:
                return ""  # none of its readings is known
        spaced = any(map(str.isspace, text))
        if not any("a" <= c <= "z" for c in text) and not (spaced and any(c in READINGS for c in text)):
            return ""
        runs = lattice(text, spaced)
        found = "".join(x[0][0] for x in runs) if all(len(x) == 1 for x in runs) else viterbi(runs, self.model)
        return " ".join(found.replace("\0", " ").split())

    def of(self, token: str) -> tuple[str, ...]:
        found = self.words.get(token)
        if found is None:
            if len(self.words) >= CACHE_TOKENS:
                self.words.clear()
            found = tuple(w for w in self.restore(token).split() if self.known is None or w in self.known)
            self.words[token] = found
        return found

    def words_of(self, text: str | None) -> set[str]:
        """The distinct restored words of a text."""
        if not text:
            return set()
        return set(chain.from_iterable(map(self.of, {*text.split(), *(m[0] for m in SPACED.finditer(text))})))


def with_words(docs: DataFrame, model: np.ndarray, text_col: str, known: list[str] | None, name: str, kind: T.DataType, value: Callable[[set[str]], object]) -> DataFrame:
    """Adds what `value` gives for the distinct restored words of each text (all, or those that are known)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model, None if known is None else frozenset(known)))
    names, schema = [*docs.columns, name], T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    at = docs.columns.index(text_col)
    arrow = pa.float64() if isinstance(kind, T.DoubleType) else pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*sent.value)
        for b in batches:
            found = pa.array([value(restorer.words_of(t)) for t in b.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=names)

    return docs.mapInArrow(tidied(run), schema)


def restored_words(docs: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """Adds `words`: the distinct restored words of each text in order; a column of this name is replaced."""
    return with_words(docs.drop("words"), model, text_col, None, "words", T.ArrayType(T.StringType()), sorted)


class Classifier:
    """Log odds of the telling words; intercept and slope of a logistic curve over a text's evidence."""

    def __init__(self, words: dict[str, float], intercept: float, slope: float):
        self.words, self.intercept, self.slope = words, intercept, slope

    def score(self, words: set[str]) -> float:
        z = self.intercept + self.slope * evidence([self.words[w] for w in words])
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def evidence(log_odds: list[float]) -> float:
    most = max(log_odds, default=0.0)
    return most + OTHERS * (math.fsum(log_odds) - most)


def log_odds(counts: DataFrame, n0: int, n1: int, most: int = MOST_WORDS) -> dict[str, float]:
    """Words of label 1 with lower bounds of their log odds, from (word, a, b): how many of n0 and n1 rows hold each."""
    if not n0 or not n1:
        return {}
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    low, high = (b - DEVIATIONS * F.sqrt(b)) / n1, (a + DEVIATIONS * F.sqrt(a + 1) + 1) / n0
    found = counts.where(low > 0).select("word", F.round(F.log(low / high), 9).alias("log_odds")).where(F.col("log_odds") >= LEAST_LOG_ODDS)
    return {r.word: r.log_odds for r in found.orderBy(F.desc("log_odds"), "word").limit(most).collect()}  # bounded


def fit_classifier(labelled: DataFrame, most: int = MOST_WORDS) -> Classifier:
    """From rows (words array, label 0 or 1): the telling words, and a logistic curve of the label over the evidence.

    The curve is fitted to the evidence that the words of one half of the rows give for the other half: words that are
    telling by chance are found out there.
    """
    rows = labelled.select("words", "label", F.pmod(F.xxhash64("words"), F.lit(2)).cast("int").alias("half"))
    n = {(r.half, r.label): r.n for r in rows.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    of = lambda label, halves: sum(n.get((h, label), 0) for h in halves)
    share = (of(1, (0, 1)) + 0.5) / (sum(n.values()) + 1)
    each = rows.select(F.explode("words").alias("word"), "label", "half")
    held = [F.sum(((F.col("label") == label) & (F.col("half") == half)).cast("bigint")).alias(f"{'ab'[label]}{half}") for label in (0, 1) for half in (0, 1)]
    counts = materialise(each.groupBy("word").agg(*held).where("b0 + b1 > 1"), "word-labels")
    telling = [log_odds(counts.select("word", *[sum(F.col(f"{c}{h}") for h in halves).alias(c) for c in "ab"]), of(0, halves), of(1, halves), most) for halves in ((0,), (1,), (0, 1))]
    discard(counts)
    if not telling[2]:
        return Classifier({}, math.log(share / (1 - share)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = [telling[1 - half] for half in b.column("half").to_pylist()]
            found = [round(evidence([known[w] for w in ws if w in known]), 1) for known, ws in zip(others, b.column("words").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), b.column("label")], names=["evidence", "label"])

    # Rounded to tenths, evidence has a bounded number of values.
    table = rows.mapInArrow(run, "evidence double, label int").groupBy("evidence").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).orderBy("evidence").collect()
    return Classifier(telling[2], *logistic_curve(*(np.array([r[c] for r in table], float) for c in ("evidence", "n", "ones"))))


def logistic_curve(x: np.ndarray, n: np.ndarray, ones: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the ridge keeps the slope finite where the labels are parted."""
    design, penalty = np.c_[np.ones(len(x)), x], np.diag([1e-9, ridge])
    beta = np.array([math.log((ones.sum() + 0.5) / (n.sum() - ones.sum() + 0.5)), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (ones - n * p) - penalty @ beta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + penalty, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def labelled_words(docs: DataFrame, labels: DataFrame, model: np.ndarray, chosen: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED_TEXTS) -> DataFrame:
    """(words, label) of the labelled documents that are chosen; equal texts count once, by their mean label.

    Of more than `most` distinct texts those of smallest hash are taken, about so many. Only their keys are shuffled and sent; the
    texts stay where they are read.
    """
    doc, h = F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("h")
    marks = labels.select(doc, F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1)").groupBy("doc").agg(F.max("label").alias("label"))
    keys = materialise(docs.where(chosen).select(doc, h).join(marks, "doc").groupBy("h").agg(F.min("doc").alias("doc"), F.round(F.avg("label")).cast("int").alias("label")), "labelled")
    share = most / max(1, keys.count())
    taken = keys.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    rows = docs.select(doc, h, F.col(f"`{text_col}`").alias("text")).join(F.broadcast(taken), ["doc", "h"])
    return restored_words(rows.select("h", "text", "label"), model).dropDuplicates(["h"]).select("words", "label")


def score_texts(docs: DataFrame, model: np.ndarray, classifier: Classifier, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds `score` (0 to 1) and `predicted` (1 from the threshold on); columns of these names are replaced."""
    found = with_words(docs.drop("score", "predicted"), model, text_col, sorted(classifier.words), "score", T.DoubleType(), classifier.score)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_toxicity(docs: DataFrame, labels: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns the language model from all texts and the labels from the chosen rows; scores every text."""
    model = fit_language_model(docs, text_col)
    learned = materialise(labelled_words(docs, labels, model, chosen, id_col, text_col), "labelled-words")
    classifier = fit_classifier(learned)
    discard(learned)
    return score_texts(docs, model, classifier, text_col)
