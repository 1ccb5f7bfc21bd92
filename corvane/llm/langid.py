"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text gives longest matches: a text is parsed greedily into the longest
phrases that occur in that language's sample (a character that does not occur is a phrase). The language with the
smallest normalised phrase count, phrases * log2(sample length) / text length, wins. Long texts are parsed whole, in
pieces of PIECE characters; a phrase does not cross pieces.

The sample is a bounded number of labelled rows with their whole texts, drawn by a hash of the text over all labelled rows: at
most SAMPLE_ROWS a language, as many as SAMPLE_CHARS hold (one at least; a text longer than that only where there is no other),
of the MOST_LANGUAGES languages with most distinct texts. The edges of its automata are one hash table of (state, letter), whose
size is linear in the sample and checked before it goes to the executors.

Defined cases: null text, or text without a letter, gives `und` with score 0, as does any text when nothing is learned;
ties go to the smaller language name; other columns are kept out; repeated rows get the same prediction each.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import small_batches, tidied
from .words import text_pieces

SAMPLE_ROWS, SAMPLE_CHARS = 64, 1 << 16
#: Languages in a model, and characters of all their samples together.
MOST_LANGUAGES, ALL_CHARS = 512, 1 << 20
#: Bytes of a model that may be sent to the executors.
MODEL_BYTES = 1 << 30
PIECE = 1024
#: Samples shorter than this count as so long, or tiny samples would look predictive.
LEAST_SAMPLE = 2048


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings (online construction)."""
    to: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        cur = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
        last = cur
    return to


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """The edges of all automata. table: hash table (linear probing) of rows (state + class, state behind it), states counting in steps of `width`; roots and firsts, the states behind each class from there, by language."""

    languages: tuple[str, ...]
    lengths: tuple[int, ...]
    classes: dict[str, int]
    width: int
    roots: np.ndarray
    firsts: np.ndarray
    bits: int
    table: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.table.nbytes + self.firsts.nbytes + 100 * len(self.classes)

    def step(self, key: np.ndarray, otherwise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind these edges, or `otherwise` where there is none; and where that is."""
        at = ((key * _FACTOR) >> np.uint64(64 - self.bits)).view(np.int64)
        got = self.table.take(at, 0)
        hit = got[:, 0] == key
        out = np.where(hit, got[:, 1], otherwise)
        new = ~hit
        open_ = np.flatnonzero(new & (got[:, 0] != _EMPTY))
        at = at[open_]
        while len(open_):
            at = at + 1 & (1 << self.bits) - 1
            got = self.table.take(at, 0)
            hit = got[:, 0] == key[open_]
            out[open_[hit]] = got[hit, 1]
            new[open_[hit]] = False
            more = ~hit & (got[:, 0] != _EMPTY)
            open_, at = open_[more], at[more]
        return out, new


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fit(samples: dict[str, list[str]]) -> Model:
    """samples: texts by language. Characters are lower-cased; all that are no letters form one class."""
    languages = tuple(sorted(samples))
    texts = {k: " ".join(samples[k]).lower() for k in languages}
    letters = sorted({c for t in texts.values() for c in t if c.isalpha()})
    classes = {c: i + 2 for i, c in enumerate(letters)}
    width = len(letters) + 2
    keys, targets, roots, at = [], [], [], 0
    firsts = np.zeros((len(languages), width), np.uint64)
    for n, k in enumerate(languages):
        codes = [classes.get(c, 1) for c in texts[k]]
        codes = [c for i, c in enumerate(codes) if c != 1 or i == 0 or codes[i - 1] != 1]
        to = suffix_automaton(codes)
        firsts[n] = at * width
        for c, t in to[0].items():
            firsts[n, c] = (at + t) * width
        # A phrase begins at the root, by `firsts`: its edges are no part of the table.
        states = np.repeat(np.arange(1, len(to), dtype=np.uint64), [len(x) for x in to[1:]]) + np.uint64(at)
        keys.append(states * np.uint64(width) + np.fromiter((c for x in to[1:] for c in x), np.uint64, len(states)))
        targets.append((np.fromiter((t for x in to[1:] for t in x.values()), np.uint64, len(states)) + np.uint64(at)) * np.uint64(width))
        roots.append(at * width)
        at += len(to)
    key, target = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, targets))
    bits = max(4, int(6 * len(key)).bit_length())
    table = np.full((1 << bits, 2), _EMPTY)
    open_, slot = np.arange(len(key)), ((key * _FACTOR) >> np.uint64(64 - bits)).view(np.int64)
    while len(open_):
        free = table[slot, 0] == _EMPTY
        table[slot[free], 0] = key[open_[free]]
        placed = table[slot, 0] == key[open_]
        table[slot[placed], 1] = target[open_[placed]]
        open_, slot = open_[~placed], slot[~placed] + 1 & (1 << bits) - 1
    return Model(languages, tuple(len(texts[k]) for k in languages), classes, width, np.array(roots, np.uint64), firsts, bits, table)


def char_classes(model: Model) -> np.ndarray:
    """Class by code point: 0 for letters outside the samples, 1 for what is no letter."""
    out = np.where(_letters(), 0, 1).astype(np.int32)
    for cp in np.flatnonzero(_letters()):
        low = chr(cp).lower()
        if low in model.classes:
            out[cp] = model.classes[low]
    return out


def phrases(model: Model, lut: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Phrases of each code range, by language: array of (languages, ranges)."""
    n = ends - starts
    pieces = -(-n // PIECE)
    owner = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = starts[owner] + nth * PIECE
    size = np.minimum(PIECE, ends[owner] - lo)
    order = np.argsort(-size, kind="stable")
    lo, size, owner = lo[order], size[order], owner[order]
    kinds = lut[codes].astype(np.uint64)
    many = len(model.languages)
    out = np.zeros((many, len(n)), np.int64)
    if not many or not len(lo):
        return out
    state = np.repeat(model.roots[:, None], len(lo), 1)
    count = np.zeros(state.shape, np.int32)
    active = len(lo)
    for j in range(int(size[0])):
        while active and size[active - 1] <= j:
            active -= 1
        kind = kinds[lo[:active] + j]
        got, new = model.step((state[:, :active] + kind).ravel(), model.firsts.take(kind, 1).ravel())
        state[:, :active] = got.reshape(many, active)
        count[:, :active] += new.reshape(many, active)
    for k in range(many):
        out[k] = np.bincount(owner, weights=count[k], minlength=len(n))
    return out


def classify(model: Model, lut: np.ndarray, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    weight = np.array([math.log2(max(n, LEAST_SAMPLE)) for n in model.lengths])
    for _, _, data, offsets in text_pieces(texts):
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        has = np.r_[0, np.cumsum(_letters()[codes])]
        known = (has[chars[1:]] - has[chars[:-1]]) > 0
        if not model.languages:
            names += ["und"] * len(known)
            scores.append(np.zeros(len(known)))
            continue
        cost = phrases(model, lut, codes, chars[:-1], chars[1:]) * weight[:, None]
        best = cost.argmin(0)
        ranked = np.sort(cost, 0)
        second = ranked[1] if len(ranked) > 1 else np.where(ranked[0] > 0, np.inf, 1.0)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, 1 - ranked[0] / np.maximum(second, 1e-9))
        names += [model.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
        scores.append(np.where(known, np.clip(score, 0, 1), 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def sample_labelled(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = 9) -> dict[str, list[str]]:
    """The whole texts of smallest hash per language: `rows` of them, or all distinct ones if there are fewer, as far as `chars` characters go. Copies count once.

    Only (lang, h, length) is shuffled, copies merged before; each task then keeps its own smallest hashes, and only these get their texts.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(seed), F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    distinct = usable.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))
    most = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "lang").limit(MOST_LANGUAGES)
    languages = [r["lang"] for r in most.select("lang").collect()]
    if not languages:
        return {}
    bound = min(chars, ALL_CHARS // len(languages))
    # Texts that fit come first, by hash; the others by length.
    order = Window.partitionBy("lang").orderBy(F.greatest("n", F.lit(bound)), "h")
    # First among hashes of equal remainder, so that no task gets all texts of a language.
    share = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy(F.greatest("n", F.lit(bound)), "h")
    dealt = distinct.where(F.col("lang").isin(languages)).withColumn("r", F.row_number().over(share)).where(F.col("r") <= rows)
    ranked = dealt.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows)
    smallest = ranked.withColumn("upto", F.sum("n").over(order)).where((F.col("upto") <= bound) | (F.col("r") == 1)).select("lang", "h", "r")
    first = usable.join(F.broadcast(smallest), ["lang", "h"]).groupBy("lang", "r").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "r").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify_languages(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all, by default) with lang_pred and score, which replace columns so named."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    small_batches(docs.sparkSession)
    if model.nbytes > MODEL_BYTES:
        raise ValueError(f"the language model has {model.nbytes} bytes, over MODEL_BYTES: fit it on fewer characters")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [] if text_col in keep else [F.col(f"`{text_col}`").alias("__text")]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], *own)
    at = chosen.columns.index("__text" if own else text_col)
    schema = T.StructType([*(f for f in chosen.schema.fields if f.name != "__text"), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = None
        for b in batches:
            lut = char_classes(sent.value) if lut is None else lut
            names, scores = classify(sent.value, lut, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return chosen.mapInArrow(tidied(run), schema)
