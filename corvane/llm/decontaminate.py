"""Benchmark decontamination by greedy string tiling.

Test items and documents share seeds: equal runs of `least` words. Within a document and an item, the longest runs of
common words that overlap no marked word are marked again and again, down to `least` words (running Karp-Rabin greedy
string tiling), so a passage is found whatever the order of its parts. A document is contaminated by an item if the marked
words cover `percent` of the item.

To cover so much, a document must match so many seed positions of the item; the item's seeds that most items share are left
out of the index as far as those that are left must still be met. Only documents that meet one of these are compared with the
item, so a phrase common to many items costs nothing, and equal seeds are paired within a document and an item only. The words
behind a seed are compared before it counts.

Words are runs of letters and digits (every non-ASCII character counts as one, but for white space and punctuation of Latin-1,
of the general block such as curly quotes and dashes, and of CJK), case folded for ASCII and Latin-1. The index goes to the
executors where it has at most BROADCAST_SEEDS seeds; beyond, seeds are joined by shuffle.

Defined cases: null texts have no words; items of two to `least` - 1 words match where a document holds them whole, items of one
word match nothing; null ids and repeated rows are judged by their own text; an empty table or benchmark gives no match; columns
named `leaks` are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import materialise, small_batches, tidied
from .words import hash_words, rolled, text_pieces

LEAST, PERCENT = 5, 80
#: Meetings of an item's seeds with a document's, beyond which repetitions of up to so many words are shortened first.
MOST_MET, MOST_PERIOD = 1 << 20, 16
BROADCAST_SEEDS = 2_000_000
LEAK = "struct<item_id:bigint,matched_words:bigint,item_words:bigint,coverage:double>"
_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("matched_words", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("coverage", T.DoubleType())]))
_SEED = 0x8CB92BA72F3D8DD7
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Second bytes of U+0080 to U+00BF that are no letter or digit.
_LATIN_MARK = np.zeros(256, bool)
_LATIN_MARK[[c for c in range(0x80, 0xC0) if not chr(c).isalnum()]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII other than letters and digits as spaces, and upper case as lower."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
        marks = np.flatnonzero((data[:-1] == 0xC2) & _LATIN_MARK[data[1:]])
        out[marks] = out[marks + 1] = 0x20
    if len(data) > 2:
        block = (data[:-2] == 0xE2) & (data[1:-1] == 0x80) | (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] <= 0x9F)
        marks = np.flatnonzero(block)
        out[marks] = out[marks + 1] = out[marks + 2] = 0x20
    return out


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets of the rows) for runs of texts."""
    for lo, _, data, offsets in text_pieces(texts):
        words, starts, _ = hash_words(folded(data), False, offsets[1:-1])
        yield lo, words, np.searchsorted(starts, offsets)


def _grams(words: np.ndarray, edges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, row, position in the row) of the runs of k words."""
    grams = rolled(words, k, _SEED + 2 * k)
    row = np.searchsorted(edges, np.arange(len(grams)), "right") - 1
    at = np.flatnonzero(np.arange(len(grams)) + k <= edges[row + 1]) if len(grams) else np.zeros(0, np.int64)
    return grams[at], row[at], at - edges[row[at]]


def tile(i: np.ndarray, j: np.ndarray, words: int, least: int = LEAST) -> int:
    """Words of an item that greedy tiling marks. i, j: where seeds of `least` words start in the item and in the document."""
    used_i, used_j = np.zeros(words + least, bool), set()
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    while len(i):
        step = np.ones(len(i), bool)
        step[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(step)
        length = np.diff(np.r_[first, len(i)]) + least - 1
        longest = length.max()
        best = first[length == longest]
        for a, b in sorted(zip(i[best].tolist(), j[best].tolist(), strict=True), key=lambda x: (x[1], x[0])):
            if not used_i[a : a + longest].any() and used_j.isdisjoint(range(b, b + longest)):
                used_i[a : a + longest] = True
                used_j.update(range(b, b + longest))
        taken_j = np.array(sorted(used_j))
        free_i = ~np.lib.stride_tricks.sliding_window_view(used_i, least).any(1)[i]
        near = np.searchsorted(taken_j, j)
        free_j = near == len(taken_j)
        free_j[~free_j] = taken_j[near[~free_j]] >= j[~free_j] + least
        keep = free_i & free_j
        i, j = i[keep], j[keep]
    return int(used_i[:words].sum())


@dataclass(frozen=True)
class Item:
    """A test item: its words, the seed at each position (one of all words, if there are fewer than a seed's)."""

    item_id: int | None
    words: np.ndarray
    seeds: np.ndarray

    def least_met(self, least: int, percent: int) -> int:
        """Seed positions that a document must match to cover enough: a tile of n words has n - least + 1, a `least`-th of its words at least."""
        return 1 if len(self.words) < least else -(-(-(-percent * len(self.words) // 100)) // least)


def item_of(item_id: int | None, words: np.ndarray, least: int) -> Item | None:
    return Item(item_id, words, rolled(words, k := min(least, len(words)), _SEED + 2 * k)) if len(words) > 1 else None


def items_of(rows: list[tuple[int | None, str | None]], least: int) -> list[Item]:
    texts = pa.array([t for _, t in rows], pa.string())
    found = [item_of(rows[lo + i][0], words[edges[i] : edges[i + 1]], least) for lo, words, edges in _words(texts) for i in range(len(edges) - 1)]
    return [x for x in found if x is not None]


def indexed_seeds(item: Item, shared: dict[int, int], least: int, percent: int) -> np.ndarray:
    """The distinct seeds of an item without those in most items whose positions alone are too few to cover enough."""
    seeds, times = np.unique(item.seeds, return_counts=True)
    order = np.argsort([-shared[x] for x in seeds.tolist()], kind="stable")
    return seeds[order[np.cumsum(times[order]) >= item.least_met(least, percent)]]


def without_long_repeats(words: np.ndarray, n: int) -> np.ndarray:
    """The words of a document with the middle of each long repetition of up to MOST_PERIOD words cut out, for an item of n words.

    Tiles of an item have n words at most, and lie in a repetition, or over its beginning or its end. Four times n words of it
    give all of them room, whatever greedy tiling leaves between them, so that no more is marked in a longer one.
    """
    for p in range(1, MOST_PERIOD + 1):
        if len(words) <= p:
            break
        same = np.r_[False, words[p:] == words[:-p], False]
        first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        room = 4 * n + 2 * p
        long = last - first > room
        gone = np.zeros(len(words) + 1, np.int64)
        for lo, hi in zip(first[long].tolist(), last[long].tolist(), strict=True):
            cut = (hi - lo - room) // p * p  # whole periods, from the middle
            gone[lo + room // 2] += 1
            gone[lo + room // 2 + cut] -= 1
        words = words[np.cumsum(gone[:-1]) == 0]
    return words


def judge(item: Item, words: np.ndarray, seeds: np.ndarray, order: np.ndarray, least: int, percent: int) -> dict | None:
    """The leak of an item in a document of these words. seeds: its seeds, sorted; order: where they start."""
    n = len(item.words)
    lo, hi = np.searchsorted(seeds, item.seeds, "left"), np.searchsorted(seeds, item.seeds, "right")
    met = np.flatnonzero(hi > lo)
    if len(met) < item.least_met(least, percent):
        return None
    k = min(least, n)
    hull = np.zeros(n + 1, np.int64)
    np.add.at(hull, met, 1)
    np.add.at(hull, met + k, -1)
    if 100 * int((np.cumsum(hull)[:n] > 0).sum()) < percent * n:
        return None
    count = (hi - lo)[met]
    if count.sum() > MOST_MET:
        shorter = without_long_repeats(words, n)
        if len(shorter) < len(words):
            grams = rolled(shorter, k, _SEED + 2 * k)
            order = np.argsort(grams, kind="stable")
            return judge(item, shorter, grams[order], order, least, percent)
    i = np.repeat(met, count)
    j = order[np.repeat(lo[met] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
    same = (item.words[i[:, None] + np.arange(k)] == words[j[:, None] + np.arange(k)]).all(1)
    marked = tile(i[same], j[same], n, k)
    return {"item_id": item.item_id, "matched_words": marked, "item_words": n, "coverage": marked / n} if 100 * marked >= percent * n else None


def leaks_of(texts: pa.Array, items: list[Item], index: tuple[np.ndarray, np.ndarray], least: int, percent: int) -> list[list[dict]]:
    """The leaks of each text. index: sorted seeds and the item of each."""
    seed, which = index
    sizes = sorted({min(least, len(x.words)) for x in items})
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for lo, words, edges in _words(texts):
        for k in sizes:
            grams, row, at = _grams(words, edges, k)
            left, right = np.searchsorted(seed, grams, "left"), np.searchsorted(seed, grams, "right")
            hit = np.flatnonzero(right > left)
            # One question a document and distinct seed: repeats of a phrase in a document ask once.
            _, once = np.unique(np.stack([row[hit].astype(np.uint64), grams[hit]]), axis=1, return_index=True)
            hit = hit[once]
            n = (right - left)[hit]
            to = np.repeat(left[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(hit) else hit
            pairs = np.unique(np.stack([np.repeat(row[hit], n), which[to]]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
            ends = np.searchsorted(row, np.arange(len(edges)), "left")
            for r in np.unique(pairs[0]).tolist():
                mine = slice(ends[r], ends[r + 1])
                order = np.argsort(grams[mine], kind="stable")
                for x in pairs[1][pairs[0] == r].tolist():
                    if min(least, len(items[x].words)) == k:
                        found = judge(items[x], words[edges[r] : edges[r + 1]], grams[mine][order], at[mine][order], least, percent)
                        if found:
                            out[lo + r].append(found)
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The columns in `keep` (all, by default) and `leaks`: the items whose passages a document holds."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "leaks"]
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().where("text IS NOT NULL")
    # An item has fewer seeds than characters.
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > 4 * broadcast_seeds:
        return _leaks_by_join(docs, items, least, percent, id_col, text_col, keep)
    own = [] if text_col in keep else [F.col(f"`{text_col}`").alias("__text")]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], *own)
    text_at = chosen.columns.index("__text" if own else text_col)
    held = items_of([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()], least)
    shared = Counter(x for item in held for x in np.unique(item.seeds).tolist())
    kept = [indexed_seeds(item, shared, least, percent) for item in held]
    seed = np.concatenate([*kept, np.zeros(0, np.uint64)])
    which = np.repeat(np.arange(len(held)), [len(x) for x in kept])
    by = np.argsort(seed, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((held, (seed[by], which[by])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaks = leaks_of(b.column(text_at), *sent.value, least, percent)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(leaks, _leak_type())], names=[*keep, "leaks"])

    schema = T.StructType([*(f for f in chosen.schema.fields if f.name != "__text"), T.StructField("leaks", _LEAKS)])
    return chosen.mapInArrow(tidied(run), schema)


def _leak_type() -> pa.DataType:
    return pa.list_(pa.struct([("item_id", pa.int64()), ("matched_words", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64())]))


def _leaks_by_join(docs: DataFrame, items: DataFrame, least: int, percent: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """The same for a benchmark of any size: indexed seeds meet in a shuffled join, and each candidate (document, item) is tiled on its own."""
    keyed = docs.withColumn("__id", F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63)))).withColumn("__version", F.xxhash64(F.col(f"`{text_col}`")))
    numbered = materialise(items.withColumn("item", F.monotonically_increasing_id()), "test-items")

    def seeds_of(at: int, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, words, edges in _words(b.column(at)):
                    for k in range(2, least + 1):
                        grams, row, _ = _grams(words, edges, k)
                        if at == 1:  # of an item: its own size only, with how often each seed occurs
                            mine = np.minimum(np.diff(edges), least)[row] == k
                            grams, row = grams[mine], row[mine]
                        pairs, times = np.unique(np.stack([row.astype(np.uint64), grams]), axis=1, return_counts=True)
                        rows = pa.array(lo + pairs[0].astype(np.int64))
                        more = [pa.array(times)] if at == 1 else []
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), *[b.column(c).take(rows) for c in range(at)], *more], names=names)

        return tidied(run)

    own = numbered.select("item", "text").mapInArrow(seeds_of(1, ["seed", "item", "times"]), "seed bigint, item bigint, times bigint")
    shared = own.join(own.groupBy("seed").agg(F.count(F.lit(1)).alias("shared")), "seed")
    before = F.sum("times").over(Window.partitionBy("item").orderBy(F.desc("shared"), "seed"))
    positions = F.sum("times").over(Window.partitionBy("item"))
    words = F.when(F.col("positions") > 1, F.col("positions") + least - 1).otherwise(F.lit(least))
    met = F.ceil(F.ceil(F.lit(percent) * words / 100) / least)
    index = shared.withColumn("positions", positions).withColumn("upto", before).where((F.col("positions") == 1) | (F.col("upto") >= met)).select("seed", "item")
    texts = keyed.select("__id", "__version", F.col(f"`{text_col}`").cast("string").alias("text")).dropDuplicates(["__id", "__version"])
    asked = texts.mapInArrow(seeds_of(2, ["seed", "__id", "__version"]), "seed bigint, __id bigint, __version bigint")
    pairs = asked.join(index, "seed").select("__id", "__version", "item").distinct()
    both = pairs.join(numbered.withColumnRenamed("text", "test"), "item").join(texts, ["__id", "__version"]).select("__id", "__version", "item_id", "test", "text")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[dict | None] = []
            for r in range(b.num_rows):
                (item,) = items_of([(b.column(2)[r].as_py(), b.column(3)[r].as_py())], least)
                leaks = leaks_of(b.column(4).slice(r, 1), [item], (np.unique(item.seeds), np.zeros(len(np.unique(item.seeds)), np.int64)), least, percent)[0]
                found.append(leaks[0] if leaks else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, _leak_type().value_type)], names=["__id", "__version", "leak"])

    found = both.mapInArrow(tidied(tiled), f"__id bigint, __version bigint, leak {LEAK}").where("leak IS NOT NULL")
    leaks = found.groupBy("__id", "__version").agg(F.array_sort(F.collect_list("leak")).alias("__leaks"))
    empty = F.array().cast(f"array<{LEAK}>")
    return keyed.join(leaks, ["__id", "__version"], "left").select(*[F.col(f"`{c}`") for c in keep], F.coalesce("__leaks", empty).alias("leaks"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, item_id, matched_words, item_words, coverage): the documents that hold test passages."""
    return with_leaks(docs, benchmark, id_col=id_col, keep=[id_col], **options).select(F.col(f"`{id_col}`"), F.explode("leaks").alias("leak")).select(F.col(f"`{id_col}`"), "leak.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold none."""
    return with_leaks(docs, benchmark, **options).where(F.size("leaks") == 0).drop("leaks")
