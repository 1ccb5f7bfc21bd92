"""Removal of repeated word windows by minimiser-partitioned de Bruijn compaction.

The k-word windows of the corpus are the edges of a de Bruijn graph. Following published compaction schemes, consecutive
windows of a document that share their minimiser (the smallest hash of SUB words inside the window) form one path piece;
equal windows always fall to equal minimisers. Of equal pieces, all but the first in (document, start) order are repeats as a
whole, so a long repeated nonbranching path costs one row per piece and not one per window. Pieces that share a minimiser but
differ (the path branches there) are resolved window by window, only for these pieces.

Every repeat keeps the coordinates of an earlier occurrence. Repeats that follow each other in a document, and whose earlier
occurrences follow each other too, compact to one path. A path is then verified: a 128-bit BLAKE2 digest of its words is taken
from the earlier document's text, joined to the path by its source coordinates, and compared with that of the words about to
be removed; only then they go.

Each task first joins its own equal pieces, so a passage that fills the corpus reaches a reducer once per task. Pieces are
dealt by minimiser and piece, so a minimiser in very many contexts is spread over all tasks; its distinct pieces are only
counted, combined before the shuffle. Nothing but one row is held from batch to batch.

Each step is a table of its own, so the disk holds the shuffle of one step at a time and the few tables that later steps read.

Defined cases: null text has no words; a null id counts as the smallest id; rows that share an id and text are one
occurrence and keep the same words; rows that share an id but not the text are ordered by text hash where their starts
tie; texts shorter than a window keep all words; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import discard, materialise, shuffles_freed, small_batches, tidied, workspace
from .words import bounds, hash_words, hashed_texts, inverse, mix, powers, rolled

SUB = 6
_SPAN_BASE = 0xD6E8FEB86659FD93 | 1
#: Rows that a task holds back to join equal pieces among them.
HELD = 1 << 20
NULL_ID = -(1 << 63)
#: Low bits of a minimiser's rank that hold its position, which must be below 2**POSITION_BITS words in a run of texts.
POSITION_BITS = 28


def pieces(words: np.ndarray, offsets: np.ndarray, k: int, sub: int = SUB) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, minimiser hash, piece hash) of each path piece; offsets: words of each document.

    first window counts in words of its document. Equal piece hashes with equal minimisers mean equal words and position.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(words) - k + 1
    if n <= 0:
        return empty
    grams = rolled(words, sub, 0x2545F4914F6CDD1D)
    at = np.arange(len(grams), dtype=np.uint64)
    bits = np.uint64(POSITION_BITS)
    low = (mix(grams) >> bits << bits) | at
    width, have = k - sub + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    chosen = (low[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(n), "right") - 1
    valid = np.arange(n) + k <= offsets[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return empty
    edges = np.flatnonzero(np.r_[new | ~valid, True])
    last = edges[np.searchsorted(edges, first, "right")]
    count = last - first
    p = powers(_SPAN_BASE, len(words) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * p[: len(words)])]
    span = (sums[first + count + k - 1] - sums[first]) * powers(inverse(_SPAN_BASE), len(words) + 1)[first]
    shape = (chosen[first] - first).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64)
    return doc[first], first - offsets[doc[first]], count, grams[chosen[first]], mix(span ^ mix(shape))


def windows(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window."""
    return rolled(words, k, 0x9FB21C651E98DF25), rolled(mix(words ^ np.uint64(0xA24BAED4963EE407)), k, 0xC2B2AE3D27D4EB4F)


def _first_of(order: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The sort order by keys, then order; and whether each sorted row is the first of its keys."""
    by = np.lexsort((*reversed(order), *reversed(keys)))
    first = np.ones(len(by), bool)
    first[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], 0) if len(by) else False
    return by, first


#: kind 0: a piece that a reducer must compare; 1: a repeat of the windows at (fid, fversion, fstart); 2: the first of equal pieces.
_PIECE = "kind int, m bigint, h bigint, id bigint, version bigint, start bigint, n bigint, fid bigint, fversion bigint, fstart bigint"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_SPAN = ["id", "version", "start", "n", "fid", "fversion", "fstart"]


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of m, h and, if given, the span's columns; absent ones are zero."""
    n = len(columns[0])
    full = [np.full(n, kind, np.int32), *columns, *[np.zeros(n, np.int64)] * (9 - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in full], names=_NAMES)


def compacted(*span: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans (the columns of _SPAN), those that continue each other here and at their earlier occurrence made one."""
    by = np.lexsort((span[2], span[1], span[0]))
    doc, version, start, n, fdoc, fversion, fstart = (x[by] for x in span)
    new = np.ones(len(by), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (fdoc[1:] != fdoc[:-1]) | (fversion[1:] != fversion[:-1]) | (fstart[1:] != fstart[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], version[at], start[at], np.add.reduceat(n, at) if len(at) else n, fdoc[at], fversion[at], fstart[at]


def _repeats(*span: np.ndarray) -> pa.RecordBatch:
    found = compacted(*span)
    zero = np.zeros(len(found[0]), np.int64)
    return _rows(1, zero, zero, *found)


def _joined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Equal pieces among the held rows: the first stays a question, the others are repeats (unless they are the same occurrence)."""
    m, h, doc, version, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
    by, first = _first_of((doc, start, version), (m, h))
    m, h, doc, version, start, n = (x[by] for x in (m, h, doc, version, start, n))
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = ((doc != doc[lead]) | (start != start[lead]) | (version != version[lead])) & ~first
    yield _rows(0, *(x[first] for x in (m, h, doc, version, start, n)))
    if again.any():
        yield _repeats(*(x[again] for x in (doc, version, start, n)), *(x[lead[again]] for x in (doc, version, start)))


def _emit(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            versions = b.column(1).to_numpy(zero_copy_only=False)
            for lo, _, words, offsets in hashed_texts(b.column(2)):
                doc, start, count, m, h = pieces(words, offsets, k)
                held.append((m.view(np.int64), h.view(np.int64), ids[lo + doc], versions[lo + doc], start, count))
                size += len(doc)
                if size >= HELD:
                    yield from _joined(held)
                    held, size = [], 0
        if held:
            yield from _joined(held)

    return docs.select("id", "version", "text").mapInArrow(tidied(run), _PIECE)


def _reduced(rows: DataFrame) -> DataFrame:
    """Of sorted questions, equal ones following each other: repeats (kind 1) and the first of each (kind 2); known repeats go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: tuple[np.ndarray, ...] | None = None
        for b in batches:
            known = b.filter(pa.array(b.column(0).to_numpy() == 1))
            if known.num_rows:
                yield known
            b = b.filter(pa.array(b.column(0).to_numpy() == 0))
            if not b.num_rows:
                continue
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns[1:7])
            own = 0 if lead is None else 1
            if lead is not None:
                cols = tuple(np.r_[x, y] for x, y in zip(lead, cols, strict=True))
            m, h, doc, version, start, n = cols
            first = np.ones(len(m), bool)
            first[1:] = (m[1:] != m[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(first)[np.cumsum(first) - 1]
            lead = tuple(x[at[-1]][None] for x in cols)
            again = ((doc != doc[at]) | (start != start[at]) | (version != version[at])) & ~first
            first[:own] = False
            if first.any():
                yield _rows(2, m[first], np.zeros(int(first.sum()), np.int64), *(x[first] for x in cols[2:]))
            if again.any():
                yield _repeats(*(x[again] for x in (doc, version, start, n)), *(x[at[again]] for x in (doc, version, start)))

    return rows.mapInArrow(tidied(run), _PIECE)


def _window_questions(docs: DataFrame, branching: DataFrame, k: int) -> DataFrame:
    """The windows of branching pieces, one row per distinct window of a task, and the repeats known to the task."""
    wanted = branching.groupBy("id", "version").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = docs.join(wanted, ["id", "version"]).select("id", "version", "text", "spans.start", "spans.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            ids, versions = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(b.num_rows):
                words, _, _ = hash_words(np.frombuffer(b.column(2)[i].as_py().encode(), np.uint8))
                starts, counts = (np.array(b.column(c)[i].as_py(), np.int64) for c in (3, 4))
                at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                x, y = (w[at].view(np.int64) for w in windows(words, k))
                held.append((x, y, np.full(len(at), ids[i]), np.full(len(at), versions[i]), at, np.ones(len(at), np.int64)))
                size += len(at)
                if size >= HELD:
                    yield from _joined(held)
                    held, size = [], 0
        if held:
            yield from _joined(held)

    return joined.mapInArrow(tidied(run), _PIECE)


def _dealt(rows: DataFrame) -> DataFrame:
    """Questions go by minimiser and piece, known repeats anywhere; equal questions follow each other in a partition."""
    asks = F.col("kind") == 0
    to = [F.when(asks, F.col("m")).otherwise(F.xxhash64("id", "start")), F.when(asks, F.col("h")).otherwise(F.lit(0).cast("bigint"))]
    return rows.repartition(*to).sortWithinPartitions("m", "h", "id", "start", "version")


def repeated_paths(docs: DataFrame, k: int) -> DataFrame:
    """(id, version, start, n, fid, fversion, fstart): n windows from word `start` on, which are those from `fstart` on in an earlier place. docs: id, version, text."""
    found = materialise(_reduced(_dealt(_emit(docs, k))), "path-pieces")
    distinct = found.where("kind = 2")
    branching = materialise(distinct.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m"), "branching-minimisers")
    split = materialise(distinct.select("m", "id", "version", "start", "n").join(branching, "m", "left_semi").drop("m"), "branching-pieces")
    whole = materialise(found.where("kind = 1").select(*_SPAN), "repeated-pieces")
    discard(found, branching)
    finer = materialise(_reduced(_dealt(_window_questions(docs, split, k))).where("kind = 1").select(*_SPAN), "repeated-windows")
    discard(split)
    repeats = whole.union(finer).repartition("id", "version")
    # Paths of pieces and of windows that continue each other are one path.
    keys = ["id", "version", "fid", "fversion", "shift"]
    order = Window.partitionBy(*keys).orderBy("start")
    ended = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats.withColumn("shift", F.col("fstart") - F.col("start")).withColumn("new", F.when(F.col("start") <= ended, 0).otherwise(1))
    numbered = marked.withColumn("path", F.sum("new").over(order))
    paths = numbered.groupBy(*keys, "path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return paths.select("id", "version", "start", (F.col("end") - F.col("start")).alias("n"), "fid", "fversion", (F.col("start") + F.col("shift")).alias("fstart"))


def _digest(raw: bytes) -> bytes:
    """Of the words of these bytes."""
    return hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()


def with_source_digests(docs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """paths with `digest`: that of the words at their earlier occurrence."""
    place = ["fid", "fversion", "fstart", "n"]
    asked = paths.groupBy("fid", "fversion").agg(F.collect_set(F.struct("fstart", "n")).alias("asked"))
    sources = docs.join(asked.withColumnRenamed("fid", "id").withColumnRenamed("fversion", "version"), ["id", "version"]).select("id", "version", "text", "asked.fstart", "asked.n").dropDuplicates(["id", "version"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(2)[i].as_py().encode()
                lo, hi = bounds(np.frombuffer(raw, np.uint8))
                starts, counts = b.column(3)[i].as_py(), b.column(4)[i].as_py()
                digests = [_digest(raw[lo[s] : hi[s + n + k - 2]]) for s, n in zip(starts, counts, strict=True)]
                same = [np.full(len(starts), b.column(c)[i].as_py(), np.int64) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())], names=[*place, "digest"])

    return paths.join(sources.mapInArrow(tidied(run), "fid bigint, fversion bigint, fstart bigint, n bigint, digest binary"), place)


def remove_repeats(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, text (kept words joined by a space), n_words, n_removed, kept_sha256."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("own"), text.alias("text")).select("own", F.coalesce("own", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("version"), "text")
    with shuffles_freed(docs.sparkSession), workspace(docs.sparkSession) as keep:
        paths = materialise(repeated_paths(keyed, k), "repeated-paths")
        spans = keep(with_source_digests(keyed, paths, k).groupBy("id", "version").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans")), "repeated-spans")
    joined = keyed.join(spans, ["id", "version"], "left").select("own", "text", "spans.start", "spans.n", "spans.digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, *spans in zip(*b.columns[1:], strict=True):
                raw = text.as_py().encode()
                lo, hi = bounds(np.frombuffer(raw, np.uint8))
                gone = np.zeros(len(lo) + 1, np.int64)
                for start, n, digest in zip(*((x.as_py() or ()) for x in spans), strict=True):
                    end = start + n + k - 1
                    if _digest(raw[lo[start] : hi[end - 1]]) == digest:
                        gone[start] += 1
                        gone[end] -= 1
                keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                left = b" ".join([raw[x:y] for x, y in zip(lo[keep].tolist(), hi[keep].tolist(), strict=True)])
                for column, value in zip(out, (left.decode(), len(lo), len(lo) - len(keep), hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["id", "text", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(tidied(run), "id bigint, text string, n_words bigint, n_removed bigint, kept_sha256 string").withColumnRenamed("id", id_col)
