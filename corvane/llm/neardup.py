"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Documents with equal shingle sets are one candidate, a numbered set with one row (the smallest id) to read its text from.
Signatures are cut into bands; in each band bucket every candidate is paired with the bucket's first one only, never with all
others. A pair's signatures are compared batch by batch and dropped once the posterior probability (uniform prior) of reaching
the threshold falls under `miss`; what survives is confirmed on the full shingle sets. Buckets whose members then still lie in
different components are compared across components, in blocks of bounded size, so that no link is lost to the pairing with
one member: first by signatures alone, then texts are fetched for the rows of a block that the signatures leave in doubt.
Components are found by contraction in Spark joins.

A bucket or set that holds a large share of all rows meets in no task: counts of buckets, of a bucket's components and of sets
are combined before the shuffle, and rows get them back by joins of two plain shuffles, which adaptive execution splits.

Defined cases: null or empty text, or text without words, has no shingle and no link; fewer words than a shingle are one
shingle; null ids stand alone (component null, kept); rows that share an id each follow their own text; repeated rows are
repeated; an empty table gives an empty table; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import materialise, small_batches, tidied
from .words import hashed_texts, mix, rolled

ROWS, BANDS, BATCH = 4, 32, 32
MISS = 1e-6
#: Members of a block, and shingles of all its texts.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
BROADCAST_IDS = 200_000
_MULTIPLIERS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words are one shingle."""
    if not len(words):
        return words
    return np.unique(rolled(words, min(k, len(words)), 0x51ED270B27D4EB2F + 2 * min(k, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[None, at : at + 1024] * _MULTIPLIERS[:, None]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for part in sig.reshape(BANDS, ROWS).T:
        out = mix(out ^ part)
    return out.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, hashes: int = ROWS * BANDS, batch: int = BATCH) -> tuple[int, ...]:
    """For each number of compared hashes n, the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m+1, n-m+1), whose upper tail is P(Binomial(n+1, threshold) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """For signatures in rows (broadcast together): not pruned in any batch."""
    same = a == b
    ok, seen = np.ones(same.shape[:-1], bool), np.zeros(same.shape[:-1], np.int32)
    for k, least in enumerate(least_matches(threshold, miss)):
        seen += same[..., k * BATCH : (k + 1) * BATCH].sum(-1)
        ok &= seen >= least
        if not ok.any():
            break
    return ok


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of sorted distinct arrays in integers: 100 * |a & b| >= percent * |a | b|."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Overlaps:
    """Intersection sizes of one of many sets with many others at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        distinct, self.at = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
        self.marked = np.zeros(len(distinct), np.int32)

    def similar(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of these sets (none empty) reach the similarity with set x."""
        mine = self.at[self.starts[x] : self.starts[x + 1]]
        self.marked[mine] = 1
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.starts[others] - ends + sizes, sizes)
        both = np.add.reduceat(self.marked[self.at[places]], ends - sizes)
        self.marked[mine] = 0
        return 100 * both >= percent * (sizes + self.sizes[x] - both)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, version, n_shingles, set hash of two longs, signature, band hashes) of each document; version: a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, words, offsets in hashed_texts(b.column(2), lower=True):
                out: tuple[list, ...] = ([], [], [], [], [])
                for i in range(hi - lo):
                    s = shingle_hashes(words[offsets[i] : offsets[i + 1]], k)
                    out[0].append(len(s))
                    out[1].append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    out[2].append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    sig = signature(s) if len(s) else None
                    out[3].append(None if sig is None else sig.tobytes())
                    out[4].append(None if sig is None else band_hashes(sig).tolist())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], names=["id", "version", "n_shingles", "h1", "h2", "sig", "bands"])

    return keyed(docs, id_col, text_col).mapInArrow(tidied(run), "id bigint, version bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary, bands array<bigint>")


def _texts_of(docs: DataFrame, nodes: DataFrame, heads: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(node, text) of these sets only, written once; their rows are broadcast if they are few. heads: node, id, version."""
    wanted = heads.join(nodes, "node", "left_semi")
    wanted = F.broadcast(wanted) if nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else wanted
    return materialise(keyed(docs, id_col, text_col).join(wanted, ["id", "version"]).select("node", "text").dropDuplicates(["node"]), name)


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    return [shingle_hashes(words[o[i] : o[i + 1]], k) for lo, hi, words, o in hashed_texts(texts, lower=True) for i in range(hi - lo)]


def _verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of sets that pass the Bayesian test and then the exact one. sigs: node, id, version, sig."""
    threshold = percent / 100

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(survives(sa, sb, threshold, miss)))

    joined = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    likely = materialise(joined.mapInArrow(tidied(prune), "a bigint, b bigint"), "likely-pairs")
    texts = _texts_of(docs, likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), sigs.select("node", "id", "version"), id_col, text_col, "pair-texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x, y, percent) for x, y in zip(_sets(b.column(2), k), _sets(b.column(3), k), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_texts = likely.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return with_texts.mapInArrow(tidied(confirm), "a bigint, b bigint")


def _doubtful(got: pa.Table, bucket: int, threshold: float, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block's left side: the rows of its right side that the signatures leave in doubt.

    Rows of one component, pairs with the bucket's first set (compared before) and pairs that share an earlier band are left out.
    """
    node, comp = got.column("node").to_numpy(), got.column("comp").to_numpy()
    side, pivot, major = got.column("side").to_numpy(), got.column("pivot")[0].as_py(), got.column("major")[0].as_py()
    sig = np.frombuffer(b"".join(got.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)
    bands = np.array([band_hashes(s) for s in sig])
    right = np.flatnonzero((side == 1) & (node != pivot))
    for x in np.flatnonzero((side == 0) & (node != pivot)):
        open_ = right[(comp[right] != comp[x]) & ((comp[right] == major) | (node[right] > node[x]))]
        if len(open_):
            same = bands[open_] == bands[x]
            yield x, open_[(bands[x][same.argmax(1)] == bucket) & survives(sig[open_], sig[x][None], threshold, miss)]


def _across(shared: DataFrame, comps: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """Links across components within buckets of three or more: the members outside a bucket's largest component against all, block by block."""
    placed = shared.where("n > 2").join(comps, "node", "left").select("bucket", "node", "pivot", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    parts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    largest = F.max_by(F.struct("comp", "m", "s"), F.struct("m", "comp"))
    summed = parts.groupBy("bucket").agg(largest.alias("top"), F.sum("m").alias("all"), F.sum("s").alias("s")).where("all > top.m")
    blocks = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    sizes = summed.select("bucket", F.col("top.comp").alias("major"), blocks(F.col("all"), F.col("s")).alias("n_all"), blocks(F.col("all") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("n_out"))
    members = placed.join(materialise(sizes, "mixed-buckets"), "bucket").join(sigs.select("node", "sig"), "node")
    members = materialise(members, "mixed-members")
    n_all, n_out = F.col("n_all"), F.col("n_out")
    spread = F.xxhash64("node", F.lit(8))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = members.where("comp <> major").withColumn("i", F.pmod(spread, n_out).cast("int")).withColumn("j", upto(n_all)).withColumn("side", F.lit(0))
    right = members.withColumn("j", F.pmod(spread, n_all).cast("int")).withColumn("i", upto(n_out)).withColumn("side", F.lit(1))
    columns = ["bucket", "i", "j", "side", "node", "pivot", "comp", "major"]
    signed = left.select(*columns, "sig").union(right.select(*columns, "sig"))
    threshold = percent / 100

    def doubtful(key: tuple, got: pa.Table) -> pa.Table:
        at: set[int] = set()
        for x, others in _doubtful(got, key[0].as_py(), threshold, miss):
            if len(others):
                at.add(int(x))
                at.update(others.tolist())
        return got.take(pa.array(sorted(at), pa.int64()))

    kinds = "bucket bigint, i int, j int, side int, node bigint, pivot bigint, comp bigint, major bigint, sig binary"
    rows = materialise(signed.groupBy("bucket", "i", "j").applyInArrow(doubtful, kinds), "doubtful-rows")
    texts = _texts_of(docs, rows.select("node").distinct(), sigs.select("node", "id", "version"), id_col, text_col, "bucket-texts")

    def compare(key: tuple, got: pa.Table) -> pa.Table:
        node, comp = got.column("node").to_numpy(), got.column("comp").to_numpy()
        overlaps = Overlaps(_sets(got.column("text"), k))
        links: tuple[list[int], list[int]] = ([], [])
        for x, others in _doubtful(got, key[0].as_py(), threshold, miss):
            if len(others):
                linked = others[overlaps.similar(x, others, percent)]
                for y in linked[np.unique(comp[linked], return_index=True)[1]].tolist():  # one link a component
                    links[0].append(int(node[x]))
                    links[1].append(int(node[y]))
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return rows.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text); version tells the texts of one id apart."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def judged(docs: DataFrame, k: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """(id, version, n_shingles, component_id, comp), one row for each row of `docs`; comp numbers the component, null without shingles or id."""
    small_batches(docs.sparkSession)
    signed = materialise(signatures(docs, k, id_col, text_col), "signatures")
    found = signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("id", "version")).alias("head"))
    sets = materialise(found.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n_shingles", "head.id", "head.version"), "shingle-sets")
    same = ["id", "version", "h1", "h2", "n_shingles"]
    sigs = signed.join(sets, same).select("node", "id", "version", "n_shingles", "sig", "bands").dropDuplicates(["node"])
    sigs = materialise(sigs, "set-signatures")
    banded = sigs.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = materialise(banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = materialise(banded.join(buckets, "bucket"), "shared-buckets")
    pairs = shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = materialise(_verified(pairs, sigs, docs, k, percent, miss, id_col, text_col), "verified-links")
    comps = components(links)
    more = materialise(_across(shared, comps, sigs, docs, k, percent, miss, id_col, text_col), "verified-links")
    if not more.isEmpty():
        comps = components(links.union(more))
    least = comps.join(sets.select("node", "id"), "node").groupBy("comp").agg(F.min("id").alias("least"))
    names = comps.join(materialise(least, "component-ids"), "comp").select("node", "comp", "least")
    reps = sets.join(names, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("comp", "node").alias("comp"), F.coalesce("least", "id").alias("least"))
    joined = signed.select(*same).join(reps, ["h1", "h2", "n_shingles"], "left")
    has = F.col("id").isNotNull()
    return joined.select("id", "version", "n_shingles", F.when(has, F.coalesce("least", "id")).alias("component_id"), F.when(has, F.col("comp")).alias("comp"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of `docs`."""
    found = judged(docs, k, percent, miss, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies of another kept one; rows repeated with id and text stay once.

    Of a component that holds several texts of its smallest id, one of them stays. A row is dropped by id and text, so another text of the
    same id stays if its own component says so.
    """
    found = materialise(judged(docs, k, percent, MISS, id_col, text_col), "near-copies")
    gone = found.where("id <> component_id").select("id", "version")
    # Texts of one id that share a component, beyond the first.
    kept = found.where("id = component_id AND comp IS NOT NULL").groupBy("comp", "id").agg(F.min("version").alias("least"), F.max("version").alias("most")).where("least < most")
    also = found.join(kept, ["comp", "id"]).where("version > least").select("id", "version")
    gone = materialise(gone.union(also).distinct().select(F.col("id").alias("__id"), F.col("version").alias("__version")), "gone-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    ids, version = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    left = docs.join(gone, (ids.cast("bigint") == F.col("__id")) & (version == F.col("__version")), "left_anti")
    again = found.groupBy("id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id"), F.col("version").alias("__version"))
    if again.isEmpty():
        return left
    repeats = ids.cast("bigint").eqNullSafe(F.col("__id")) & (version == F.col("__version"))
    return left.join(again, repeats, "left_anti").unionByName(left.join(again, repeats, "left_semi").dropDuplicates([id_col, text_col]))
