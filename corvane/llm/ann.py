"""Nearest neighbours by an inverted multi-index, with an exact stop.

Vectors (at unit length) are split into two halves, each quantised by its own K centroids; a cell is a pair of centroids. K
grows with the square root of the number of vectors, up to MOST_CENTROIDS. Centroids are fitted on a sample of SAMPLE rows at
most (those with the smallest id hashes); every row is indexed, and every list knows how near and how far its entries lie.

1. A query walks the pairs in the order of its summed distances with a heap until the cells it has met hold PROBE entries, and
   reranks these by their exact cosine: its k-th score so far.
2. By the distances to a half's centroid and the least and largest distance of its entries from there, no entry of a cell can
   be nearer than a bound. The cells whose bound does not exclude the k-th score are reranked, so the answer is exact.

Where the vectors have structure, few cells are left in the second step. Vectors without any (uniform directions in many
dimensions) leave most cells: then every query meets most entries, in blocks. This is one path for every size.

Entries are dealt by runs of first centroids in blocks of bounded size, queries by their own first centroid in blocks too, and
a block of entries goes only to the blocks of queries that ask for it, so neither a crowded cell nor the number of queries
fills a task; only the few best of a block leave it.

Defined cases: null, empty or zero vectors, vectors with null or non-finite components and null ids take no part; vectors of
another length than most are compared exhaustively with queries of that length; entries that share an id with the query are
not its neighbours; queries that share an id are answered together; ties go to the smaller id; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import materialise, tidied

SAMPLE, MOST_CENTROIDS, ROUNDS, PROBE = 16384, 512, 12, 256
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 4096, 4096, 256
#: Above rounding of distances between unit vectors.
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centroids)
        for c in range(len(centroids)):
            mine = x[at == c]
            if len(mine):
                centroids[c] = mine.mean(0)
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(x, centroids).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, target: float) -> float:
    """The multi-sequence walk over pairs by summed distance: the sum at which the cells met hold `target` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    seen, got, at = {(0, 0)}, 0, -np.inf
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    while heap and got < target:
        at, i, j = heapq.heappop(heap)
        got += counts[a[i], b[j]]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return float(at)


def packed(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each list, runs of lists sharing one while they fit, and the parts that a block needs."""
    block, held, parts = np.zeros(len(counts), np.int64), 0, []
    for i, c in enumerate(counts.tolist()):
        if not parts or held + c > size:
            parts.append(1)
            held = 0
        held += c
        block[i] = len(parts) - 1
        parts[-1] = max(1, -(-held // size))
    return block, np.array(parts, np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ok & F.exists(vector, lambda v: v != 0)


def best_of(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[list[int], list[int], list[float]]:
    """The k best entries of each query by exact cosine (products added in order), ties to the smaller id."""
    norm_q, norm_x = (np.sqrt(np.cumsum(m * m, 1)[:, -1]) for m in (q, x))
    rough = (q @ x.T) / norm_q[:, None] / norm_x[None]
    rough[query_ids[:, None] == ids[None]] = -np.inf
    if allowed is not None:
        rough[~allowed] = -np.inf
    few = min(k, len(ids))
    least = np.partition(rough, len(ids) - few, axis=1)[:, len(ids) - few]
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for r in range(len(query_ids)):
        at = np.flatnonzero((rough[r] >= least[r] - 1e-9) & (rough[r] > -np.inf))
        exact = np.cumsum(q[r][None] * x[at], 1)[:, -1] / (norm_q[r] * norm_x[at])
        order = np.lexsort((ids[at], -exact))[:k]
        out[0].extend([int(query_ids[r])] * len(order))
        out[1].extend(ids[at[order]].tolist())
        out[2].extend(exact[order].tolist())
    return out


class Index:
    """Centroids of both halves, entries in each cell, and the range of distances of a list's entries from its centroid."""

    def __init__(self, half: int, first: np.ndarray, second: np.ndarray):
        self.half, self.centroids = half, (first, second)
        self.counts = np.zeros((len(first), len(second)), np.int64)
        self.near = [np.full(len(c), np.inf) for c in self.centroids]
        self.far = [np.full(len(c), -np.inf) for c in self.centroids]

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of vectors to the centroids of both halves."""
        x = _unit(x)
        return [np.maximum(distances(x[:, : self.half], self.centroids[0]), 0), np.maximum(distances(x[:, self.half :], self.centroids[1]), 0)]

    def bounds(self, to: list[np.ndarray]) -> list[np.ndarray]:
        """Squared distance that no entry of a list is under, for both halves."""
        out = []
        for d2, near, far in zip(to, self.near, self.far, strict=True):
            d = np.sqrt(d2)
            out.append(np.square(np.maximum(0, np.maximum(d - far, near - d) - SLACK)))
        return out


def _reranked(asked: DataFrame, entries: DataFrame, parts: DataFrame, sent, by_bound: bool, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block of entries for the queries that ask for it.

    asked: block, grp, id, v, most (the largest sum of distances, or of bounds, of a cell to look into); entries: block, spread, i, j, id, v.
    """
    needed = asked.select("block", "grp").distinct()
    left = asked.join(parts, "block").select("block", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "id", "v", "most", F.lit(0).alias("i"), F.lit(0).alias("j"))
    right = entries.join(parts, "block").join(needed, "block").select("block", "grp", F.pmod("spread", "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v", F.lit(0.0).alias("most"), "i", "j")

    def rerank(key: tuple, got: pa.Table) -> pa.Table:
        index = sent.value
        asks = got.column("asks").combine_chunks()
        q, e = got.filter(asks), got.filter(pa.array(~asks.to_numpy(zero_copy_only=False)))
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        if q.num_rows and e.num_rows:
            ids, x = e.column("id").to_numpy(), _matrix(e.column("v"))
            i, j = e.column("i").to_numpy(), e.column("j").to_numpy()
            for at in range(0, q.num_rows, AT_ONCE):
                some = q.slice(at, AT_ONCE)
                mine, allowed = _matrix(some.column("v")), None
                if key[0].as_py() >= 0:
                    to = index.halves(mine)
                    first, second = index.bounds(to) if by_bound else to
                    allowed = first[:, i] + second[:, j] <= some.column("most").to_numpy()[:, None]
                for column, found in zip(out, best_of(some.column("id").to_numpy(), mine, ids, x, allowed, k), strict=True):
                    column.extend(found)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return left.union(right).groupBy("block", "grp", "part").applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest entries of each query row of `vectors`."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    element = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    chosen = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{element}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = chosen.where(F.col("id").isNotNull() & usable(F.col("v")))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = (dims["d"], dims["n"]) if dims else (1, 0)
    regular = rows.where(F.size("v") == d)
    taken = regular.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    sample = _unit(_matrix(taken.column("v"))) if taken.num_rows else np.ones((1, d))
    k_centroids = max(1, min(MOST_CENTROIDS, int(np.sqrt(n) / 2)))
    half = (d + 1) // 2
    index = Index(half, kmeans(sample[:, :half], k_centroids), kmeans(sample[:, half:], k_centroids) if d > 1 else np.zeros((1, 0)))
    sent_centroids = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                to = sent_centroids.value.halves(_matrix(part.column(1)))
                columns = [pa.array(t.argmin(1), pa.int32()) for t in to] + [pa.array(np.sqrt(t.min(1))) for t in to]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=["id", "v", "asks", "spread", "i", "j", "di", "dj"])

    spread = F.xxhash64(F.monotonically_increasing_id()).alias("spread")
    placed = materialise(regular.select("id", "v", "asks", spread).mapInArrow(tidied(place), f"id bigint, v array<{element}>, asks boolean, spread bigint, i int, j int, di double, dj double"), "vector-cells")
    ranges = [F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), *[f(c).alias(f"{name}_{c}") for c in ("di", "dj") for name, f in (("least", F.min), ("most", F.max))]]
    asking = np.zeros(len(index.centroids[0]), np.int64)
    for r in placed.groupBy("i", "j").agg(*ranges).collect():  # at most a row a pair of centroids
        index.counts[r["i"], r["j"]] = r["n"]
        asking[r["i"]] += r["q"]
        for side, (at, c) in enumerate(((r["i"], "di"), (r["j"], "dj"))):
            index.near[side][at] = min(index.near[side][at], r[f"least_{c}"])
            index.far[side][at] = max(index.far[side][at], r[f"most_{c}"])
    block_of, block_parts = packed(index.counts.sum(1), BLOCK_ROWS)
    group_of, group_parts = packed(asking, BLOCK_QUERIES)
    first_group = np.r_[0, np.cumsum(group_parts)[:-1]]
    sent = spark.sparkContext.broadcast(index)
    lists = spark.createDataFrame([(int(i), int(block_of[i]), int(first_group[group_of[i]]), int(group_parts[group_of[i]])) for i in range(len(block_of))], "i int, block int, grp0 int, grps int")
    entries = placed.join(F.broadcast(lists.select("i", "block")), "i").select("block", "spread", "i", "j", "id", "v")
    queries = placed.where("asks").join(F.broadcast(lists.select("i", "grp0", "grps")), "i").select("id", "v", (F.col("grp0") + F.pmod("spread", "grps")).cast("int").alias("grp"))
    # Vectors of other lengths: a block of their own for each length, without cells.
    odd = rows.where(F.size("v") != d).select("id", "v", "asks", spread, (-F.size("v")).cast("int").alias("block"))
    odd = materialise(odd, "odd-vectors")
    odd_sizes = odd.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"), F.ceil(F.count_if("asks") / BLOCK_QUERIES).cast("int").alias("grps"))
    parts = spark.createDataFrame([(b, int(p)) for b, p in enumerate(block_parts)], "block int, parts int")
    odd_asked = odd.where("asks").join(odd_sizes, "block").select("block", F.pmod("spread", "grps").cast("int").alias("grp"), "id", "v", F.lit(0.0).alias("most"))

    def asking_blocks(by_bound: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = sent.value
            full = ix.counts > 0
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    to = ix.halves(_matrix(part.column(1)))
                    low = ix.bounds(to) if by_bound else to
                    src, blocks, most = [], [], []
                    for r in range(part.num_rows):
                        limit = part.column(3)[r].as_py() if by_bound else walk(to[0][r], to[1][r], ix.counts, PROBE)
                        hit = (full & (low[0][r][:, None] + low[1][r][None] <= limit)).any(1)
                        mine = np.unique(block_of[hit])
                        src += [r] * len(mine)
                        blocks += mine.tolist()
                        most += [limit] * len(mine)
                    rows_ = pa.array(src, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), part.column(2).take(rows_), part.column(0).take(rows_), part.column(1).take(rows_), pa.array(most, pa.float64())], names=["block", "grp", "id", "v", "most"])

        return tidied(run)

    asked_type = f"block int, grp int, id bigint, v array<{element}>, most double"
    probed = _reranked(queries.mapInArrow(asking_blocks(False), asked_type), entries, parts, sent, False, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = probed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    # A cosine c is a squared distance of 2 - 2c between unit vectors.
    limit = F.when(F.col("n") >= k, 2 - 2 * F.col("s") + SLACK).otherwise(F.lit(float("inf")))
    bounded = queries.join(kth.select("id", limit.alias("most")), "id", "left").select("id", "v", "grp", F.coalesce("most", F.lit(float("inf"))).alias("most"))
    asked = materialise(bounded.mapInArrow(asking_blocks(True), asked_type), "asked-blocks")
    found = _reranked(asked, entries, parts, sent, True, k)
    aside = odd.select("block", "spread", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "v")
    found = found.union(_reranked(odd_asked, aside, odd_sizes.select("block", "parts"), sent, True, k))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
