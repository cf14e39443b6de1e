"""Approximate nearest neighbours by an inverted multi-index.

Vectors are normalised and cut into two halves, each quantised by its own centroids; a
pair of centroids is a cell. A query walks the cells by summed distance of its halves to
the two centroids, with a heap over the two sorted centroid lists, until it has seen a
set share of all vectors. The vectors in those cells are scored with their original
values in double precision.

Centroids, and the share that reaches ``recall`` in a brute-force comparison, are fitted
on at most ``SAMPLE`` vectors, the ones with the smallest hash of their id; every vector is
indexed. Cells with the same first centroid are one list, cut into blocks of about
``BLOCK`` vectors; queries come in chunks of about ``CHUNK``. A task holds one block and
one chunk, however common a vector is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CENTROIDS = 32  # a half; at most 64, as a list's cells are bits of one number
SAMPLE = 16_384
BLOCK, CHUNK = 16_384, 4_096
HITS = "query_id long, vec_id long, score double"


@dataclass
class MultiIndex:
    """Centroids of both halves, vectors per cell, and the share of vectors to visit."""

    first: np.ndarray
    second: np.ndarray
    share: float
    population: np.ndarray | None = None

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _nearest(unit[:, :half], self.first), _nearest(unit[:, half:], self.second)

    def walk(self, unit: np.ndarray, wanted: int) -> list[int]:
        """For each first centroid, the bits of the second centroids to visit until ``wanted`` vectors were met."""
        half = self.first.shape[1]
        a = ((self.first - unit[:half]) ** 2).sum(axis=1)
        b = ((self.second - unit[half:]) ** 2).sum(axis=1)
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[by_a].tolist(), b[by_b].tolist()
        bits, seen = [0] * len(a), 0
        queue = [(a[0] + b[0], 0, 0)]
        while queue and seen < wanted:
            _, i, j = heappop(queue)
            bits[by_a[i]] |= 1 << int(by_b[j])
            seen += int(self.population[by_a[i], by_b[j]])
            if j + 1 < len(b):
                heappush(queue, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heappush(queue, (a[i + 1] + b[0], i + 1, 0))
        return bits


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)


def _quantise(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centroids)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def unit_rows(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, k: int, recall: float, centroids: int = CENTROIDS) -> MultiIndex:
    """Centroids, and the smallest share of vectors whose cells hold ``recall`` of the sample's true neighbours."""
    rng = np.random.default_rng(7)
    unit = unit_rows(sample)
    half = (unit.shape[1] + 1) // 2
    index = MultiIndex(_quantise(unit[:, :half], centroids, rng), _quantise(unit[:, half:], centroids, rng), 1.0)
    probes = rng.choice(len(unit), min(256, len(unit)), replace=False)
    one, two = index.cells(unit)
    near = unit[probes] @ unit.T
    near[np.arange(len(probes)), probes] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
    far_a = ((unit[probes, None, :half] - index.first) ** 2).sum(axis=2)
    far_b = ((unit[probes, None, half:] - index.second) ** 2).sum(axis=2)
    far = far_a[:, one] + far_b[:, two]
    place = np.empty(far.shape)
    np.put_along_axis(place, np.argsort(far, axis=1, kind="stable"), np.arange(1, len(unit) + 1) / len(unit), axis=1)
    found = np.take_along_axis(place, best, axis=1)
    index.share = float(np.quantile(found, recall)) if found.size else 1.0
    return index


def usable(vector: str, dims: int | None = None) -> Column:
    """Not null or empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok & (F.size(vector) == dims) if dims else ok, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def score_block(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def score(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            ids, kept, cell = _distinct(vectors, k)
            values = kept.astype(np.float64)
            unit = unit_rows(values)
            q_ids, asked = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector")).astype(np.float64)
            q_unit, bits = unit_rows(asked), queries.column("bits").to_numpy().view(np.uint64)
            depth = 2 * (k + 1)  # equal vectors may fill one k; the rest decides
            for j in np.unique(cell):
                here = np.flatnonzero(cell == j)
                who = np.flatnonzero((bits >> np.uint64(j)) & np.uint64(1))
                if not len(who):
                    continue
                close = q_unit[who] @ unit[here].T
                close[q_ids[who][:, None] == ids[here][None, :]] = -np.inf
                top = np.argpartition(-close, min(depth, len(here)) - 1, axis=1)[:, : min(depth, len(here))]
                rows.append((np.repeat(who, top.shape[1]), here[top.ravel()], np.take_along_axis(close, top, 1).ravel()))
        if not rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        who, what, close = (np.concatenate(c) for c in zip(*rows))
        who, what = _best(who, what, close, ids, depth)
        exact = cosine(asked[who], values[what])
        own = q_ids[who] != ids[what]
        who, what, exact = who[own], what[own], exact[own]
        order = np.lexsort((ids[what], -exact, who))
        order = order[_place(who[order]) < k]
        return pa.table({"query_id": q_ids[who[order]], "vec_id": ids[what[order]], "score": exact[order]})

    return score


def _distinct(vectors: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal vectors of a block the k + 1 with the smallest ids: no other can be among the k nearest."""
    ids, values, cell = vectors.column("vec_id").to_numpy(), np.ascontiguousarray(_matrix(vectors.column("vector"))), vectors.column("cell").to_numpy()
    whole = values.view(np.dtype((np.void, values.dtype.itemsize * values.shape[1]))).ravel()
    _, same = np.unique(whole, return_inverse=True)
    order = np.lexsort((ids, same))
    order = np.sort(order[_place(same[order]) <= k])
    return ids[order], values[order], cell[order]


def _place(grouped: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal values."""
    heads = np.flatnonzero(np.append(True, grouped[1:] != grouped[:-1]))
    return np.arange(len(grouped)) - np.repeat(heads, np.diff(np.append(heads, len(grouped))))


def _best(who, what, close, ids, depth) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids[what], -close, who))
    order = order[_place(who[order]) < depth]
    return who[order], what[order]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in the same order of additions whatever rows stand beside.

    Rows are scaled by powers of two first, which changes no digit but keeps the squares in range.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.97, vector: str = "embedding", centroids: int = CENTROIDS) -> DataFrame:
    """The ``k`` nearest vectors found for each query: ``query_id, rank, vec_id, score``.

    Both inputs have ``vec_id`` and ``vector``. Ties go to the smaller ``vec_id``; a query
    never finds its own id; with fewer vectors all are returned. Vectors that are null,
    empty, zero, of another length than the most frequent one, or that hold null or
    non-finite components take no part, nor do rows with a null id. Rows that repeat an
    id count by their best score. Other columns are ignored; empty inputs give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    element = T.FloatType() if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else T.DoubleType()
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(T.ArrayType(element)).alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    sizes = pick(vectors).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]
    base, asked = pick(vectors).where(F.size("vector") == dims), pick(queries).where(F.size("vector") == dims)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    index = fit(_matrix(sample.column("vector")).astype(np.float64), k, recall, centroids)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = index.cells(unit_rows(_matrix(batch.column(1)).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), pa.array(two, pa.int32()), batch.column(0), batch.column(1)], names=["list", "cell", "vec_id", "vector"])

    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    placed = base.mapInArrow(assign, f"list int, cell int, vec_id long, vector {kind}")
    index.population = np.zeros((len(index.first), len(index.second)), np.int64)
    for one, two, count in placed.groupBy("list", "cell").count().collect():  # at most centroids x centroids rows
        index.population[one, two] = count
    blocks = np.maximum(1, -(-index.population.sum(axis=1) // BLOCK)).tolist()
    chunks = max(1, -(-asked.count() // CHUNK))
    wanted = int(np.ceil(max(index.share * total, min(total, k + 1))))

    def walk(batches):
        for batch in batches:
            out: list[tuple] = []
            matrix = unit_rows(_matrix(batch.column(1)).astype(np.float64)) if batch.num_rows else []
            for at, unit in enumerate(matrix):
                out += [(one, b, at) + (bits,) for one, bits in enumerate(index.walk(unit, wanted)) if bits for b in range(blocks[one])]
            if out:
                one, block, at, bits = zip(*out)
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one, pa.int32()), pa.array(block, pa.int32()), pa.array(np.array(bits, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)],
                    names=["list", "block", "bits", "vec_id", "vector"])

    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    parts = asked.mapInArrow(walk, f"list int, block int, bits long, vec_id long, vector {kind}").withColumn("chunk", chunk)
    per_list = F.array(*[F.lit(b) for b in blocks])[F.col("list")]
    lists = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_list).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keys = ["list", "block", "chunk"]
    hits = lists.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(score_block(k), HITS)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
