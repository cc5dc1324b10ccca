"""Exact k-means on integer vectors by a vector-approximation file.

Each component is kept twice: whole, and as the number of one of ``2^BITS`` cells of its dimension (packed, 48 bytes for 64 components). For each
centroid and dimension a lookup table holds the least and the largest share that any component of a cell can have in the distance; summed over
the dimensions they give an interval for the distance of every centroid. Only the centroids whose interval reaches below the smallest upper
end are computed from the whole vector, and only the vectors for which more than one is left are looked at at all.

All centroids share the term ``|v - m|^2`` of their distances (``m``: the centroids' middle), so the intervals are of what is left,
``-2 (v - m)(c - m) + |c - m|^2``. That makes them narrow: a quadratic term would widen them by more than centroids differ.

- Everything is integer, so ties and floors are exact, and the result does not depend on the partitioning.
- The edges of the cells are quantiles of a bounded sample (``SAMPLE`` vectors); least and largest components of the whole table close the outer
  cells. The sample decides how narrow intervals are, never a result.
- A round is one scan without a shuffle of vectors: each task adds up its vectors by cluster, and one row for each task and cluster goes on.
  A lost executor repeats its scan. ``k`` centroids, two numbers for each dimension and the sample are all that the driver holds.

``vectors`` needs ``vec_id`` and ``embedding``. Rows whose vector is missing, has another length, or holds a missing, non-finite or too large
component (``LARGEST``: squared distances must fit a long) are left out. Equal rows count as often as they occur. Fewer rows than ``k`` give as many
centroids as there are rows with an id; no rows give no rows. Rows without ``vec_id`` are assigned but never start a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropspark.llm.common import tidy, written

BITS, SAMPLE, CHUNK = 6, 4096, 4096
#: Components must be smaller than this before they are scaled by 256.
LARGEST = float(1 << 18)


def whole_components(column: str, scale: int = 256) -> tuple[Column, Column]:
    """Whether every component of an array can be turned into an integer, and the integers ``floor(scale * x)``."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST))
    return F.coalesce(sound, F.lit(False)), F.transform(column, lambda x: F.floor(x.cast("double") * scale))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Cells:
    """Cells of every dimension: ``edges`` (dimensions x 2^BITS - 1; a value equal to an edge is in the cell above) and outer ends."""

    def __init__(self, edges: np.ndarray, least: np.ndarray, largest: np.ndarray):
        self.edges = edges
        self.low = np.concatenate([least[:, None], edges], axis=1)
        self.high = np.concatenate([edges - 1, largest[:, None]], axis=1)
        self.bits = int(np.log2(self.low.shape[1]))

    def pack(self, rows: np.ndarray) -> list[bytes]:
        numbers = np.stack([np.searchsorted(e, rows[:, d], side="right") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)
        bits = np.unpackbits(numbers[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [r.tobytes() for r in np.packbits(bits.reshape(len(rows), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        """Cell numbers, dimension by dimension."""
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(rows, axis=1, count=len(self.edges) * self.bits).reshape(len(packed), len(self.edges), self.bits)
        return (bits @ (1 << np.arange(self.bits - 1, -1, -1)).astype(np.uint8)).T


class Tables:
    """Lookup tables of one set of centroids: the interval of every centroid's distance, less the shared term, from cell numbers alone."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        middle = centroids.sum(axis=0) // len(centroids)
        apart = (centroids - middle).T
        ends = [-2 * (edge - middle[:, None])[:, :, None] * apart[:, None, :] for edge in (cells.low, cells.high)]
        self.centroids, self.shared = centroids, (apart * apart).sum(axis=0)
        self.low, self.high = np.minimum(*ends), np.maximum(*ends)

    def intervals(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = (np.tile(self.shared, (numbers.shape[1], 1)) for _ in range(2))
        for d, cell in enumerate(numbers):
            low += self.low[d][cell]
            high += self.high[d][cell]
        return low, high

    def nearest(self, numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, int]:
        """Number of the nearest centroid of each vector (ties: the smaller), and how many vectors had to be fetched for it."""
        low, high = self.intervals(numbers)
        open_ = low <= high.min(axis=1, keepdims=True)
        best = open_.argmax(axis=1)
        many = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(many):
            at, k = np.nonzero(open_[many])
            exact = np.full((len(many), len(self.centroids)), np.iinfo(np.int64).max)
            for i in range(0, len(at), 1 << 16):
                part = slice(i, i + (1 << 16))
                apart = rows[many[at[part]]] - self.centroids[k[part]]
                exact[at[part], k[part]] = np.einsum("ij,ij->i", apart, apart)
            best[many] = exact.argmin(axis=1)
        return best, len(many)


def _parts(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            yield part, cells.unpack(part.column("cells").to_pylist()), matrix(part.column("v"))


def approximated(vectors: DataFrame, dims: int) -> tuple[DataFrame, Cells] | None:
    """The table of the kept vectors with their cells, and what the cells are; None if no vector is kept."""
    sound, whole = whole_components("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") == dims) & sound)
    kept = written(rows.select("vec_id", whole.alias("v")))
    sample = kept.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow()
    if not len(sample):
        return None
    ends = kept.agg(*[f(F.col("v")[d]) for f in (F.min, F.max) for d in range(dims)]).first()
    shares = np.arange(1, 1 << BITS) / (1 << BITS)
    edges = np.quantile(matrix(sample["v"]), shares, axis=0, method="higher").T.astype(np.int64)
    cells = Cells(np.ascontiguousarray(edges), np.array(ends[:dims]), np.array(ends[dims:]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cells.pack(matrix(batch.column("v"))), pa.binary()), batch.column("v")], ["vec_id", "cells", "v"])

    return written(kept.mapInArrow(tidy(pack), "vec_id long, cells binary, v array<long>")), cells


def first_centroids(kept: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; repeated ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in kept.filter("vec_id IS NOT NULL").orderBy(key, "v").limit(k).select("v").collect()], np.int64)


def next_centroids(kept: DataFrame, cells: Cells, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Floors of the clusters' means; a cluster without vectors keeps its centroid. And how many vectors were fetched to decide."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, fetched = Tables(cells, centroids), 0
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, numbers, rows in _parts(batches, cells):
            best, more = tables.nearest(numbers, rows)
            fetched += more
            n += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            own, starts = np.unique(best[order], return_index=True)
            sums[own] += np.add.reduceat(rows[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(np.where(np.arange(k) == 0, fetched, 0)), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "fetched", "sums"])

    added = kept.mapInArrow(tidy(add), "cluster long, n long, fetched long, sums array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("fetched").alias("fetched"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)]).collect()
    moved, fetched = centroids.copy(), 0
    for r in added:
        fetched += r["fetched"]
        if r["n"]:
            moved[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return moved, fetched


def assigned(kept: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every kept vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(cells, centroids)
        for part, numbers, rows in _parts(batches, cells):
            best, _ = tables.nearest(numbers, rows)
            apart = rows - centroids[best]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(np.einsum("ij,ij->i", apart, apart))], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(tidy(run), "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector after ``rounds`` rounds and one more
    assignment. Inertias that no long holds are missing."""
    spark = vectors.sparkSession
    found = approximated(vectors, dims)
    centroids = first_centroids(found[0], k) if found else np.zeros((0, dims), np.int64)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids, _ = next_centroids(*found, centroids)
    rows = written(assigned(*found, centroids))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows at most
    total = sum(int(r["own"]) for r in sums)
    fits = lambda n: n if n < 1 << 63 else None
    about = [(r["cluster"], fits(int(r["own"])), fits(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    schema = T.StructType([T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType()))])
    return rows.join(F.broadcast(spark.createDataFrame(about, schema)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The same in DuckDB SQL, one pair of tables for each round."""
    parts = [f"""vectors AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR abs(x) >= {LARGEST}]) = 0),
    parts AS MATERIALIZED (SELECT r, unnest(generate_series(1, {dims})) AS i, unnest(v) AS x FROM vectors),
    seeds AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster FROM vectors WHERE vec_id IS NOT NULL
        ORDER BY cluster LIMIT {k}),
    c0 AS MATERIALIZED (SELECT cluster, i, x AS c FROM seeds JOIN parts USING (r))"""]
    for n in range(rounds + 1):
        parts.append(f"""d{n} AS (SELECT r, cluster, sum((x - c) * (x - c)) AS distance FROM parts JOIN c{n} USING (i) GROUP BY r, cluster),
    a{n} AS MATERIALIZED (SELECT r, arg_min(cluster, distance * {k} + cluster) AS cluster, min(distance) AS distance FROM d{n} GROUP BY r)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
        SELECT cluster, i, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
        FROM a{n} JOIN parts USING (r) GROUP BY cluster, i) USING (cluster, i))""")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
        (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN vectors USING (r) JOIN (SELECT cluster, sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)"""
