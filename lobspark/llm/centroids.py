"""Operator 13: clusters around centroids, with exact integer distances found by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import stored, table

#: Up to this magnitude of a component all distances, and their sums within a task, are exact 64-bit integers.
MOST = 1 << 26

#: After so many dimensions the partial distances are compared with the best whole one.
STEPS = (8, 16, 32)

#: Vectors compared at once, so that the arrays of a step stay in a processor's cache.
AT_ONCE = 2048


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dims`` components, none null or non-finite, and these as floor(scale * x), x as double."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    right = sizes == dims
    flat = column.filter(pa.array(right)).flatten()
    whole = np.asarray(flat.is_valid()).reshape(-1, dims)
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    fine = (whole & np.isfinite(x)).all(axis=1)
    right[np.flatnonzero(right)[~fine]] = False
    x = np.floor(scale * x[fine])
    if x.size and np.abs(x).max() > MOST:
        raise ValueError(f"a component above {MOST // scale} in magnitude: squared distances might not fit 64 bits")
    return right, x.astype(np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``v`` the number of the nearest centroid, the smallest one of equals, and the squared distance.

    Both come with the dimensions of most variance first. The sums over the first few tell which centroid to finish
    first; its distance is the bound. Each other one goes on through the dimensions for the vectors for which its
    sum is not yet strictly above their best, and what is left at the end is compared in full.
    """
    which, best = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    steps = [s for s in STEPS if s < v.shape[1]] + [v.shape[1]]
    for at in range(0, len(v), AT_ONCE):
        part = v[at : at + AT_ONCE]
        begun = np.stack([((part[:, : steps[0]] - c[: steps[0]]) ** 2).sum(axis=1) for c in centroids])
        own = begun.argmin(axis=0)
        least = ((part - centroids[own]) ** 2).sum(axis=1)
        for k, c in enumerate(centroids):
            left = np.flatnonzero((begun[k] <= least) & (own != k))
            d = begun[k, left]
            for a, b in zip(steps, steps[1:], strict=False):
                d = d + ((part[left, a:b] - c[a:b]) ** 2).sum(axis=1)
                alive = d <= least[left]
                left, d = left[alive], d[alive]
            won = (d < least[left]) | (k < own[left])  # none is above the best; an equal one wins by its number
            own[left[won]], least[left[won]] = k, d[won]
        which[at : at + AT_ONCE], best[at : at + AT_ONCE] = own, least
    return which, best


def spread(vectors: DataFrame, dims: int, scale: int) -> list[int]:
    """The dimensions by their variance over all vectors, highest first: only the order of work depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            _, v = integers(batch.column(0), dims, scale)
            n, total, square = n + len(v), total + v.sum(axis=0), square + (v.astype(np.float64) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(dims), np.full(dims, n), total, square)], ("dim", "n", "total", "square"))

    sums = vectors.select("embedding").mapInArrow(run, "dim long, n long, total double, square double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("q"))
    by = {r.dim: r.q / r.n - (r.t / r.n) ** 2 if r.n else 0.0 for r in sums.collect()}  # a row a dimension
    return sorted(range(dims), key=lambda k: (-by.get(k, 0.0), k))


def starts(vectors: DataFrame, k: int, seed: int, dims: int, scale: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, those without id last, equal ones by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, v = integers(batch.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right)), pa.array(list(v), pa.list_(pa.int64()))], ("vec_id", "v"))

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v array<long>").orderBy(hashed.asc_nulls_last(), "v").limit(k)
    return np.array([r.v for r in first.collect()], np.int64).reshape(-1, dims)


def assigned(vectors: DataFrame, centroids: np.ndarray, order: list[int], scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of all kept vectors."""
    dims, near = centroids.shape[1], np.ascontiguousarray(centroids[:, order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, v = integers(batch.column(1), dims, scale)
            own, d = nearest(v[:, order], near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right)), pa.array(own, pa.int32()), pa.array(d)], ("vec_id", "cluster", "distance"))

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray, order: list[int], scale: int) -> np.ndarray:
    """The centroids after one round. A task adds up its vectors by cluster, so that it sends a row a centroid and dimension."""
    k, dims = centroids.shape
    near = np.ascontiguousarray(centroids[:, order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            _, v = integers(batch.column(0), dims, scale)
            own, _ = nearest(v[:, order], near)
            many = np.bincount(own, minlength=k)
            some = np.flatnonzero(many)
            if len(some):
                n += many
                total[some] += np.add.reduceat(v[np.argsort(own, kind="stable")], (np.cumsum(many) - many)[some])
        some = np.flatnonzero(n)
        cells = (np.repeat(some, dims), np.tile(np.arange(dims), len(some)), np.repeat(n[some], dims), total[some].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ("cluster", "dim", "n", "total"))

    sums = vectors.select("embedding").mapInArrow(run, "cluster long, dim long, n long, total long").groupBy("cluster", "dim")
    out = centroids.copy()
    for r in sums.agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():  # at most k * dims rows
        out[r.cluster, r.dim] = int(r.total) // int(r.n)
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> DataFrame:
    """Each kept vector's cluster after ``rounds`` rounds: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    vectors: (vec_id, embedding); others than those of ``dims`` finite components are left out, and so are other columns.
    Vectors without id, or with an id that occurs again, are kept, a row each. With fewer than k vectors there are as many
    centroids as vectors, and without any no rows. Of equally near centroids the smallest number wins. A component above
    ``MOST / scale`` in magnitude raises. The driver holds k centroids and the sums of their components.
    """
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding")
    now, order = starts(vectors, k, seed, dims, scale), spread(vectors, dims, scale)
    for _ in range(rounds if len(now) else 0):
        now = moved(vectors, now, order, scale)
    if not len(now):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    out = stored(assigned(vectors, now, order, scale))
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"cells AS MATERIALIZED (SELECT r, unnest(range({dims})) AS dim, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS dim, unnest(v) AS y FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept) WHERE c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d FROM (SELECT r, c, sum((x - y) * (x - y)) AS d FROM cells JOIN c{i} USING (dim) GROUP BY r, c) GROUP BY r)")
        if i < rounds:
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, dim, coalesce(m, y) AS y FROM c{i} LEFT JOIN (SELECT c, dim, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM a{i} JOIN cells USING (r) GROUP BY c, dim) USING (c, dim))")
    return f"""WITH {", ".join(parts)}, h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{rounds} JOIN h USING (c) JOIN kept USING (r)"""


OP13_SQL = _sql()
