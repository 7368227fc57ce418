"""Lloyd's clustering in whole numbers, with equal-average equal-variance search for the nearest centroid.

For vectors of k components, S their sum, m their mean and D the root of ``k * sum(x * x) - S * S``:

    k * |x - c| ** 2  >=  (Sx - Sc) ** 2 + (Dx - Dc) ** 2

Centroids lie sorted by their mean. The search of a vector begins at the centroid with the mean next to its own and goes
outward on both sides, the nearer mean first. Once the first term alone is above the best distance met, no centroid
farther out can win, and the search of that vector ends; where both terms are above it, that one centroid is passed
over. What neither inequality rejects is compared by the exact whole-number distance. The roots are taken rounded down and
their difference less one, so neither inequality rejects too much. All vectors of a batch take their next step together.

Spark deals the vectors, kept once as whole numbers in the shared folder. Each round is one pass over them: a batch
becomes counts and sums for each centroid, so a cluster that holds a third of all vectors costs as much as any
other, and only the sums of the centroids reach the driver. The number of centroids is an argument and the only size there.

Cases: null vectors, those of another length and those with null or non-finite components are left out; repeated rows
are vectors of their own; rows without an id are clustered, and are the last to become first centroids; ties of hash
go by components; with fewer vectors than centroids there are fewer centroids; ties of distance go to the smaller
number; clusters that empty keep their centroid; an empty table gives an empty result; other columns are ignored. Whole
numbers beyond ``LARGEST`` would not fit the sums of a long and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable.llm.common import query, settle

SIZE = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Largest magnitude of a component as a whole number: 16,384 in the units of the table.
LARGEST = 1 << 24
_ROWS = 4096


def whole_vectors(table: DataFrame, size: int = SIZE, scale: int = SCALE, id_column: str = "vec_id",
                  vector_column: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors that count: their components as little-endian 32-bit whole numbers."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            fine = np.isfinite(flat).all(1)
            whole = np.floor(scale * flat[fine])
            if (np.abs(whole) > LARGEST).any():
                raise ValueError(f"a component is beyond {LARGEST // scale}")
            rows = [x.tobytes() for x in whole.astype("<i4")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(fine)), pa.array(rows, pa.binary())], ["vec_id", "v"])

    vector = F.col(vector_column)
    counted = table.where((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull()))
    return counted.select(F.col(id_column).cast("long").alias("vec_id"), vector.cast("array<double>").alias("v")).mapInArrow(
        scan, "vec_id long, v binary")


def first_centroids(vectors: DataFrame, n: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("hash"), "v").orderBy(F.asc_nulls_last("hash"), "v").limit(n).collect()
    return np.array([np.frombuffer(row["v"], "<i4") for row in rows], np.int64)


def _spread(vectors: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """D of each vector, rounded down."""
    square = vectors.shape[1] * (vectors * vectors).sum(1) - sums * sums
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    return root + ((root + 1) * (root + 1) <= square)


class Search:
    """``nearest(vectors)`` gives number and squared distance of each vector's nearest centroid."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(1)
        self.order = np.lexsort((np.arange(len(sums)), sums))
        self.centroids, self.sums = centroids[self.order], sums[self.order]
        self.spread = _spread(self.centroids, self.sums)
        self.compared = self.passed = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, last = vectors.shape[1], len(self.sums) - 1
        sums = vectors.sum(1)
        spread = _spread(vectors, sums)
        high = np.searchsorted(self.sums, sums)  # next centroid upward, and downward below it
        low = high - 1
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        number = np.full(len(vectors), len(self.sums))
        open_ = np.arange(len(vectors))
        while len(open_):
            up = np.where(high[open_] <= last, self.sums[np.minimum(high[open_], last)] - sums[open_], -1)
            down = np.where(low[open_] >= 0, sums[open_] - self.sums[np.maximum(low[open_], 0)], -1)
            upward = (up >= 0) & ((down < 0) | (up <= down))
            gap = np.where(upward, up, down)
            # Distances are whole: one k-th of a bound, rounded up, is a bound. The next mean is the nearest one left.
            going = (gap >= 0) & (-(-gap * gap // size) <= best[open_])
            open_, gap, upward = open_[going], gap[going], upward[going]
            at = np.where(upward, high[open_], low[open_])
            high[open_] += upward
            low[open_] -= ~upward
            apart = np.maximum(np.abs(spread[open_] - self.spread[at]) - 1, 0)
            near = -(-(gap * gap + apart * apart) // size) <= best[open_]
            self.passed += int((~near).sum())
            self.compared += int(near.sum())
            who, which = open_[near], at[near]
            off = vectors[who] - self.centroids[which]
            distance, own = (off * off).sum(1), self.order[which]
            wins = (distance < best[who]) | ((distance == best[who]) & (own < number[who]))
            best[who[wins]], number[who[wins]] = distance[wins], own[wins]
        return number, best


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            raw = b"".join(part.column(1).to_pylist())
            yield part.column(0), np.frombuffer(raw, "<i4").reshape(-1, size).astype(np.int64)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: whole means, rounded down."""
    k, size = centroids.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, part in _read(batches, size):
            number, _ = search.nearest(part)
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += part[number == c].sum(0)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(there, size + 1), pa.int32()), pa.array(np.tile(np.arange(size + 1), len(there)), pa.int32()),
            pa.array(np.column_stack([total, n])[there].ravel())], ["cluster", "i", "s"])

    # Sums of each component, and the number of vectors behind them.
    parts = vectors.mapInArrow(scan, "cluster int, i int, s long").groupBy("cluster", "i").agg(F.sum("s").alias("s"))
    sums = {(row["cluster"], row["i"]): row["s"] for row in parts.collect()}
    moved = centroids.copy()
    for c in {c for c, _ in sums}:
        moved[c] = [sums[c, i] // sums[c, size] for i in range(size)]
    return moved


def cluster(table: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE,
            scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding",
            ) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of each vector, and the final centroids as whole numbers."""
    vectors = settle(whole_vectors(table, size, scale, id_column, vector_column))
    centroids = first_centroids(vectors, n, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = _moved(vectors, centroids)
        if (moved == centroids).all():
            break  # all later rounds would give the same
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for ids, part in _read(batches, size):
            number, distance = search.nearest(part)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return settle(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long")), centroids


def clusters(table: DataFrame, n: int = CENTROIDS, **options) -> DataFrame:
    """A row for each vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    found, centroids = cluster(table, n, **options)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    total = sum(row["s"] for row in sums)
    # One row for each centroid.
    rows = [(row["cluster"], row["s"], total,
             hashlib.sha256(",".join(map(str, centroids[row["cluster"]].tolist())).encode()).hexdigest()) for row in sums]
    named = table.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> str:
    """The same in SQL: vectors and centroids a component to a row, each round two tables."""
    def nearest(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} AS c USING (i) GROUP BY v.r, c.c)
  GROUP BY r)"""

    steps = [nearest(0)]
    for k in range(rounds):
        steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM c{k} AS c LEFT JOIN (
    SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
      SELECT a.c, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{k} AS a JOIN v USING (r) GROUP BY a.c, v.i)) AS m
    USING (c, i))""")
        steps.append(nearest(k + 1))
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT r, unnest(range(1, {size} + 1)) AS i, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x
  FROM e),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT f.c, v.i, v.x FROM f JOIN v USING (r) WHERE f.c < {n}),
{",".join(steps)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY c)
SELECT e.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.s AS centroid_sha256
FROM a{rounds} AS a JOIN e USING (r) JOIN h USING (c)
"""


@query("op11_centroid_clusters", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
