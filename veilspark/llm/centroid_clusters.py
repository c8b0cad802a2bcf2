"""Exact k-means over vectors of whole numbers, screened by norms of segments.

Each vector is compressed once, to a step and one signed byte a component; what compression loses, x - step * code, is kept
as the norm of each of its segments of a few components. With these, x.c <= step * code.c + sum over segments of
|lost_s| |c_s| (Cauchy-Schwarz on each segment), which bounds every squared distance |x|^2 + |c|^2 - 2 x.c from below. The
exact distance to the centroid with the least bound caps the others: centroids whose bound lies above it are never computed,
the rest get exact distances in whole numbers. Bounds are loosened by more than their rounding error, so screening changes
no result. On the given tables 2.5 to 3 % of all distances are computed, little more than one a vector; norms of the
segments of whole vectors, without codes, were tried and left 96 %, as they see magnitudes but no directions.

A round is one pass over the compressed table: tasks sum their own vectors by cluster and Spark adds up these sums, at most
clusters x (components + 1) rows a task. Only centroids reach the driver, `clusters` vectors whatever the input's size.

Defined cases: vectors of another length than `size`, and those that `vectors` leaves out, take no part and get no row. Rows
that share an id, or have none, are vectors of their own; as starting points, rows without an id come last, rows of one id by
their numbers. Fewer vectors than clusters: each is a starting point. No vector: no row. Equal vectors as starting points:
the first takes all, the others stay as they are. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import durable, scratch, written
from veilspark.llm.vectors import packed, whole


@dataclass(frozen=True)
class Settings:
    size: int = 64
    clusters: int = 40
    rounds: int = 5
    scale: int = 256
    #: Components of a segment.
    segment: int = 8
    #: Codes go from -levels to levels.
    levels: int = 127
    #: What is hashed with an id to draw the starting points.
    seed: str = "2:"


def segment_norms(x: np.ndarray, segment: int) -> np.ndarray:
    """The Euclidean norm of each run of `segment` components (the last may be shorter)."""
    return np.sqrt(np.add.reduceat(np.square(x.astype(np.float64)), np.arange(0, x.shape[1], segment), axis=1))


@dataclass
class Compressed:
    """Vectors in short: step, codes, norms of what these lose by segment, squared norm."""

    step: np.ndarray
    code: np.ndarray
    lost: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, s: Settings) -> Compressed:
        step = np.maximum(1, -(-np.abs(x).max(axis=1) // s.levels))
        code = (x + step[:, None] // 2) // step[:, None]
        return cls(step, code.astype(np.int8), segment_norms(x - step[:, None] * code, s.segment), np.einsum("ij,ij->i", x, x))

    def bounds(self, c: np.ndarray, c_norms: np.ndarray) -> np.ndarray:
        """What no squared distance to these centroids lies below; a row for each vector."""
        square = self.square[:, None] + np.einsum("ij,ij->i", c, c)[None, :].astype(np.float64)
        product = self.step[:, None] * (self.code.astype(np.float64) @ c.T) + self.lost @ c_norms.T
        return square - 2 * product - (1e-9 * square + 1e-6)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), the exact squared distance, and how many of them were computed.

    `low` has bounds, a row for each vector, and is changed."""
    cluster = low.argmin(axis=1)
    best = squares(x, c[cluster])
    low[np.arange(len(x)), cluster] = np.inf
    rows, columns = np.nonzero(low <= best[:, None])
    done = len(x) + len(rows)
    for at in range(0, len(rows), 1 << 14):
        r, k = rows[at : at + (1 << 14)], columns[at : at + (1 << 14)]
        d = squares(x[r], c[k])
        near = (d < best[r]) | ((d == best[r]) & (k < cluster[r]))
        r, k, d = r[near], k[near], d[near]
        if len(r):
            order = np.lexsort((k, d, r))
            r, k, d = r[order], k[order], d[order]
            top = np.ones(len(r), bool)
            top[1:] = r[1:] != r[:-1]
            best[r[top]], cluster[r[top]] = d[top], k[top]
    return cluster, best, done


SHAPE = "vec_id long, v binary, step long, code binary, lost binary, square long"


def compressed(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The vectors that take part: vec_id, v (numbers), and the compressed form."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole(batch.column(1), s.scale):
                if x.shape[1] == s.size and len(rows):
                    z = Compressed.of(x, s)
                    parts = [packed(y) for y in (x.astype("<i4"), z.code, z.lost.astype("<f8"))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), parts[0], pa.array(z.step), *parts[1:], pa.array(z.square)], names=[c.split(" ")[0] for c in SHAPE.split(", ")])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == s.size)
    return rows.mapInArrow(convert, SHAPE)


class _Assigner:
    """Vectors of a batch to centroids; made on the driver, used in tasks."""

    def __init__(self, centroids: np.ndarray, s: Settings) -> None:
        self.c, self.s, self.norms = centroids, s, segment_norms(centroids, s.segment)

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Runs of the batch: their first row, numbers, clusters, distances, and how many distances were computed."""
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            n = part.num_rows
            v, code, lost = (np.frombuffer(b"".join(part.column(i).to_pylist()), kind).reshape(n, -1) for i, kind in ((1, "<i4"), (3, np.int8), (4, "<f8")))
            x = v.astype(np.int64)
            z = Compressed(part.column(2).to_numpy(), code, lost, part.column(5).to_numpy())
            yield at, x, *nearest(x, z.bounds(self.c, self.norms), self.c)


def _moved(table: DataFrame, centroids: np.ndarray, s: Settings) -> np.ndarray:
    """The next centroids: exact floors of the mean of each cluster's vectors; one without vectors stays."""
    assign = _Assigner(centroids, s)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x, cluster, _, _ in assign(batch):
                order = np.argsort(cluster, kind="stable")
                own, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
                sums[own] += np.add.reduceat(x[order], first, axis=0)
                counts[own] += n
        own = np.flatnonzero(counts)
        both = np.concatenate((counts[own, None], sums[own]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, both.shape[1]), pa.int32()), pa.array(np.tile(np.arange(both.shape[1]), len(own)), pa.int32()), pa.array(both.ravel(), pa.int64())], names=["cluster", "place", "total"])

    out = centroids.copy()
    got = table.mapInArrow(totals, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    counts = {r.cluster: r.total for r in got if r.place == 0}
    for r in got:
        if r.place:
            out[r.cluster, r.place - 1] = r.total // counts[r.cluster]
    return out


def clusters(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    table = written(compressed(vectors, s), f"{scratch(spark)}/vectors")
    key = F.sha2(F.concat(F.lit(s.seed), F.col("vec_id").cast("string")), 256)
    first = table.orderBy(key.asc_nulls_last(), "v").limit(s.clusters).select("v").collect()
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], shape)
    c = np.array([np.frombuffer(r.v, "<i4") for r in first], np.int64)
    for _ in range(s.rounds):
        c = _moved(table, c, s)
    assign = _Assigner(c, s)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, cluster, distance, _ in assign(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    last = durable(table.mapInArrow(assigned, "vec_id long, cluster int, distance long"))
    sums = {r.cluster: r.total for r in last.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    facts = spark.createDataFrame([(k, n, sum(sums.values()), digests[k]) for k, n in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(facts), "cluster").select(*(f.split(" ")[0] for f in shape.split(", ")))  # a row for each cluster


def oracle(s: Settings = Settings()) -> str:
    """The same in SQL: every distance of every round."""
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({s.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {s.size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {s.size})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{s.seed}' || vec_id), v) - 1 AS k, v AS c FROM v ORDER BY sha256('{s.seed}' || vec_id), v LIMIT {s.clusters})",
        f"x AS (SELECT vec_id, unnest(range(1, {s.size + 1})) AS j, unnest(v) AS n FROM v)",
    ]

    def near(i: int) -> str:
        distance = "list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        return f"a{i} AS MATERIALIZED (SELECT vec_id, min(d * 1000 + k) % 1000 AS k, min(d) AS d FROM (SELECT v.vec_id, c.k, {distance} AS d FROM v, c{i} c) GROUP BY vec_id)"

    for i in range(s.rounds):
        parts.append(near(i))
        parts.append(f"m{i} AS (SELECT k, list(m ORDER BY j) AS c FROM (SELECT a.k, x.j, ((sum(n) - ((sum(n) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM x JOIN a{i} a USING (vec_id) GROUP BY a.k, x.j) GROUP BY k)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (k))")
    parts.append(near(s.rounds))
    return (
        f"WITH {', '.join(parts)} SELECT a.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{s.rounds} a JOIN c{s.rounds} c USING (k)"
    )
