"""Hard negatives by a full sort of every anchor's scores.

A score is the inner product of two vectors of whole numbers, exact. Anchors are a stated set of queries, the rows whose id
`every` divides; they meet all rows in blocks. The vectors are written once as whole numbers; then, for each slab of at most
`slab` anchors (a bound on what tasks are sent), two passes go over that table:

1. In each block of rows an anchor's same-label rows are sorted by score and id, and its first ones kept. A window over the
   blocks' finds gives the anchor's positives.
2. In each block an anchor's rows of other labels are sorted by score and id. For each positive, a binary search finds the
   first that doesn't exceed its upper limit, and the next k that don't fall below its lower limit are read. The first k of
   all blocks' finds are the first k of all rows, as each block's finds hold its own first k.

A task holds one block's scores for a run of anchors and the finds so far; it returns at most k a positive. Nothing is grouped
by label or id, so a hot label, id or vector costs no more than others. Anchors x rows scores are computed, as the job asks.

Defined cases: rows without a vec_id, label or vector, or with a component that `vectors` leaves out, take no part. Vectors
of different lengths have no score with each other; empty vectors score 0. Rows that share an id are rows of their own; an
anchor that is there twice (same id, label and vector) is asked once, and its copy is one of its positives. An anchor without
positives, or a positive without negatives in its limits, gives no row, and so does an empty table. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import scratch, written
from veilspark.llm.vectors import packed, whole

TABLE = "vec_id long, label long, v binary"
FINDS = "anchor int, place int, id long, score long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Settings:
    every: int = 100
    positives: int = 5
    negatives: int = 10
    #: A negative's score is at least `low` and at most `high` hundredths of the positive's.
    low: int = 30
    high: int = 90
    scale: int = 256
    #: Anchors in one slab, whose vectors and positives are sent to all tasks.
    slab: int = 1 << 15
    #: Rows in a block, and scores held at once.
    block: int = 4096
    scores: int = 1 << 21


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two arrays, exact; by floating-point numbers where these hold every sum exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ x.T


def numbered(rows: DataFrame, s: Settings) -> DataFrame:
    """The rows that take part: vec_id, label, v (whole numbers)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in whole(batch.column(2), s.scale):
                if len(own):
                    at = pa.array(own)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), packed(x.astype("<i4"))], names=["vec_id", "label", "v"])

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL").mapInArrow(convert, TABLE)


class _Slab:
    """Some anchors, by the length of their vectors and by label; what tasks are sent."""

    def __init__(self, anchors: list, s: Settings) -> None:
        self.s, self.n = s, len(anchors)
        self.ids, self.labels = np.array([r.vec_id for r in anchors], np.int64), np.array([r.label for r in anchors], np.int64)
        vectors = [np.frombuffer(r.v, "<i4") for r in anchors]
        sizes = np.array([len(v) for v in vectors])
        self.by_size = {int(n): (own := np.flatnonzero(sizes == n), np.array([vectors[i] for i in own], np.int64).reshape(len(own), n)) for n in np.unique(sizes)}

    def met(self, batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Anchors of one label (their places), and a block's rows of that label or of the others: their ids, ascending, and all scores."""
        for batch in batches:
            ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = pc.binary_length(v).to_numpy(zero_copy_only=False)
            for size, (own, a) in self.by_size.items():
                rows = np.flatnonzero(sizes == 4 * size)
                for at in range(0, len(rows), self.s.block):
                    part = rows[at : at + self.s.block]
                    part = part[np.argsort(ids[part], kind="stable")]
                    x = np.frombuffer(b"".join(v.take(pa.array(part)).to_pylist()), "<i4").reshape(len(part), size).astype(np.int64)
                    for label in np.unique(self.labels[own]):
                        mine = np.flatnonzero(self.labels[own] == label)
                        met = (labels[part] == label) == same
                        if met.any():
                            for first in range(0, len(mine), step := max(1, self.s.scores // int(met.sum()))):
                                some = mine[first : first + step]
                                yield own[some], ids[part[met]], products(a[some], x[met])


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row by falling score, then id; the least score marks empty places."""
    order = np.lexsort((ids, -score), axis=-1)[..., :k]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


#: Stands for "none" among scores; no score is as low.
NONE = -(2**62) * 2 + 1


class _Finds:
    """The best finds so far of each (anchor, positive)."""

    def __init__(self, shape: tuple[int, ...], k: int) -> None:
        self.k, self.score, self.id = k, np.full((*shape, k), NONE, np.int64), np.zeros((*shape, k), np.int64)

    def add(self, own: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.score[own], self.id[own] = _first(np.concatenate((self.score[own], score), -1), np.concatenate((self.id[own], ids), -1), self.k)

    def rows(self) -> pa.RecordBatch:
        at = np.nonzero(self.score != NONE)
        place = at[1] if len(at) == 3 else np.zeros(len(at[0]), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(place, pa.int32()), pa.array(self.id[at]), pa.array(self.score[at])], names=["anchor", "place", "id", "score"])


def _same(slab: _Slab) -> Callable:
    """Pass 1: each anchor's first same-label rows, itself among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = slab.s.positives + 1
        best = _Finds((slab.n,), k)
        for own, ids, score in slab.met(batches, True):
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids ascend, so ties are in their order
            best.add(own, np.take_along_axis(score, order, 1), ids[order])
        yield best.rows()

    return run


def _others(slab: _Slab, positive: np.ndarray) -> Callable:
    """Pass 2: for each positive the first rows of other labels within its limits. `positive`: scores, NONE where there is none."""

    s, there = slab.s, positive != NONE
    p = np.where(there, positive, 0).astype(object)  # hundredfold scores may leave a long
    upper, lower = (s.high * p // 100).astype(np.int64), (-(-s.low * p // 100)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Finds(positive.shape, s.negatives)
        for own, ids, score in slab.met(batches, False):
            order = np.argsort(-score, axis=1, kind="stable")
            score, ids = np.take_along_axis(score, order, 1), ids[order]
            n = score.shape[1]
            first = np.array([np.searchsorted(-score[i], -upper[a], side="left") for i, a in enumerate(own)])
            at = first[:, :, None] + np.arange(s.negatives)
            inside = at < n
            at = np.minimum(at, n - 1).reshape(len(own), -1)
            found, whose = np.take_along_axis(score, at, 1).reshape(inside.shape), np.take_along_axis(ids, at, 1).reshape(inside.shape)
            inside &= (found >= lower[own][:, :, None]) & there[own][:, :, None]
            best.add(own, np.where(inside, found, NONE), whose)
        yield best.rows()

    return run


def _ranked(finds: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return finds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _slab(table: DataFrame, anchors: list, s: Settings) -> DataFrame | None:
    spark = table.sparkSession
    slab = _Slab(anchors, s)
    # the first `positives` + 1 hold the anchor itself, or as many others that come before it
    firsts = _ranked(table.mapInArrow(_same(slab), FINDS), s.positives + 1, "anchor").select("anchor", "rank", "id", "score").collect()
    own = {i: int((x * x).sum()) for where, v in slab.by_size.values() for i, x in zip(where.tolist(), v, strict=True)}
    positive, whose = np.full((slab.n, s.positives), NONE, np.int64), np.zeros((slab.n, s.positives), np.int64)
    filled, passed = np.zeros(slab.n, int), np.zeros(slab.n, bool)
    for r in sorted(firsts, key=lambda r: (r.anchor, r.rank)):
        if not passed[r.anchor] and r.id == slab.ids[r.anchor] and r.score == own[r.anchor]:
            passed[r.anchor] = True
        elif filled[r.anchor] < s.positives:
            positive[r.anchor, filled[r.anchor]], whose[r.anchor, filled[r.anchor]] = r.score, r.id
            filled[r.anchor] += 1
    places = np.nonzero(positive != NONE)
    if not len(places[0]):
        return None
    names = spark.createDataFrame([(int(a), int(p), int(slab.ids[a]), int(whose[a, p]), int(positive[a, p])) for a, p in zip(*places, strict=True)], "anchor int, place int, anchor_id long, positive_id long, positive_score long")
    found = _ranked(table.mapInArrow(_others(slab, positive), FINDS), s.negatives, "anchor", "place")
    return found.join(F.broadcast(names), ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))  # at most slab x positives rows


def hard_negatives(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per anchor and positive, the first negatives within its limits: see OUT."""
    spark = rows.sparkSession
    table = written(numbered(rows, s), f"{scratch(spark)}/vectors")
    anchors = table.where(F.col("vec_id") % s.every == 0).distinct()
    n = anchors.count()
    slabs = -(-n // s.slab)
    out = []
    for i in range(slabs):
        part = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(slabs)) == i).orderBy("vec_id", "label", "v").collect()
        out.append(_slab(table, part, s))
    out = [x for x in out if x is not None]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], OUT)


def moved_label(vec_id: Column, label: Column) -> Column:
    """The labels that the registered query uses: where 7 divides the id, the next of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def oracle(s: Settings = Settings()) -> str:
    """The registered query in SQL: every score of every anchor."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({s.scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS a, x.vec_id AS id, a.label = x.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score FROM v a JOIN v x ON a.vec_id % {s.every} = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= {s.positives})
SELECT p.a AS anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND {s.low} * p.score <= 100 * n.score AND 100 * n.score <= {s.high} * p.score
WINDOW w AS (PARTITION BY p.a, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= {s.negatives}"""
