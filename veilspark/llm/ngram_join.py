"""A similarity self-join on sets of five-word shingles, with candidates pruned by a Bayesian test on MinHash values.

1. Every whole text becomes its set of shingle hashes, a MinHash signature and band keys. Texts with equal sets are one
   class of copies from here on, so a group of copies costs one row however many there are.
2. Sets that share a band key are candidates. A bucket isn't paired out: each of its sets points to the bucket's least
   one, and the components of these pointers are the groups inside which pairs are looked at.
3. A group is dealt over blocks of about `block` sets, each pair of blocks a task's work. MinHash values are compared
   `step` at a time; a pair is dropped when the posterior probability that its similarity reaches the threshold falls
   below `tolerance` (uniform prior, so after m equal values of n it is P(Bin(n + 1, threshold) <= m)). The rest is
   verified exactly from the sets. A task returns, for each of its sets, how many links it has and a linked set, never pairs.
4. The components of the links are the near-duplicate classes.

A link at the threshold shares no band with probability (1 - 0.8^6)^40 = 5e-6, and is pruned with about `tolerance`.

Defined cases: a text of one to four words is one shingle; a null or empty text has none, is a class of its own with no
links, also where several documents are empty; repeated rows are copies of each other; a null doc_id is kept, and stands
behind all others when a class is named after its least id; rows that share an id are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import durable, fresh, mixed, row_key, runs, texts_of, window_hashes, word_hashes, words_of
from veilspark.llm.components import components

#: Stands for a null doc_id while rows are told apart.
NO_ID = 2**63 - 1
#: So many bytes of a shingle's hash go to the tasks that compare sets: two different shingles of one pair of texts with
#: a thousand shingles each are taken for equal once in 280 million pairs.
BYTES = 6


@dataclass(frozen=True)
class Join:
    words: int = 5
    tenths: int = 8  # the threshold in tenths
    bands: int = 40
    rows: int = 6
    step: int = 24
    tolerance: float = 1e-6
    block: int = 160
    seed: int = 6


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """The sorted set of shingle hashes of a text, given its words' hashes."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < words:
        return window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(window_hashes(hashes, words))


def coefficients(how: Join) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * how.bands * how.rows + 1, dtype=np.uint64) + np.uint64(how.seed << 32))
    x = (x >> np.uint64(32)).astype(np.uint32)
    return x[::2] | np.uint32(1), x[1::2]


def signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024, None] * a
        part += b
        np.minimum(out, part.min(0), out)
    return out


def _sets(data: np.ndarray, starts: np.ndarray, words: int) -> Iterator[np.ndarray]:
    begin, end, first = words_of(data, starts)
    hashes = word_hashes(data, begin, end)
    for r in range(len(starts) - 1):
        yield shingles(hashes[first[r] : first[r + 1]], words)


def _digest(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mixed(np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _named(how: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(how)
        salt = mixed(np.arange(how.bands, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            data, starts = texts_of(batch.column("text"))
            for i, j in runs(starts):
                sizes, names, values = [], [], []
                for s in _sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], how.words):
                    sizes.append(len(s))
                    names.append(_digest(s) if len(s) else None)
                    values.append(signature(s, a, b))
                x = np.array(values, np.uint32).reshape(j - i, how.bands, how.rows).astype(np.uint64)
                key = np.broadcast_to(salt, (j - i, how.bands)).copy()
                for r in range(how.rows):
                    key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + x[:, :, r])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * how.bands, how.bands), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("k").slice(i, j - i), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), bands], names=["doc_id", "k", "s", "n", "bands"])

    return run


def sets_of(docs: DataFrame, how: Join) -> DataFrame:
    """A row for each document: doc_id, a hash k of its text, the name s of its shingle set (null: none), its size n, its band keys."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text"))[1], "text").mapInArrow(_named(how), "doc_id long, k long, s long, n long, bands array<long>")


def candidate_groups(sets: DataFrame) -> DataFrame:
    """Sets (s, bands) that share a band key with another, directly or over others: node, label."""
    rows = sets.select("s", F.explode("bands").alias("key"))
    shared = durable(rows.groupBy("key").agg(F.min("s").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "low"))
    return components(rows.join(shared, "key").select(F.col("s").alias("a"), F.col("low").alias("b")))


def least_matches(how: Join) -> list[int]:
    """For each number of compared values, the least number of equal ones with which a pair goes on."""
    t, out = how.tenths / 10, []
    for n in range(how.step, how.bands * how.rows + 1, how.step):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= how.tolerance:
                break
            m += 1
        out.append(m)
    return out


def links(left: list[np.ndarray], right: list[np.ndarray] | None, how: Join, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets: between `left` and `right`, or inside `left` if `right` is None."""
    sets = left + (right or [])
    sig = np.array([signature(s, a, b) for s in sets])
    if right is None:
        x, y = np.triu_indices(len(left), 1)
    else:
        x, y = (z.reshape(-1) for z in np.indices((len(left), len(right))))
        y = y + len(left)
    size = np.array([len(s) for s in sets])
    close = 10 * np.minimum(size[x], size[y]) >= how.tenths * np.maximum(size[x], size[y])
    x, y = x[close], y[close]
    same = np.zeros(len(x), np.int32)
    for k, least in enumerate(least_matches(how)):
        part = sig[:, k * how.step : (k + 1) * how.step]
        for i in range(0, len(x), 1 << 16):
            same[i : i + (1 << 16)] += (part[x[i : i + (1 << 16)]] == part[y[i : i + (1 << 16)]]).sum(1, dtype=np.int32)
        on = same >= least
        x, y, same = x[on], y[on], same[on]
    if not len(x):
        return x, y
    used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    rows = np.repeat(np.arange(len(used)), size[used])
    _, column, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for c, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        dense = np.zeros((len(used), width), np.float32)
        dense[rows[i:j], column[i:j] - c * width] = 1
        both += dense @ dense.T
    m = both[back[: len(x)], back[len(x) :]].astype(np.int64)
    on = 10 * m >= how.tenths * (size[x] + size[y] - m)
    return x[on], y[on]


def _linked(how: Join):
    """Works on rows sorted by their block pair; holds the rows of one block pair."""

    def solve(rows: dict[int, tuple[int, int, np.ndarray]], cross: bool, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        names = sorted(rows)
        if cross:
            one = min(r[0] for r in rows.values())
            left, right = [s for s in names if rows[s][0] == one], [s for s in names if rows[s][0] != one]
            names = left + right
            x, y = links([rows[s][2] for s in left], [rows[s][2] for s in right], how, a, b) if right else (np.zeros(0, np.int64),) * 2
        else:
            x, y = links([rows[s][2] for s in names], None, how, a, b)
        n, weight = len(names), np.array([rows[s][1] for s in names])
        sets = np.bincount(np.concatenate([x, y]), minlength=n)
        docs = (np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)).astype(np.int64)
        root = np.arange(n)
        while True:  # the least linked name, over and over
            new = root.copy()
            np.minimum.at(new, x, root[y])
            np.minimum.at(new, y, root[x])
            new = new[new]
            if (new == root).all():
                break
            root = new
        for i in np.flatnonzero(sets):
            yield names[i], int(sets[i]), int(docs[i]), names[root[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(how)
        key, rows, out = None, {}, []
        schema = pa.schema([(c, pa.int64()) for c in ("s", "sets", "docs", "to")])
        for batch in batches:
            blob, starts = texts_of(batch.column("shingles"))
            cols = zip(*(batch.column(c).to_pylist() for c in ("c", "i", "j", "own", "s", "m")), strict=True)
            for r, (c, i, j, own, s, m) in enumerate(cols):
                if key != (c, i, j):
                    if len(rows) > 1:
                        out += solve(rows, key[1] != key[2], a, b)
                    key, rows = (c, i, j), {}
                wide = np.zeros(((starts[r + 1] - starts[r]) // BYTES, 8), np.uint8)
                wide[:, :BYTES] = blob[starts[r] : starts[r + 1]].reshape(-1, BYTES)
                rows[s] = (own, m, mixed(wide.view(np.uint64).reshape(-1)))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
                out = []
        if len(rows) > 1:
            out += solve(rows, key[1] != key[2], a, b)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)

    return run


def _with_shingles(how: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = texts_of(batch.column("text"))
            keep = [c for c in batch.schema.names if c != "text"]
            wanted = batch.column("s").to_pylist()
            for i, j in runs(starts):
                rows, blobs = [], []
                for r, s in enumerate(_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], how.words)):
                    if len(s) and _digest(s) == wanted[i + r]:
                        rows.append(i + r)
                        blobs.append(np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes())
                part = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(blobs, pa.binary())], names=[*keep, "shingles"])

    return run


def classes(docs: DataFrame, how: Join | None = None) -> DataFrame:
    """What `similar` gives, with the key of each row (d, k: its id, NO_ID for a null one, and a hash of its text) and whether
    it is its class's kept row: the one with the least key."""
    how = how or Join()
    named = durable(sets_of(docs, how).withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))))
    sets = named.where("s is not null").groupBy("s").agg(F.min(F.struct("d", "k")).alias("rep"), F.count(F.lit(1)).alias("m"), F.first("bands").alias("bands"))
    sets = durable(sets)
    groups = candidate_groups(sets)
    sizes = durable(groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("blocks")))
    todo = groups.join(sizes, "label").join(sets.select(F.col("s").alias("node"), "rep", "m"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    todo = durable(todo.select(F.col("node").alias("s"), F.col("rep.d").alias("d"), F.col("rep.k").alias("k"), "m", F.col("label").alias("c"), "blocks", own.alias("own")))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), row_key(F.col("doc_id"), F.col("text"))[1], "text")
    kinds = "s long, m long, c long, blocks int, own int"
    held = texts.join(todo, ["d", "k"]).select("s", "m", "c", "blocks", "own", "text").mapInArrow(_with_shingles(how), f"{kinds}, shingles binary")
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "s", "m", "shingles")
    found = dealt.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j").mapInArrow(_linked(how), "s long, sets long, docs long, to long")
    found = durable(found)
    labels = components(found.select(F.col("s").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("s").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    every = sets.select("s", "rep", "m").join(labels.withColumnRenamed("node", "s"), "s", "left").join(counts, "s", "left").select("s", "rep", "m", F.coalesce("label", "s").alias("label"), F.coalesce("sets", F.lit(0)).alias("sets"), F.coalesce("docs", F.lit(0)).alias("docs"))
    every = durable(every)
    first = durable(every.groupBy("label").agg(F.min("rep").alias("first")))
    known = durable(every.join(first, "label").select("s", "m", "sets", "docs", "first"))
    full = named.where("s is not null").select("doc_id", "d", "k", "s").join(known, "s")
    full = full.select("doc_id", "d", "k", F.nullif(F.col("first.d"), F.lit(NO_ID)).alias("class_id"), (F.col("docs") + F.col("m") - 1).alias("n_links"), F.col("sets").alias("n_set_links"), F.col("m").alias("n_copies"), (F.col("first") == F.struct("d", "k")).alias("kept"))
    one = F.lit(1).cast("long")
    empty = named.where("s is null").select("doc_id", "d", "k", F.col("doc_id").alias("class_id"), (one * 0).alias("n_links"), (one * 0).alias("n_set_links"), one.alias("n_copies"), F.lit(True).alias("kept"))
    return full.unionByName(empty)


def similar(docs: DataFrame, how: Join | None = None) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, class_id (the least doc_id of its near-duplicate class),
    n_links (other documents at or over the threshold, copies among them), n_set_links (other shingle sets), n_copies
    (documents with its own set)."""
    return classes(docs, how).select("doc_id", "class_id", "n_links", "n_set_links", "n_copies")


def deduplicated(docs: DataFrame, how: Join | None = None) -> DataFrame:
    """One row of `docs` for each class, that with the least id (null ids last) and then the least hash of its text.

    Rows go by id and text, so rows that share an id, or have none, are told apart. Of rows equal in both one stays."""
    gone = classes(docs, how).where("NOT kept").select("d", "k").distinct()
    d, k = fresh(docs, "d"), fresh(docs, "k")
    own = dict(zip((d, k), (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), row_key(F.col("doc_id"), F.col("text"))[1])))
    keyed = docs.withColumns(own)
    left = keyed.join(gone.withColumnsRenamed({"d": d, "k": k}), [d, k], "left_anti")
    if not keyed.groupBy(d, k).count().where("count > 1").limit(1).isEmpty():
        left = left.dropDuplicates([d, k])
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
