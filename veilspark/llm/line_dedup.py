"""Line dedup: lines that several documents hold stay in the first of them only.

A line's key is the line without white space at its ends, A to Z in lower case. Keys of at least `least` code points are told
apart by 128 bits of hash.

1. Tasks hash their lines and sum up each run of documents: (key, documents, first id, last id). Spark adds these up; keys
   whose first and last id differ are shared.
2. Shared keys are dealt over shards by hash. Each shard becomes, in one task, a minimal perfect hash with compact arrays:
   fingerprint, count, first holder. A shard has about `shard` keys, as keys are distinct.
3. Documents probe these arrays. Where all arrays together have at most `most` keys (counted before), tasks are sent all of
   them and documents are read once. Otherwise they are sent those of the keys that occur most, each over one in `most` / 2 of
   all shared lines, of which there are `most` / 2 at most; hashes of the other lines go to the shards, which say what is dropped.
   No key has more than that share of all lines there, so shards stay alike; texts aren't shuffled with them, only an answer
   for each document that loses a line.

Defined cases: a null or empty text has one empty line, and its kept text is empty. Rows that share an id are one document.
Rows without an id are documents of their own, after all others; they are numbered once, in a table in the shared folder.
Empty lines and short keys always stay. A text without a repeated line stays byte for byte. An empty table gives no row.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import SPACES, fresh, runs, scratch, texts_of, word_hashes, written
from veilspark.llm.perfect_hash import Table


@dataclass(frozen=True)
class Settings:
    #: Code points of the shortest key that is looked at.
    least: int = 10
    #: Shared keys in one shard.
    shard: int = 1 << 17
    #: Keys whose arrays are sent to all tasks (about 21 bytes each).
    most: int = 1 << 21


def lines_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the lines of some texts begin and end, and the n + 1 places among them where each text's lines begin."""
    feed = np.flatnonzero(data == 0x0A)
    n = len(starts) - 1
    own = np.searchsorted(feed, starts)  # line feeds before each text
    first = own + np.arange(n + 1)
    begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    begin[first[:-1]], end[first[1:] - 1] = starts[:-1], starts[1:]
    at = np.arange(len(feed)) + np.searchsorted(starts[1:], feed, side="right")  # the line that each feed ends
    end[at], begin[at + 1] = feed, feed + 1
    return begin, end, first


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def keys_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of some lines have a long enough key, and the two halves of these keys' hashes."""
    solid = np.flatnonzero(~_IS_SPACE[data])
    low, high = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    some = np.flatnonzero(high > low)
    a, b = solid[low[some]], solid[high[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[b] - points[a] >= least
    some, a, b = some[long], a[long], b[long]
    lower = _LOWER[data]
    return some, word_hashes(lower, a, b), word_hashes(lower ^ np.uint8(0x5A), a, b)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple]:
    """Runs of rows: batch, first row, bytes, lines' begin and end, texts' first lines, and keys: their line and hashes."""
    for batch in batches:
        data, starts = texts_of(batch.column("text"))
        for i, j in runs(starts):
            part, at = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
            begin, end, first = lines_of(part, at)
            yield batch, i, part, begin, end, first, *keys_of(part, begin, end, least)


def _counts(s: Settings) -> Callable:
    """Each run's keys: how many documents hold it there, the first and the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _, begin, _, first, line, one, two in _blocks(batches, s.least):
            d = batch.column("d").to_numpy()[i : i + len(first) - 1][np.repeat(np.arange(len(first) - 1), np.diff(first))[line]]
            order = np.lexsort((d, two, one))
            one, two, d = one[order], two[order], d[order]
            new = np.ones(len(d), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            other = new.copy()
            other[1:] |= d[1:] != d[:-1]
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(d)) - 1
            n = np.add.reduceat(other, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([_signed(one[at]), _signed(two[at]), pa.array(n), pa.array(d[at]), pa.array(d[last])], names=["one", "two", "n", "low", "high"])

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """d (a number for each document), doc_id, text. Rows without an id get numbers above all ids, once, in a table of their own."""
    named = docs.select(F.col("doc_id").cast("long").alias("d"), "doc_id", "text").where("doc_id IS NOT NULL")
    bare = docs.select("doc_id", "text").where("doc_id IS NULL")
    if bare.isEmpty():
        return named
    top = named.agg(F.coalesce(F.max("d"), F.lit(0)).alias("top")).first().top
    rows = bare.select((F.monotonically_increasing_id() + F.lit(top + 1)).alias("d"), "doc_id", "text")
    return named.unionByName(written(rows, f"{scratch(docs.sparkSession)}/bare"))


def shared_keys(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The keys that several documents hold: one and two (hash), n (how many hold it; rows that share an id may count each), low (the first)."""
    counts = docs.mapInArrow(_counts(s), "one long, two long, n long, low long, high long")
    rows = counts.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").drop("high")
    return written(rows, f"{scratch(docs.sparkSession)}/keys")


def indexed(keys: DataFrame, shards: int) -> DataFrame:
    """The keys by shard, each a row: shard, data (a perfect hash with its arrays)."""

    def build(own: pa.Table) -> pa.Table:
        one, two, n, low = (own.column(c).to_numpy() for c in ("one", "two", "n", "low"))
        return pa.table({"shard": own.column("shard")[:1], "data": pa.array([Table.of(one.view(np.uint64), two.view(np.uint64), n, low).bytes()], pa.binary())})

    return keys.withColumn("shard", F.pmod(F.xxhash64("one"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, data binary")


def _dropped(tables: list[Table], d: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether a line goes: its key is in one of the tables, with another holder."""
    out = np.zeros(len(d), bool)
    for t in tables:
        at = t.find(one, two)
        have = np.flatnonzero(at >= 0)
        out[have] = t.holder[at[have]] != d[have]
    return out


def _cut(data: list[bytes], s: Settings) -> Callable:
    """Texts without the lines that the sent tables drop, or whose hash is among the document's own (`gone`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Table.read(x) for x in data]
        for batch, i, part, begin, end, first, line, one, two in _blocks(batches, s.least):
            n = len(first) - 1
            owner = np.repeat(np.arange(n), np.diff(first))
            drop = np.zeros(len(begin), bool)
            drop[line] = _dropped(tables, batch.column("d").to_numpy()[i : i + n][owner[line]], one, two)
            if "gone" in batch.schema.names:
                for k in np.flatnonzero(batch.column("gone").slice(i, n).is_valid().to_numpy(zero_copy_only=False)):
                    own = np.flatnonzero(owner[line] == k)
                    drop[line[own]] |= np.isin(one[own].view(np.int64), batch.column("gone")[i + k].values.to_numpy())
            kept = []
            for k in range(n):
                a, b = first[k], first[k + 1]
                stay = np.flatnonzero(~drop[a:b]) + a
                kept.append(bytes(part[begin[a] : end[b - 1]]) if len(stay) == b - a else b"\n".join(bytes(part[begin[x] : end[x]]) for x in stay))
            lost = np.add.reduceat(drop, first[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(np.diff(first)), pa.array(lost), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def _probes(s: Settings) -> Callable:
    """Each document's keys, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _, _, _, first, line, one, two in _blocks(batches, s.least):
            n = len(first) - 1
            d = batch.column("d").to_numpy()[i : i + n][np.repeat(np.arange(n), np.diff(first))[line]]
            order = np.lexsort((two, one, d))
            one, two, d = one[order], two[order], d[order]
            new = np.ones(len(d), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (d[1:] != d[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(d[new]), _signed(one[new]), _signed(two[new])], names=["d", "one", "two"])

    return run


def _answers(probes: DataFrame, index: DataFrame, sent: list[bytes], shards: int) -> DataFrame:
    """What the shards say about keys that weren't sent to all tasks: d, gone (the first halves of dropped keys)."""

    def unsent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Table.read(x) for x in sent]
        for batch in batches:
            one, two = (batch.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
            known = np.zeros(len(one), bool)
            for t in tables:
                known |= t.find(one, two) >= 0
            yield batch.filter(pa.array(~known))

    def answer(own: pa.Table, table: pa.Table) -> pa.Table:
        if not own.num_rows or not table.num_rows:
            return pa.table({"d": pa.array([], pa.int64()), "one": pa.array([], pa.int64())})
        d, one, two = (own.column(c).to_numpy() for c in ("d", "one", "two"))
        drop = _dropped([Table.read(table.column("data")[0].as_py())], d, one.view(np.uint64), two.view(np.uint64))
        return pa.table({"d": d[drop], "one": one[drop]})

    rows = probes.mapInArrow(unsent, probes.schema).withColumn("shard", F.pmod(F.xxhash64("one"), F.lit(shards)).cast("int"))
    said = rows.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(answer, "d long, one long")
    return said.groupBy("d").agg(F.collect_set("one").alias("gone"))


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept (the text that stays)."""
    rows = numbered(docs)
    keys = shared_keys(rows, s)
    n, held = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_dropped long, kept string"
    often = F.col("n") > held // (s.most // 2)  # `most` / 2 keys at most, as all counts add up to `held`
    data = [r.data for r in indexed(keys if n <= s.most else keys.where(often), -(-min(n, s.most) // s.shard) or 1).collect()]  # 2^21 keys by default, 44 MB
    if n > s.most:
        lines = rows.agg(F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), F.lit(0))).first()[0]
        shards = max(-(-n // s.shard), lines // (4 * s.shard))  # about 4 * `shard` lines ask each
        gone = _answers(rows.mapInArrow(_probes(s), "d long, one long, two long"), indexed(keys.where(~often), shards), data, shards)
        own = fresh(rows, "own")
        rows = rows.join(gone.withColumnRenamed("d", own), rows.d == F.col(own), "left").drop(own)
    return rows.mapInArrow(_cut(data, s), shape)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
g AS (SELECT k, min(doc_id) AS low FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
r AS (SELECT k.doc_id, i, line, coalesce(low <> k.doc_id, false) AS gone FROM k LEFT JOIN g USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id
"""
