"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes: each step shifts it left by one and adds the byte's gear value, so its 32 bits
depend on the last 32 bytes only. A chunk ends where the hash's top bits are all zero, so an insertion moves the ends
near it and no others. Chunks go by a 128-bit digest. The document with the least id keeps a chunk; elsewhere, and where
it comes again in the same document, it is a repeat. Runs of repeats of at least `least` bytes are removed.

Chunks are aggregated by digest before anything is joined, so a passage that a third of all documents hold is one row
per task there. Where the first holders are joined back, Spark splits such a key's rows. A document's repeats are at
most its chunks.

Defined cases: a null text stays null, and it and an empty text have no chunks; a null doc_id comes after all
others, by its text's hash; rows with the same doc_id don't count as each other's repeats; long texts are hashed in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import durable, fresh, mixed, texts_of


@dataclass(frozen=True)
class Chunking:
    bits: int = 5
    shortest: int = 24
    longest: int = 1024
    least: int = 100  # bytes of a removed run


_GEAR = (mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x67656172)) >> np.uint64(32)).astype(np.uint32)
_SEGMENT = 1 << 21


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, of it and the 31 bytes before it."""
    h = _GEAR[data]
    for size in (1, 2, 4, 8, 16):
        h[size:] = h[size:] + (h[:-size] << np.uint32(size)) if len(h) > size else h[size:]
    return h


def chunks(data: np.ndarray, how: Chunking) -> list[int]:
    """Where the chunks of a text end."""
    n, found = len(data), []
    limit = np.uint32(1 << (32 - how.bits))
    for i in range(0, n, _SEGMENT):
        back = min(i, 31)
        h = gear(data[i - back : i + _SEGMENT])[back:]
        found.append(np.flatnonzero(h < limit) + i + 1)
    out, last = [], 0
    for e in np.concatenate(found).tolist() if found else ():
        if e - last < how.shortest:
            continue
        while e - last > how.longest:
            last += how.longest
            out.append(last)
        if e - last >= how.shortest:
            out.append(e)
            last = e
    while n - last > how.longest:
        last += how.longest
        out.append(last)
    if last < n:
        out.append(n)
    return out


def order_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(2**62) + F.pmod(F.xxhash64(text), F.lit(2**61)))


def _rows(how: Chunking):
    schema = pa.schema([(c, pa.int64()) for c in ("d", "k", "p", "h1", "h2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = texts_of(batch.column("text"))
            d, k = batch.column("d").to_numpy(), batch.column("k").to_numpy()
            rows, sizes, places, digests = [], [], [], []

            def made() -> pa.RecordBatch:
                at = np.repeat(np.array(rows, np.int64), sizes)
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[at], k[at], np.array(places, np.int64), h[:, 0].copy(), h[:, 1].copy())], schema=schema)

            for r in range(len(starts) - 1):
                own = data[starts[r] : starts[r + 1]]
                ends = chunks(own, how)
                raw = own.tobytes()
                first = [0, *ends[:-1]]
                seen = dict(zip([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first, ends)][::-1], first[::-1]))
                rows.append(r)
                sizes.append(len(seen))
                places += seen.values()
                digests += seen.keys()
                if len(places) > 50_000:
                    yield made()
                    rows, sizes, places, digests = [], [], [], []
            if places:
                yield made()

    return run


def _removed(how: Chunking, own: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = texts_of(batch.column("text"))
            given = batch.column("text").is_valid().to_pylist()
            keep = [c for c in batch.schema.names if c not in ("text", own)]
            out = []
            for r, repeats in enumerate(batch.column(own).to_pylist()):
                raw = data[starts[r] : starts[r + 1]].tobytes()
                ends = chunks(data[starts[r] : starts[r + 1]], how)
                elsewhere, seen, spans, n_repeats, run_from = set(repeats or ()), set(), [], 0, None
                first = [0, *ends[:-1]]
                # places stand for a chunk's first occurrence here; later ones are found by their bytes
                bad = {raw[a:b] for a, b in zip(first, ends) if a in elsewhere}
                for a, b in zip(first, ends):
                    chunk = raw[a:b]
                    again = chunk in seen or chunk in bad
                    seen.add(chunk)
                    n_repeats += again
                    if again and run_from is None:
                        run_from = a
                    if not again and run_from is not None:
                        spans.append((run_from, a))
                        run_from = None
                if run_from is not None:
                    spans.append((run_from, len(raw)))
                kept, last, n_removed, n_spans = [], 0, 0, 0
                for a, b in spans:
                    if b - a < how.least:
                        continue
                    while a < b and raw[a] & 0xC0 == 0x80:  # cuts don't split a character
                        a += 1
                    while b < len(raw) and a < b and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(raw[last:a])
                    last, n_removed, n_spans = b, n_removed + b - a, n_spans + (b > a)
                kept = b"".join([*kept, raw[last:]])
                out.append((kept.decode() if given[r] else None, len(raw), len(ends), n_repeats, n_removed, n_spans, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            cols = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=[*keep, "text", "n_bytes", "n_chunks", "n_repeats", "n_removed", "n_spans", "kept_sha256"])

    return run


def deduplicated(docs: DataFrame, how: Chunking | None = None) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with repeats cut out of text, and n_bytes, n_chunks, n_repeats
    (chunks), n_removed (bytes), n_spans and kept_sha256; such columns of `docs` are replaced."""
    how = how or Chunking()
    docs = docs.drop("n_bytes", "n_chunks", "n_repeats", "n_removed", "n_spans", "kept_sha256")
    keys = [order_key(F.col("doc_id"), F.col("text")).alias("d"), F.xxhash64(F.col("text")).alias("k")]
    rows = docs.where(F.col("text") != "").select(*keys, "text").mapInArrow(_rows(how), "d long, k long, p long, h1 long, h2 long")
    shared = durable(rows.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last").drop("last"))
    d, k, d0, k0, own = (fresh(docs, c) for c in ("d", "k", "d0", "k0", "repeats"))
    repeats = rows.join(shared, ["h1", "h2"]).where("d <> first").groupBy(F.col("d").alias(d), F.col("k").alias(k)).agg(F.collect_set("p").alias(own))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    joined = docs.withColumns({d0: keys[0], k0: keys[1]}).join(repeats, (F.col(d0) == F.col(d)) & (F.col(k0) == F.col(k)), "left")
    made = ", ".join([*names, "text string, n_bytes long, n_chunks long, n_repeats long, n_removed long, n_spans long, kept_sha256 string"])
    return joined.select(*(f"`{f.name}`" for f in docs.schema), own).mapInArrow(_removed(how, own), made)
