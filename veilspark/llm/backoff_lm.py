"""Stupid-backoff scores of all documents under n-gram counts of all other documents.

    S(w | h) = c(h w) / c(h)            if other documents hold h w
             = alpha * S(w | h without its first word)   otherwise, down to (c(w) or 1) / N

Counts are those of the whole corpus less the document's own; texts are whole and nothing is pruned.

Documents are dealt into batches of about `batch_bytes` of text. A batch is exploded to its distinct n-grams of all orders,
sorted by hash, so a frequent n-gram is held once a batch however often it occurs. The hashes are parted into ranges, each of the
n-grams of about `range_bytes` of text, and a batch's n-grams of one range are written as a piece: a row with the arrays of
hashes and counts, and the place of the first among the batch's n-grams. Spark groups the pieces by range; a range's n-grams are
summed over all batches, and each piece gets its n-grams' counts in the corpus. By its batch it meets the batch's texts, whose
n-grams are looked up and summed per document. A row an n-gram would cost the JVM several times the time of the counting itself.

Exploded n-grams are many times their text, so the table of pieces is partitioned into `slices`, runs of ranges that are counted
one by one, and the scoring is done in `groups` jobs over batches. Each job drops its shuffle files and its slice at its end.
These numbers don't depend on the input's size; the number of ranges is in proportion to it, so each range fits a task.

Defined cases: a null or empty text has no words, and score and mean null; repeated rows are documents of their own; a
null doc_id is kept; other columns are ignored. A single text longer than a batch is a batch with that text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import dropped, runs, scratch, texts_of, window_hashes, word_hashes, words_of, written


@dataclass(frozen=True)
class Backoff:
    order: int = 3
    alpha: float = 0.4
    batch_bytes: int = 8 << 20
    range_bytes: int = 2 << 20
    slices: int = 8
    groups: int = 3


#: A piece has at most so many n-grams, and pieces go to Spark in runs of about GRAMS.
PIECE, GRAMS = 1 << 12, 1 << 16
#: By this setting a task writes all slices at once, without a sort.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def grams_of(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The places where texts' words begin, and for each order the n-gram hashes at every word and whether they lie in one text."""
    begin, end, first = words_of(data, starts)
    words = word_hashes(data, begin, end)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    hashes, inside = [words], [np.ones(len(words), bool)]
    for n in range(2, order + 1):
        h = np.zeros(len(words), np.uint64)
        got = window_hashes(words, n)
        h[: len(got)] = got ^ np.uint64(n)
        hashes.append(h)
        inside.append(left >= n)
    return first, hashes, inside


def pieces_of(b: int, texts: list[str | None], how: Backoff, ranges: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch. The first one has the batch's number of words, the others 0."""
    first, hashes, inside = grams_of(*texts_of(pa.array(texts, pa.large_string())), how.order)
    keys, counts = np.unique(np.concatenate([h[i] for h, i in zip(hashes, inside, strict=True)]), return_counts=True)
    del hashes, inside
    # ranges ascend with the hashes, and slices with the ranges
    r = (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    new = np.concatenate(([True], r[1:] != r[:-1]))[: len(r)]
    new[::PIECE] = True
    begins = np.flatnonzero(new)
    r = r[begins]
    words = np.zeros(len(begins), np.int64)
    words[:1] = first[-1]
    off = np.append(begins, len(keys))
    lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), x) for x in (pa.array(keys.view(np.int64)), pa.array(counts, pa.int32()))]
    made = pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), b)), pa.array(begins), pa.array(r), *lists, pa.array(words), pa.array((r * how.slices // ranges).astype(np.int32))], names=["b", "at", "r", "grams", "n", "words", "s"])
    for i, j in runs(off, GRAMS):
        yield made.slice(i, j - i)


def totals_of(pieces: pa.Table) -> pa.Table:
    """For the pieces of one range from all batches: the batch, the place, and each n-gram's count in all of them."""
    grams, n = pieces["grams"].combine_chunks(), pieces["n"].combine_chunks()
    order, every = ordered(grams.flatten().to_numpy().view(np.uint64))
    begins = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))[: len(every)])
    sums = np.add.reduceat(n.flatten().to_numpy()[order].astype(np.int64), begins)
    totals = np.empty(len(order), np.int64)
    totals[order] = np.repeat(sums, np.diff(np.append(begins, len(order))))
    off = np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy())))
    return pa.table({"b": pieces["b"], "at": pieces["at"], "totals": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(totals))})


def _exploded(how: Backoff, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts = None, []
        for batch in batches:
            for b, text in zip(batch.column("b").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if b != now:
                    if texts:
                        yield from pieces_of(now, texts, how, ranges)
                    now, texts = b, []
                texts.append(text)
        if texts:
            yield from pieces_of(now, texts, how, ranges)

    return run


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit values, and the values in it.

    A value's upper bits and its place are sorted as one number, which costs a third of a stable sort of places; the few
    runs in which values of equal upper bits are out of order are sorted again."""
    bits = np.uint64(max(len(values) - 1, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = values & ~low
    both |= np.arange(len(values), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    out = values[order]
    upper = np.unique(both[:-1][out[1:] < out[:-1]] >> bits) << bits
    for a, b in zip(np.searchsorted(both, upper), np.searchsorted(both, upper | low, "right"), strict=True):
        again = np.argsort(out[a:b], kind="stable")
        order[a:b], out[a:b] = order[a:b][again], out[a:b][again]
    return order, out


def scores(first: np.ndarray, hashes: list[np.ndarray], inside: list[np.ndarray], totals: np.ndarray, n_words: int, how: Backoff) -> np.ndarray:
    """The summed log score of each text; totals: the corpus's counts of the texts' sorted n-grams. Empties `hashes`, to need
    less memory."""
    texts = len(first) - 1
    size = np.diff(first)
    row = np.repeat(np.arange(texts), size)
    if not len(row):
        return np.zeros(texts)
    every = np.concatenate([h[i] for h, i in zip(hashes, inside, strict=True)])
    # rows ascend within each order, so a stable sort puts the occurrences of an n-gram in one text side by side
    hashes.clear()
    order, every = ordered(every)
    text = np.concatenate([row[i].astype(np.int32) for i in inside])[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    key = np.cumsum(new, dtype=np.int32) - 1
    begins = np.flatnonzero(new | np.concatenate(([True], text[1:] != text[:-1])))
    own = np.diff(np.append(begins, len(every)))
    del every, text, new, begins
    rest = np.empty(len(order), np.int64)
    rest[order] = totals[key] - np.repeat(own, own)
    del order, key, totals, own
    others, at = [], 0
    for ok in inside:
        got = np.zeros(len(row), np.int64)
        n = np.count_nonzero(ok)
        got[ok] = rest[at : at + n]
        others.append(got)
        at += n
    value = np.log(np.maximum(others[0], 1) / np.maximum(n_words - size[row], 1))
    place = np.arange(len(row)) - first[:-1][row]
    for n in range(2, how.order + 1):
        # the n-gram that ends at a word begins n - 1 words before it
        w = np.flatnonzero(place >= n - 1)
        seen = others[n - 1][w - n + 1]
        past = others[n - 2][w - n + 1]
        hit = (seen > 0) & (past > 0)
        value[w] = np.where(hit, np.log(np.maximum(seen, 1) / np.maximum(past, 1)), np.log(how.alpha) + value[w])
    return np.bincount(row, value, texts)


def _scored(how: Backoff, n_words: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        first, hashes, inside = grams_of(*texts_of(pa.array(left["text"], pa.large_string())), how.order)
        n = np.diff(first)
        totals = np.concatenate([np.zeros(0, np.int64), *right.sort_values("at")["totals"]])
        s = np.where(n > 0, scores(first, hashes, inside, totals, n_words, how), np.nan)
        return pd.DataFrame({"doc_id": left["doc_id"].astype("Int64"), "n_words": n, "score": s, "mean": s / np.maximum(n, 1)})

    return run


def backoff_scores(docs: DataFrame, how: Backoff | None = None) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, n_words, score (the sum of the words' log scores), mean."""
    how = how or Backoff()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches = max(1, -(-n_bytes // how.batch_bytes))
    ranges = how.slices * max(1, -(-n_bytes // (how.slices * how.range_bytes)))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")), F.lit(batches)))
    spark, folder, answers = docs.sparkSession, scratch(docs.sparkSession), []
    texts = dealt.repartition("b").sortWithinPartitions("b", "doc_id", "text")
    exploded = texts.mapInArrow(_exploded(how, ranges), "b long, at long, r long, grams array<long>, n array<int>, words long, s int")
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(how.slices + 1))  # at this number a task begins to sort
    try:
        # hashes ascend, which the second version's delta encoding uses
        plain = {"parquet.enable.dictionary#grams.list.element": "false"}
        asked = written(exploded, f"{folder}/grams", by=("s",), **{"parquet.writer.version": "v2", "parquet.block.size": str(8 << 20)}, **plain)
    finally:
        spark.conf.set(_WRITERS, before)
    n_words = asked.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    for s in range(how.slices):
        counted = asked.where(F.col("s") == s).select("b", "at", "r", "grams", "n").groupBy("r").applyInArrow(totals_of, "b long, at long, totals array<long>")
        answers.append(written(counted, f"{folder}/answers-{s}"))
        dropped(spark, f"{folder}/grams/s={s}")
    every, parts = reduce(DataFrame.unionByName, answers), []
    for g in range(how.groups):
        own = F.pmod("b", F.lit(how.groups)) == g
        texts = dealt.where(own).groupBy("b")
        made = texts.cogroup(every.where(own).groupBy("b")).applyInPandas(_scored(how, n_words), "doc_id long, n_words long, score double, mean double")
        parts.append(written(made, f"{folder}/scores-{g}"))
    for s in range(how.slices):
        dropped(spark, f"{folder}/answers-{s}")
    return reduce(DataFrame.unionByName, parts)
