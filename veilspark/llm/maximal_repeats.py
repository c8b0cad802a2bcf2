"""Exact removal of long repeats by an enhanced suffix array, spread over tasks by winnowed anchors.

Which bytes are covered by a string of `length` bytes that starts elsewhere too?

1. Anchors. In each window of `length` bytes the `piece`-byte piece with the least hash is its anchor (the first one of
   equals). Equal windows have equal anchors at equal places, so windows need only be compared under the same anchor.
   A run of windows with one anchor is a context: its bytes, and where its windows begin.
2. Anchors whose hash occurs once are done. Where all contexts of an anchor are equal, each is a repeat as a whole.
   Equal contexts elsewhere are counted, and one of each kind goes on. This is done by aggregates and joins on
   plain tables, whose hot keys Spark combines early or splits; a text copied many times costs few rows afterwards.
3. Contexts of an anchor that occurs at most `most` times are sorted in one task: an enhanced suffix array over their
   window starts by prefix doubling, the common prefixes of neighbours, and a stack scan that yields the interval tree.
   An interval of at least `length` bytes whose occurrences have different bytes to the left (or a context's rim) is a
   maximal repeat, and comes with all its occurrences.
4. An anchor that occurs more often is split by content: its windows are grouped by their distance from the anchor, in
   ever smaller blocks, at last alone, keyed by the bytes that all windows of a block share. So no task holds a hot anchor.

Texts are UTF-8 bytes and strings are judged on the input. Defined cases: a null text is empty; texts shorter than
`length` have no windows; repeated rows (same doc_id and text) each count as an occurrence and get the same result; a
null doc_id is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import durable, row_key, runs, texts_of, window_hashes

_SEGMENT = 1 << 20
_LOW = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    piece: int = 64
    most: int = 400
    blocks: tuple[int, ...] = (24, 5, 1)  # falling, down to single windows


def anchors(data: np.ndarray, starts: np.ndarray, how: Repeats) -> tuple[np.ndarray, ...]:
    """Contexts of some texts, at most a few million bytes: text number, first window start in it, number of windows,
    the anchor's distance from the first start, the anchor's hash."""
    pieces = window_hashes(data, how.piece)
    width = how.length - how.piece + 1
    n = len(data) - how.length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    v = (pieces & ~_LOW) | np.arange(len(pieces), dtype=np.uint64)
    have, least = 1, v
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[width - have : width - have + n])
    at = (least & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    good = np.arange(n) + how.length <= starts[row + 1]
    s = np.flatnonzero(good)
    if not len(s):
        return (np.zeros(0, np.int64),) * 5
    new = np.concatenate([[True], (at[s][1:] != at[s][:-1]) | (row[s][1:] != row[s][:-1])])
    first = s[new]
    count = np.diff(np.append(np.flatnonzero(new), len(s)))
    return row[first], first - starts[row[first]], count, at[first] - first, pieces[at[first]]


def _contexts(how: Repeats):
    schema = pa.schema([(c, pa.int64()) for c in ("a", "ctx", "d", "k", "lo", "cnt", "off")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = texts_of(batch.column("text"))
            d, k = batch.column("d").to_numpy(), batch.column("k").to_numpy()
            for i, j in runs(starts, _SEGMENT):
                # a longer text goes in segments of window starts
                for low in range(int(starts[i]), max(int(starts[i]) + 1, int(starts[j]) if j == i + 1 else int(starts[i]) + 1), _SEGMENT):
                    high = min(int(starts[j]), low + _SEGMENT + how.length - 1) if j == i + 1 else int(starts[j])
                    part = data[low:high]
                    own = np.array([0, high - low]) if j == i + 1 else starts[i : j + 1] - low
                    row, lo, cnt, off, key = anchors(part, own, how)
                    raw = part.tobytes()
                    begin = own[row] + lo
                    ctx = np.array([xxhash.xxh3_64_intdigest(raw[b : b + c]) for b, c in zip(begin.tolist(), (cnt + how.length - 1).tolist())], np.uint64)
                    shift = low - int(starts[i]) if j == i + 1 else 0
                    cols = (key.view(np.int64) if len(key) else key, ctx.view(np.int64), d[i + row], k[i + row], lo + shift, cnt, off)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=schema)

    return run


def _with_bytes(how: Repeats):
    """The bytes of each wanted context of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = texts_of(batch.column("text"))
            out, blobs = [], []
            for r, (d, k, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d", "k", "wanted")), strict=True)):
                for w in wanted:
                    a = int(starts[r]) + w["lo"]
                    blobs.append(data[a : a + w["cnt"] + how.length - 1].tobytes())
                    out.append((w["a"], w["n"], w["many"], d, k, w["lo"], w["cnt"], w["off"]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)), pa.array(blobs, pa.binary())], names=["a", "n", "many", "d", "k", "lo", "cnt", "off", "x"])

    return run


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """`starts` sorted by the bytes that follow, and the common prefix of each with the one before, up to `length`.

    Prefix doubling: ranks of 8 bytes, then 16, and so on, each from two ranks of the length before."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    n, m = len(data), len(padded) - 7
    word = np.zeros(m, np.uint64)
    for b in range(8):
        word = (word << np.uint64(8)) | padded[b : b + m]
    ranks = [(8, np.unique(word, return_inverse=True)[1].astype(np.int64))]
    while ranks[-1][0] * 2 <= length:
        size, r = ranks[-1]
        q = r[: len(r) - size] * np.int64(len(r) + 1) + r[size:]
        ranks.append((size * 2, np.unique(q, return_inverse=True)[1].astype(np.int64)))
    size, r = ranks[-1]
    key = r[starts] * np.int64(len(r) + 1) + r[starts + length - size]
    order = np.argsort(key, kind="stable")
    sa = starts[order]
    lcp = np.zeros(len(sa), np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    got = np.zeros(len(a), np.int64)
    for size, r in reversed(ranks):
        for _ in range(2 if size == ranks[-1][0] else 1):
            ok = got + size <= length
            same = ok & (r[np.minimum(a + got, len(r) - 1)] == r[np.minimum(b + got, len(r) - 1)])
            got += np.where(same, size, 0)
    same = key[order][1:] == key[order][:-1]
    lcp[1:] = np.where(same, length, np.minimum(got, length - 1))
    return sa, lcp


def maximal_repeats(data: np.ndarray, sa: np.ndarray, lcp: np.ndarray, rims: np.ndarray, spot: np.ndarray, many: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each maximal repeat of at least `length` bytes: its length and all its occurrences.

    A stack scan of the common prefixes gives the intervals of the prefix tree; one is maximal if its occurrences differ
    in the byte before, or one of them stands at a rim. Prefixes are known up to `length` only; so the interval is also
    taken where the window before it has more occurrences, some of which don't go on.
    """
    stack: list[tuple[int, int]] = []  # (common prefix, first place in sa)
    values = lcp.tolist()
    for i in range(1, len(values) + 1):
        now = values[i] if i < len(values) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            size, first = stack.pop()
            if size >= length:
                own = sa[first:i]
                left = data[np.maximum(own - 1, 0)]
                before = spot[np.maximum(own - 1, 0)]
                if rims[own].any() or (left != left[0]).any() or many[before[0]] != len(own):
                    yield size, own
        if now >= length and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeats_among(contexts: list[bytes], counts: list[int], how: Repeats) -> list[tuple[int, int, int]]:
    """(context, start, end) of what is repeated among contexts, each given by its bytes and its number of window starts."""
    size = np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    count = np.array(counts)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    owner = np.repeat(np.arange(len(contexts)), count)
    hashes = window_hashes(data, how.length)[starts]
    order = np.sort(hashes)
    used = np.unique(owner[np.isin(hashes, np.unique(order[1:][order[1:] == order[:-1]]))])  # contexts without any twin can't hold a repeat
    if not len(used):
        return []
    keep = np.isin(owner, used)
    starts, owner = starts[keep], owner[keep]
    rims = np.zeros(len(data) + 1, bool)
    rims[begin] = True
    sa, lcp = suffix_array(data, starts, how.length)
    of = np.zeros(len(data), np.int64)
    of[starts] = owner
    return [(int(of[p]), int(p - begin[of[p]]), int(p - begin[of[p]]) + size) for size, own in _covering(data, sa, lcp, rims, how.length) for p in own.tolist()]


def _covering(data: np.ndarray, sa: np.ndarray, lcp: np.ndarray, rims: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """The maximal repeats, each lengthened to the right as far as all its occurrences' windows agree.

    Common prefixes are known up to `length`; a longer repeat is found at its first window, whose occurrences differ to
    the left, and again at the windows after it. Those have equal bytes to the left, so they are merged: what follows a
    maximal interval in step with it is its continuation."""
    spot = np.full(len(data) + 2, -1, np.int64)  # the interval that a window start is in
    group = np.cumsum(lcp < length)
    many = np.bincount(group, minlength=group[-1] + 1 if len(group) else 1)
    spot[sa] = np.where(many[group] > 1, group, -1)
    for size, own in maximal_repeats(data, sa, lcp, rims, spot, many, length):
        more, n = 0, len(own)
        here = own
        while True:
            here = here + 1
            g = spot[here]
            # the same occurrences go on, and nothing else joins them
            if g[0] < 0 or (g != g[0]).any() or many[g[0]] != n or rims[here].any():
                break
            more += 1
        yield size + more, own


def _sorted_contexts(how: Repeats):
    """Reads contexts sorted by anchor; solves some thousand whole anchors' contexts at a time."""
    schema = pa.schema([(c, pa.int64()) for c in ("d", "k", "s", "e")])

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        got = repeats_among([r[5] for r in rows], [r[4] for r in rows], how)
        out = [(rows[c][1], rows[c][2], rows[c][3] + s, rows[c][3] + e) for c, s, e in got]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "d", "k", "lo", "cnt", "x")), strict=True):
                if len(rows) >= 3000 and row[0] != rows[-1][0]:
                    yield from solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from solve(rows)

    return run


def _blocks(how: Repeats, size: int):
    """Splits contexts into the runs of windows that lie in one block of distances from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, d, k, lo, cnt, off, x in zip(*(batch.column(c).to_pylist() for c in ("a", "d", "k", "lo", "cnt", "off", "x")), strict=True):
                i = 0
                while i < cnt:
                    block = (off - i) // size
                    j = min(cnt, off - block * size + 1)  # windows i to j - 1
                    part = x[i : j + how.length - 1]
                    near = off - i - block * size  # the core begins so far into the part
                    core = part[near : near + how.length - size + 1]
                    key = xxhash.xxh3_64_intdigest(core, (a ^ block * 0x9E3779B97F4A7C15) & (2**64 - 1))
                    ctx = xxhash.xxh3_64_intdigest(part, near)
                    out.append((key - (key >> 63 << 64), ctx - (ctx >> 63 << 64), d, k, lo + i, j - i, off - i, part))
                    i = j
            if out:
                kinds = (*[pa.int64()] * 7, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=["a", "ctx", "d", "k", "lo", "cnt", "off", "x"])

    return run


def _spans(rows: DataFrame, how: Repeats) -> DataFrame:
    return rows.select("d", "k", F.col("lo").alias("s"), (F.col("lo") + F.col("cnt") + how.length - 1).alias("e"))


_ROW = "d long, k long, lo long, cnt long, off long"


def _solve(rows: DataFrame, texts: DataFrame | None, how: Repeats, sizes: list[int]) -> list[DataFrame]:
    """The repeated spans of contexts `rows` (a, ctx, d, k, lo, cnt, off, and x unless `texts` gives the bytes)."""
    shared = durable(rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).where("n > 1").select("a", "n", (F.col("c1") == F.col("c2")).alias("alike")))
    met = durable(rows.join(shared, "a"))
    out = [_spans(met.where("alike"), how)]
    mixed = met.where("NOT alike")
    own = ["d", "k", "lo", "cnt", "off", *(["x"] if texts is None else [])]
    kinds = durable(mixed.groupBy("a", "ctx").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.first(F.struct(*own)).alias("one")))
    out.append(_spans(mixed.join(kinds.where("c > 1").select("a", "ctx"), ["a", "ctx"]), how))
    rest = kinds.select("a", "n", (F.col("c") > 1).alias("many"), "one.*")
    if texts is not None:
        wanted = rest.groupBy("d", "k").agg(F.collect_list(F.struct("a", "n", "many", "lo", "cnt", "off")).alias("wanted"))
        rest = durable(texts.join(wanted, ["d", "k"]).mapInArrow(_with_bytes(how), f"a long, n long, many boolean, {_ROW}, x binary"))
    few = rest.where(F.col("n") <= how.most).select("a", "d", "k", "lo", "cnt", "x")
    out.append(few.repartition("a").sortWithinPartitions("a").mapInArrow(_sorted_contexts(how), "d long, k long, s long, e long"))
    hot = rest.where(F.col("n") > how.most)
    if sizes and not hot.isEmpty():
        split = hot.select("a", "d", "k", "lo", "cnt", "off", "x").mapInArrow(_blocks(how, sizes[0]), f"a long, ctx long, {_ROW}, x binary")
        out += _solve(split, None, how, sizes[1:])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = texts_of(batch.column("text"))
        out = []
        for r, spans in enumerate(batch.column("spans").to_pylist()):
            raw = data[starts[r] : starts[r + 1]].tobytes()
            kept, last, removed, n = [], 0, 0, 0
            reach = -1
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if s > reach:
                    n += 1
                if s > last:
                    kept.append(raw[last:s])
                removed += max(0, e - max(s, last))
                last = max(last, e)
                reach = max(reach, e)
            kept.append(raw[last:])
            out.append((len(raw), removed, n, hashlib.sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
        cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, how: Repeats | None = None) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    how = how or Repeats()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    long = keyed.where(F.octet_length("text") >= how.length).select("d", "k", "text")
    rows = long.mapInArrow(_contexts(how), f"a long, ctx long, {_ROW}")
    found = _solve(rows, long, how, list(how.blocks))
    spans = found[0]
    for other in found[1:]:
        spans = spans.unionByName(other)
    spans = spans.groupBy("d", "k").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return keyed.join(spans, ["d", "k"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
