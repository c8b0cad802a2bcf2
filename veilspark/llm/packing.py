"""Order-preserving packing of tokenised documents into fixed windows, cut by dynamic programming.

The documents of a partition form one stream of ids, each document followed by a separator id. Windows are cut from the
stream in order. A cut costs nothing at a document's end, a little at a sentence's end, more elsewhere (there is a
possible cut every `stride` ids at least); a window costs the padding it needs. The cheapest chain of cuts

    cost[j] = penalty[j] + min over i with place[j] - place[i] <= window of cost[i] + window - (place[j] - place[i])

is found in linear time: cost[i] + place[i] is kept in a queue whose values rise, so that the minimum over the sliding
range stands at its head. The stream is solved in stretches of `stretch` windows; all but the last few cuts of a
stretch are final, and the next one starts there. A partition's last window, if not full, is split into powers of two,
which need no padding.

Nothing is shuffled: a task packs the partition it reads, in order, and holds one stretch of ids. sequence_id holds the
partition's number in its upper bits, so a task that runs again after a lost executor makes the same rows.

Defined cases: a null or empty text is one separator id; repeated rows are packed one after the other; any other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import runs, texts_of, word_hashes, words_of

#: Texts of these characters only are split here; others go through the tokenizer as a whole. Letters whose lower case is
#: more than one character or lies beyond U+024F are among the others.
_SIMPLE = "".join(re.escape(c) for c in map(chr, range(0xA1, 0x250)) if len(c.lower()) == 1 and c.lower() <= "\u024f")
_PLAIN = re.compile(f"[\t\n\r -~{_SIMPLE}]*")
_LETTER = "a-zªµºß-öø-ɏ"
_DIGIT = "0-9²³¹¼-¾"
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_DIGIT}]|[^\t\n\r {_LETTER}{_DIGIT}]+")
#: Where a sentence ends in texts that go through the tokenizer as a whole.
_END = re.compile(r"[.!?…؟।]+[”’»\"')\]]*(?=\s|$)|[。！？｡]+[”’」』）】]*")
#: The letters by which byte-level tokenizers write bytes: printable ones stand for themselves, others follow U+0100.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _KEPT]
_BYTE_LETTERS = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(_OTHER)}


@dataclass(frozen=True)
class Packing:
    window: int = 2048
    separator: int = 1
    sentence_penalty: float = 3.0
    inside_penalty: float = 8.0
    stride: int = 32
    stretch: int = 48


class Encoder:
    """Token ids of texts. Each distinct word (what white space parts) is encoded once and then found by its hash.

    The tokenizer lowers the case, drops white space and treats every piece (letters, a digit, a run of signs) on its own,
    so a word's ids don't depend on what stands around it.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.reset()

    def reset(self) -> None:
        self.pieces: dict[str, list[int]] = {}
        self.hashes = np.zeros(0, np.uint64)  # of the known words, sorted
        self.place = np.zeros(0, np.int64)  # of their ids
        self.size = np.zeros(0, np.int64)
        self.ends = np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            got = self.pieces[piece] = [t.id for t in self.tokenizer.model.tokenize("".join(_BYTE_LETTERS[b] for b in piece.encode()))]
        return got

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(words) > self.most:
            self.reset()
        ids: list[int] = []
        size = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            before = len(ids)
            for p in _PIECE.findall(w.lower()):
                ids += self._piece(p)
            size[i] = len(ids) - before
        place = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.place, self.size, self.ends = (np.concatenate(x)[order] for x in ((self.place, place), (self.size, size), (self.ends, np.array([w[-1] in ".!?" for w in words], bool))))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text.encode(), np.uint8)
        return next(self.encode_all(data, np.array([0, len(data)])))

    def encode_all(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and how many ids lead up to each sentence's end."""
        whole = data.tobytes().decode()
        if not _PLAIN.fullmatch(whole) or "<|" in whole:
            if len(starts) > 2:
                for i in range(len(starts) - 1):
                    yield from self.encode_all(data[starts[i] : starts[i + 1]], np.array([0, starts[i + 1] - starts[i]]))
            else:
                got = self.tokenizer.encode(whole, add_special_tokens=False)
                upto = np.array([e for _, e in got.offsets], np.int64)
                marks = np.array([m.end() for m in _END.finditer(whole)], np.int64)
                at = np.searchsorted(upto, marks, side="right")
                # a mark inside a token is no place for a cut
                yield np.array(got.ids, np.uint32), at[(at > 0) & (upto[at - 1] == marks)] if len(upto) else at
            return
        begin, end, first = words_of(data, starts)
        unique, one, back = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            known = len(self.hashes)
            if known + len(new) > self.most:
                self.reset()
                new = np.arange(len(unique))
            raw = data.tobytes()
            self._learn(unique[new], [raw[b:e].decode() for b, e in zip(begin[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, unique)
        at = at[back]
        size = self.size[at]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(self.place[at] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        ends = self.ends[at]
        edge = np.concatenate([[0], stop])[first]
        for i in range(len(starts) - 1):
            own = slice(first[i], first[i + 1])
            yield ids[edge[i] : edge[i + 1]], stop[own][ends[own]] - edge[i]


def cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indices into `places` (rising, from 0, no two neighbours over `window` apart) of the cheapest chain of cuts from the first to the last.

    The last window's padding isn't charged: the stream goes on there, or the rest is split into powers of two.
    """
    place, penalty = places.tolist(), penalties.tolist()
    n = len(place)
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(place[0], 0)])
    for j in range(1, n):
        low = place[j] - window
        while place[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        cost[j] = value + window - place[j] + penalty[j]
        back[j] = i
        key = cost[j] + place[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    low = place[-1] - window
    back[-1] = min((i for i in range(bisect_left(place, low), n - 1)), key=cost.__getitem__)
    chain = [n - 1]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return chain[::-1]


def candidates(sizes: list[int], ends: list[np.ndarray], begin: int, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream of documents may be cut, from `begin` ids into it, and what a cut costs there."""
    total = sum(sizes)
    penalty = np.full(total - begin + 1, np.inf)
    penalty[:: how.stride] = how.inside_penalty
    base = 0
    for size, own in zip(sizes, ends, strict=True):
        own = own + base - begin
        penalty[own[own > 0]] = how.sentence_penalty
        base += size
        if base > begin:
            penalty[base - begin] = 0
    penalty[-1] = 0
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


class _Stream:
    """The documents that aren't wholly packed yet, and the windows made of them."""

    def __init__(self, how: Packing, first_id: int) -> None:
        self.how, self.sequence = how, first_id
        self.docs: list[tuple[object, np.ndarray, np.ndarray]] = []
        self.begin = 0  # ids of the first document that are packed
        self.size = 0

    def add(self, doc_id: object, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_id, ids, ends))
        self.size += len(ids)

    def pack(self, last: bool) -> Iterator[tuple]:
        how = self.how
        if self.size - self.begin == 0:
            return
        at, penalty = candidates([len(x[1]) for x in self.docs], [x[2] for x in self.docs], self.begin, how)
        places = at[cuts(at, penalty, how.window)]
        if not last:
            places = places[: max(2, len(places) - 4)]
        else:
            rest, tail = int(places[-1] - places[-2]), [int(places[-2])]
            while rest & (rest - 1):
                tail.append(tail[-1] + (1 << (rest.bit_length() - 1)))
                rest -= tail[-1] - tail[-2]
            places = np.concatenate([places[:-2], tail, places[-1:]])
        yield from self._pieces((places + self.begin).tolist())

    def _pieces(self, places: list[int]) -> Iterator[tuple]:
        done, base = 0, 0  # of self.docs
        for low, high in zip(places, places[1:]):
            offset = 0
            while offset < high - low:
                doc_id, ids, _ = self.docs[done]
                start = low + offset - base
                take = min(len(ids) - start, high - low - offset)
                yield doc_id, start, ids[start : start + take], len(ids), self.sequence, offset
                offset += take
                if start + take == len(ids):
                    base += len(ids)
                    done += 1
            self.sequence += 1
        self.docs = self.docs[done:]
        self.size -= base
        self.begin = places[-1] - base


def _packer(path: str, how: Packing, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        stream = _Stream(how, TaskContext.get().partitionId() << 40)

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            got = list(stream.pack(last))
            if got:
                doc_id, start, ids, tokens, sequence, offset = zip(*got)
                cols = [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(tokens, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            data, starts = texts_of(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j in runs(starts):
                part, own = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
                for doc_id, (ids, ends) in zip(doc_ids[i:j], encoder.encode_all(part, own), strict=True):
                    stream.add(doc_id, np.append(ids, np.uint32(how.separator)), ends)
                    if stream.size - stream.begin > how.stretch * how.window:
                        yield from rows(False)
        yield from rows(True)

    return run


def pack(docs: DataFrame, tokenizer: str, how: Packing | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a window: doc_id, start (ids of the document before it), length, ids_crc32
    (of its ids as unsigned little-endian 32-bit numbers), doc_tokens (with the separator), sequence_id, offset (in its
    window), and the ids if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(tokenizer, how or Packing(), with_ids), schema)
