"""Packing: order-preserving dynamic programming over window cuts.

The tokens of a stream of documents (a partition, in its order) are cut into windows of at
most ``size`` tokens.  Cuts lie at document ends (free), sentence ends or, where a long
stretch has neither, at every STRIDE-th token; the last two cost a truncation penalty.  A
window costs its padding.  With P(j) the position of cut j,

    best(j) = penalty(j) + size - P(j) + min { best(i) + P(i) : P(j) - size <= P(i) < P(j) }

whose minimum slides along a monotone queue, so a stream costs time in proportion to its cuts.  A cut
is settled, and what lies before it given out, once the cheapest ways to all places of the last window go
through it: whatever follows goes on from one of them, so cuts do not depend on when they are settled.
What is held is the stretch behind the last settled cut, a few windows as a rule.
Windows need no padding when their length is a power of two; the end of a stream is cut into
such lengths when the penalties are less than its padding.

Defined results: null counts as empty, whose only token is the end token; rows are packed as
often as they occur; an empty input gives no rows; a null doc_id is packed and stays null, and
ids beside it are kept exactly; of equally cheap cuts the later predecessor is taken; other columns are ignored.
No row is dropped: every token lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .token_counts import BYTE_SIGNS, MARKS, load
from .wordbag import Remembered

SIZE, END_TOKEN = 4096, 2
SENTENCE_CUT, WORD_CUT, STRIDE, LONG_STRETCH = 8.0, 32.0, 64, 256
#: Tokens after which cuts are looked for that are settled; it has no effect on which they are.
FLUSH_TOKENS = 1_000_000
CACHE_LIMIT, LONG_PART = 500_000, 48
#: A word that ends a sentence; the flag that its last id bears until its place is read.
SENTENCE_END, ENDS_HERE = re.compile("[.!?][\"'\xbb\u201d\u2019)\\]]*\\Z"), 1 << 31
#: White space on which Python and the tokenizer's pattern may differ.
RARE_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Words with one undoubted normal form: ASCII and the accented letters of Latin-1; not those that may hold a special string.
PLAIN = re.compile("[!-;=-~\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]{1,64}")
#: Fixed value: the tokenizer's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids and sentence ends of texts under a tokenizer that drops white space between words.

    Words of Latin letters, whose small letters and composed form are beyond doubt, are cut by the
    tokenizer's own pattern and go to the library's merging model part by part; all others go
    through the whole library.  A sentence ends after a word that ends with a full stop, exclamation
    mark or question mark, closing quotes and brackets behind it included.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.words = Remembered(self.word, CACHE_LIMIT, LONG_PART)
        self.parts = Remembered(self.part, CACHE_LIMIT, LONG_PART)

    def part(self, letters: str) -> bytes:
        """Ids of one part that the pattern cut out, as little-endian unsigned 32-bit."""
        signs = letters if letters.isascii() else "".join([BYTE_SIGNS[b] for b in letters.encode()])
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word between white space; the last bears ENDS_HERE if a sentence ends there."""
        if PLAIN.fullmatch(word):
            low = word.lower()
            if low.isalpha():  # one match of the pattern
                ids = self.parts[low]
            elif low[:-1].isalpha() and low[-1] in MARKS:
                ids = self.parts[low[:-1]] + self.parts[low[-1]]
            else:
                ids = b"".join(map(self.parts.__getitem__, PATTERN.findall(low)))
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if ids and not word[-1].isalnum() and SENTENCE_END.search(word):
            ids = ids[:-4] + (int.from_bytes(ids[-4:], "little") | ENDS_HERE).to_bytes(4, "little")
        return ids

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """The text's ids as little-endian unsigned 32-bit, and the positions after its sentences."""
        words = text.split() if not RARE_SPACE.search(text) else [w for w in re.split(r"[ \t\n\r\f\v]+", text) if w]
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")
        return (ids & np.uint32(ENDS_HERE - 1)).tobytes(), np.flatnonzero(ids >> np.uint32(31)) + 1


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions of the permitted cuts, the start first, and their penalties; none is farther than size from the next."""
    place = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gap = np.diff(place)
    wide = np.flatnonzero(gap > min(LONG_STRETCH, size))
    more = [np.arange(place[i] + min(STRIDE, size), place[i + 1], min(STRIDE, size)) for i in wide]
    every = np.unique(np.concatenate([place, *more]))
    penalty = np.full(len(every), WORD_CUT)
    penalty[np.searchsorted(every, sentence_ends)] = SENTENCE_CUT
    penalty[np.searchsorted(every, doc_ends)] = 0
    penalty[0] = 0
    return every, penalty


class Cutter:
    """The cheapest cuts of a stream whose permitted places come in portions."""

    def __init__(self, size: int, start: int = 0):
        self.size = size
        # By place since the last settled cut: position, cost, cost and position together, and the place before.
        self.place, self.best, self.value, self.came, self.queue = [start], [0.0], [float(start)], [0], deque([0])

    def extend(self, place: list[int], penalty: list[float]) -> None:
        p, best, value, came, queue, size = self.place, self.best, self.value, self.came, self.queue, self.size
        for at, c in zip(place, penalty):
            low = at - size
            while p[queue[0]] < low:
                queue.popleft()
            i = queue[0]
            b = value[i] + size - at + c
            v = b + at
            while queue and value[queue[-1]] >= v:
                queue.pop()
            queue.append(len(p))
            p.append(at)
            came.append(i)
            best.append(b)
            value.append(v)

    def last_window(self) -> range:
        """Numbers of the places from which what follows, or the end, is reached."""
        return range(bisect_left(self.place, self.place[-1] - self.size), len(self.place))

    def way_to(self, k: int) -> list[int]:
        """Positions of the cuts up to place k, from the last settled one on."""
        cuts = [self.place[k]]
        while k:
            k = self.came[k]
            cuts.append(self.place[k])
        return cuts[::-1]

    def settled(self) -> list[int]:
        """Positions of the cuts that nothing can change any more, from the last settled one on; the last of them is kept as the new start."""
        seen = set(self.last_window())
        open_ = [-k for k in seen]
        heapq.heapify(open_)
        while len(open_) > 1:  # the latest place gives way to the one before it, until all ways have met
            k = self.came[-heapq.heappop(open_)]
            if k not in seen:
                seen.add(k)
                heapq.heappush(open_, -k)
        met = -open_[0]
        cuts = self.way_to(met)
        del self.place[:met], self.best[:met], self.value[:met], self.came[:met]
        self.came = [max(0, k - met) for k in self.came]
        self.queue = deque(k - met for k in self.queue if k >= met)
        return cuts

    def finished(self) -> list[int]:
        """Positions of the cuts from the last settled one to the end; the last window may be cut into powers of two instead of being padded."""
        p, size = self.place, self.size
        _, end = min((self.best[i] + tail_cost(p[-1] - p[i], size), i) for i in reversed(self.last_window()))
        return sorted({*self.way_to(end), *tail_cuts(p[end], p[-1], size), p[-1]})


def best_cuts(place: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Positions of the cheapest cuts from the first place to the last, both included."""
    cutter = Cutter(size, int(place[0]))
    cutter.extend(place[1:].tolist(), penalty[1:].tolist())
    return cutter.finished()


def tail_cost(length: int, size: int) -> float:
    return 0.0 if length == 0 else min(float(size - length), WORD_CUT * (length.bit_count() - 1))


def tail_cuts(begin: int, end: int, size: int) -> list[int]:
    """Cuts of the last window: at powers of two where that costs less than its padding."""
    length, cuts = end - begin, []
    if length and WORD_CUT * (length.bit_count() - 1) < size - length:
        for bit in range(length.bit_length() - 1, -1, -1):
            if length >> bit & 1:
                begin += 1 << bit
                cuts.append(begin)
    return cuts


class Stream:
    """Documents in order; gives packed pieces whenever cuts are settled."""

    def __init__(self, first_sequence: int, size: int):
        self.sequence, self.size, self.cutter = first_sequence, size, Cutter(size)
        # Documents with tokens behind the last settled cut: (doc_id, ids, begin in the stream); those not yet given to the cutter.
        self.docs, self.new, self.tokens, self.fed = [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes, ends: np.ndarray) -> None:
        """ends: the positions after the document's sentences."""
        self.docs.append((doc_id, ids, self.tokens))
        self.tokens += len(ids) // 4
        self.new.append((len(ids) // 4, ends))

    def waiting(self) -> int:
        """Tokens that the cutter has not seen."""
        return self.tokens - self.fed

    def pieces(self, final: bool) -> list[tuple]:
        """Rows of SCHEMA up to the last settled cut, or up to the end."""
        if self.new:
            ends = np.cumsum([n for n, _ in self.new])
            begins = ends - [n for n, _ in self.new]
            sentences = [e[(e > 0) & (e < n)] + b for (n, e), b in zip(self.new, begins.tolist())]
            place, penalty = cut_places(ends, np.concatenate([*sentences, [0]]).astype(np.int64), self.size)
            self.cutter.extend((place[1:] + self.fed).tolist(), penalty[1:].tolist())
            self.new, self.fed = [], self.tokens
        cuts = self.cutter.finished() if final else self.cutter.settled()
        rows, d, docs = [], 0, self.docs
        for low, high in zip(cuts, cuts[1:]):
            at = low
            while at < high:
                while docs[d][2] + len(docs[d][1]) // 4 <= at:
                    d += 1
                doc_id, ids, begin = docs[d]
                start, n = at - begin, len(ids) // 4
                length = min(high - begin, n) - start
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                rows.append((doc_id, start, length, crc, n, self.sequence, at - low))
                at += length
            self.sequence += 1
        while d < len(docs) and docs[d][2] + len(docs[d][1]) // 4 <= cuts[-1]:
            d += 1
        del docs[:d]
        return rows


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SCHEMA; ids never pass through floating point."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)


_encoders: dict[str, Encoder] = {}


def pack(docs: DataFrame, path: str, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of the packed sequences of docs; each partition is one stream, so nothing is shuffled.

    A sequence's id has its partition's number above bit 32, so ids are the same when a task is run again.
    """

    def packed(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        stream = Stream(TaskContext.get().partitionId() << 32, size)
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                tokens, ends = encoder.encode(text.as_py() or "")
                stream.add(i, tokens + END_TOKEN.to_bytes(4, "little"), ends)
                if stream.waiting() >= FLUSH_TOKENS:
                    yield batch_of(stream.pieces(False))
        if stream.tokens:
            yield batch_of(stream.pieces(True))

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(packed, SCHEMA)
