"""Simple-8b: lists of unsigned 32-bit ids in 64-bit words, in blocks that are decoded each for itself.

The upper four bits of a word are its selector.  Selectors 0 to 11 say how many ids of how many bits
fill the lower 60 bits, the first id in the lowest; RUN says that the lower 32 bits hold one id and the
28 above how often it is repeated; the others are not used.  The largest value of a width is kept for
escapes: an id of ESCAPED or more puts it in its place and stands itself in a list behind the words.
A word takes as many ids as fit, so a block costs time in proportion to its ids.

A segment is the bytes of a list of ids:

    magic "S8B1", crc32 of all that follows, ids, ids a block (each u32, but ids u64)
    words before each block and in all (u32 each), escapes before each block and in all (u32 each)
    words (u64 each), escapes (u32 each)

all little-endian.  With the two tables of offsets a reader takes any block without those before it.
No ids make a segment of no blocks.  Ids below 0 or of 2^32 or more raise an error, as do damaged bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids a word and bits an id, by selector.
SLOTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3)
BITS = tuple(60 // n for n in SLOTS)
RUN, RUN_FROM, RUN_MOST = len(SLOTS), SLOTS[0] + 1, (1 << 28) - 1
ESCAPED = (1 << BITS[-1]) - 1
BLOCK = 4096
#: A block's places in the working arrays; a word may reach beyond the block's end by all its ids but one.
STRIDE = BLOCK + SLOTS[0] - 1
MAGIC, HEADER = b"S8B1", struct.Struct("<4sIQI")

#: Selector of the narrowest width that holds an id, by id; an escape fits any width.
_LIMITS = np.array([(1 << b) - 1 for b in BITS], np.int64)
_NARROW = np.searchsorted(_LIMITS, np.arange(1 << 16), "right").astype(np.uint8)
_COUNT = np.array([*SLOTS, 0, 0, 0, 0], np.int64)


def narrowest(ids: np.ndarray) -> np.ndarray:
    """For each id the selector of the narrowest width that holds it."""
    out = _NARROW[np.minimum(ids, 0xFFFF)]
    large = np.flatnonzero(ids > 0xFFFF)
    if len(large):
        value = ids[large].astype(np.int64)
        out[large] = np.where(value >= ESCAPED, 0, np.searchsorted(_LIMITS, value, "right"))
    return out


def widest_fit(kind: np.ndarray) -> np.ndarray:
    """For each place the selector of most ids that all fit; kind: the narrowest selector of the id there, with room for a word behind the last."""
    best, window, have = np.full(len(kind), RUN - 1, np.uint8), kind, 1
    for s in range(RUN - 1, -1, -1):  # from few ids to many: a window of n ids is two overlapping ones of half or more
        while have < SLOTS[s]:
            step = min(have, SLOTS[s] - have)
            grown = window.copy()
            np.maximum(window[:-step], window[step:], out=grown[:-step])
            window, have = grown, have + step
        np.putmask(best, window <= s, s)
    return best


def encoded(ids: np.ndarray) -> bytes:
    """The segment of ids."""
    ids = np.asarray(ids)
    if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < 1 << 32):
        raise ValueError("an id does not fit 32 bits")
    ids = ids.astype(np.uint32)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return sealed(0, np.zeros(1, np.uint32), np.zeros(1, np.uint32), np.zeros(0, np.uint64), ids)
    padded = np.zeros((blocks, STRIDE), np.uint32)
    flat = np.zeros(blocks * BLOCK, np.uint32)
    flat[: len(ids)] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    padded = padded.ravel()
    selector = widest_fit(narrowest(padded))
    count = _COUNT[selector]

    # A run of more equal ids than any word holds, within its block, is one word.
    ends = np.append(np.flatnonzero(padded[1:] != padded[:-1]) + 1, len(padded))
    length = np.diff(ends, prepend=0)
    for end, n in zip(ends[length >= RUN_FROM].tolist(), length[length >= RUN_FROM].tolist()):
        at = np.arange(end - n, end)
        left = np.minimum(end - at, (at // STRIDE) * STRIDE + BLOCK - at)
        long = left >= RUN_FROM
        selector[at[long]], count[at[long]] = RUN, left[long]

    jump, starts, before = count.tolist(), [], [0]
    for b in range(blocks):
        at = b * STRIDE
        end = at + min(BLOCK, len(ids) - b * BLOCK)
        while at < end:
            starts.append(at)
            at += jump[at]
        before.append(len(starts))
    starts = np.array(starts, np.int64)

    kinds = selector[starts]
    words = kinds.astype(np.uint64) << np.uint64(60)
    for s, (n, bits) in enumerate(zip(SLOTS, BITS)):
        at = np.flatnonzero(kinds == s)
        if len(at):
            value = np.minimum(padded[starts[at, None] + np.arange(n)], np.uint32((1 << bits) - 1)).astype(np.uint64)
            words[at] |= np.bitwise_or.reduce(value << (np.arange(n) * bits).astype(np.uint64), axis=1)
    at = np.flatnonzero(kinds == RUN)
    words[at] |= padded[starts[at]] | count[starts[at]].astype(np.uint64) << np.uint64(32)

    place = np.flatnonzero(ids >= ESCAPED)
    # The id of a run stands in its word, so escapes are those that slots stand for.
    word_of = np.searchsorted(starts, place // BLOCK * STRIDE + place % BLOCK, "right") - 1
    place = place[kinds[word_of] != RUN]
    escapes_before = np.searchsorted(place, np.arange(blocks + 1) * BLOCK)
    return sealed(len(ids), np.array(before, np.uint32), escapes_before.astype(np.uint32), words, ids[place])


def sealed(n: int, words_before: np.ndarray, escapes_before: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> bytes:
    body = b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in (words_before, escapes_before, words, escapes))
    tail = struct.pack("<QI", n, BLOCK) + body
    return MAGIC + struct.pack("<I", zlib.crc32(tail)) + tail


def decoded(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a segment's blocks from first up to last (all, if not named)."""
    if len(segment) < HEADER.size or segment[:4] != MAGIC:
        raise ValueError("these bytes are no segment")
    _, crc, n, size = HEADER.unpack_from(segment)
    if crc != zlib.crc32(memoryview(segment)[8:]):
        raise ValueError("the segment is damaged")
    blocks = -(-n // size)
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(segment, "<u4", 2 * (blocks + 1), HEADER.size).astype(np.int64)
    words_before, escapes_before = offsets[: blocks + 1], offsets[blocks + 1 :]
    words_at = HEADER.size + offsets.nbytes // 2
    words = np.frombuffer(segment, "<u8", int(words_before[-1]), words_at)[words_before[first] : words_before[last]]
    escapes = np.frombuffer(segment, "<u4", int(escapes_before[-1]), words_at + 8 * int(words_before[-1]))[escapes_before[first] : escapes_before[last]]

    kinds = (words >> np.uint64(60)).astype(np.int64)
    if len(kinds) and kinds.max() > RUN:
        raise ValueError("a selector is not known")
    count = _COUNT[kinds]
    runs = np.flatnonzero(kinds == RUN)
    count[runs] = (words[runs] >> np.uint64(32)).astype(np.int64) & RUN_MOST
    # Words of a block lie one behind the other from the block's place on.
    stride, begin = size + SLOTS[0] - 1, words_before[first:last] - words_before[first]
    behind = np.cumsum(count) - count
    place = behind + np.repeat(np.arange(last - first) * stride - behind[begin], np.diff(np.append(begin, len(words))))
    out, escaped = np.zeros((last - first) * stride, np.uint32), []
    for s, (slots, bits) in enumerate(zip(SLOTS, BITS)):
        at = np.flatnonzero(kinds == s)
        if len(at):
            most = np.uint64((1 << bits) - 1)
            value = words[at, None] >> (np.arange(slots) * bits).astype(np.uint64) & most
            to = place[at, None] + np.arange(slots)
            out[to] = value
            if len(escapes):
                escaped.append(to[value == most])
    for at in runs.tolist():
        out[place[at] : place[at] + count[at]] = words[at] & np.uint64(0xFFFFFFFF)
    if len(escapes):
        out[np.sort(np.concatenate(escaped))] = escapes
    return out.reshape(last - first, stride)[:, :size].ravel()[: n - first * size]
