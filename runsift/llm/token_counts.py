"""Token counts with overlap resynchronisation.

A document of at most WINDOW characters is cut where the byte-level pattern always begins a
token: before a single space between two characters that are not white space.  No match of
the pattern has a space after its first character unless it is all white space, and special
strings hold no space, so such a place is a token boundary whatever surrounds it.  Each distinct
part is solved once and its count remembered by the worker: parts of Latin letters are cut by the
pattern and go to the library's merging model, all others go through the whole library.

A longer document is encoded in windows with offsets.  A window begins at a token boundary of the
one before and overlaps it; the two are spliced at a place of the overlap that is proven to be a
boundary of the whole text:

* both windows begin a match of the pattern there: the pattern never looks back, so from such a
  place on both cut alike; or
* one match of the pattern spans the overlap (letters without any space, say), and both windows
  have the same two tokens before and after the place: tokens are what merging by rank gives
  exactly if each could stay beside the next, and each of these pairs is in one of the windows.

The margin at both ends of the overlap is longer than any special string.  Without such a place
the overlap is doubled, and at last both windows are encoded as one.  The work is in proportion to
the text but where overlaps have to grow.  Counts are exact for any text.

Defined results: null counts as empty, which has 0 tokens; repeated rows give repeated results; all
columns are kept, but for one with the name of the result, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbag import Remembered, in_slices

WINDOW, OVERLAP = 65_536, 1_024
CACHE_LIMIT, LONG_PART = 400_000, 64
STABLE = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s | \s|\A | \Z")
#: Parts on which every version of Unicode agrees: ASCII and the accented letters of Latin-1; not those that may hold a special string.
PLAIN = re.compile(" ?[!-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]{1,63}")
#: Marks that the patterns cut off a word's end whatever the word is.
MARKS = ".,;:!?"
#: Fixed value: the byte-level pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for the signs from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
OTHERS = [b for b in range(256) if b not in PRINTABLE]
BYTE_SIGNS = {b: chr(b) if b in PRINTABLE else chr(256 + OTHERS.index(b)) for b in range(256)}


def load(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class Window(NamedTuple):
    """Tokens of text[begin:...]: ids, the characters where each starts and ends, and whether it begins a match of the pattern."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    new: np.ndarray

    def after(self, i: int) -> Window:
        return Window(*(a[i:] for a in self))


class Counter:
    """Token counts of texts under one tokenizer file; made once a worker."""

    def __init__(self, path: str, window: int = WINDOW, overlap: int = OVERLAP):
        self.tokenizer, self.window, self.overlap = load(path), window, overlap
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = 8 + max(map(len, special), default=0)
        self.cut_by_pattern = all(t.startswith("<") for t in special)
        self.known = Remembered(self.part, CACHE_LIMIT, LONG_PART)
        self.matches = Remembered(self.match, CACHE_LIMIT, LONG_PART)

    def match(self, letters: str) -> int:
        signs = "".join([BYTE_SIGNS[b] for b in letters.encode()])
        return len(self.model.tokenize(signs))

    def part(self, part: str) -> int:
        if self.cut_by_pattern and PLAIN.fullmatch(part):
            if part[1:].isalpha():  # one match of the pattern
                if part[0] == " " or part[0].isalpha():
                    return self.matches[part]
            elif part[0] == " " and part[1:-1].isalpha() and part[-1] in MARKS:
                return self.matches[part[:-1]] + self.matches[part[-1]]
            return sum(map(self.matches.__getitem__, PATTERN.findall(part)))
        return len(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def counts(self, texts: list[str]) -> list[int]:
        return [sum(map(self.known.__getitem__, stable_parts(t))) if len(t) <= self.window else self.spliced(t) for t in texts]

    def tokens(self, text: str, begin: int, end: int) -> Window:
        got = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        place = np.array(got.offsets, np.int64).reshape(-1, 2) + begin
        match = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
        return Window(np.array(got.ids, np.int64), place[:, 0], place[:, 1], np.append(True, match[1:] != match[:-1]))

    def spliced(self, text: str) -> int:
        """Tokens of a text longer than a window."""
        return len(self.spliced_ids(text))

    def spliced_ids(self, text: str) -> np.ndarray:
        done: list[np.ndarray] = []
        end = min(self.window, len(text))
        anchor, kept = 0, 0  # the last splice at which a match of the pattern begins, and how many parts lie before it
        left = self.tokens(text, 0, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                start = boundary_before(left, end - overlap)
                stop = min(len(text), end + self.window - overlap)
                if start <= left.start[0]:  # no common boundary: all from the anchor on as one
                    stop = min(len(text), end + self.window)
                    del done[kept:]
                    left = self.tokens(text, anchor, stop)
                    break
                right = self.tokens(text, start, stop)
                both = common_boundary(left, right, start, end, self.margin)
                if both:
                    i, j = both
                    done.append(left.ids[:i])
                    if left.new[i] and right.new[j]:
                        anchor, kept = int(right.start[j]), len(done)
                    left = right.after(j)
                    break
                overlap *= 2
            end = stop
        return np.concatenate([*done, left.ids])


def boundary_before(w: Window, at: int) -> int:
    """The last place up to ``at`` where one token ends and the next starts; -1 if there is none."""
    i = np.flatnonzero((w.end[:-1] == w.start[1:]) & (w.start[1:] <= at))
    return int(w.start[i[-1] + 1]) if len(i) else -1


def common_boundary(left: Window, right: Window, start: int, end: int, margin: int) -> tuple[int, int] | None:
    """Numbers of the left and the right window's token at a place that is proven to be a boundary; None if there is none."""
    low, high = start + margin, end - margin
    if low > high:
        return None
    both, i, j = np.intersect1d(np.where(left.new, left.start, -1), np.where(right.new, right.start, -2), return_indices=True)
    fine = np.flatnonzero((both >= low) & (both <= high))
    if len(fine):
        k = fine[len(fine) // 2]
        return int(i[k]), int(j[k])
    # One match must span the overlap in both windows, up to the first match that either begins in it.
    later = np.concatenate([w.start[w.new & (w.start > start)] for w in (left, right)])
    high = min(high, int(later.min()) - 1) if len(later) else high
    sides = []
    for w in (left, right):
        at = np.flatnonzero((w.end[:-1] == w.start[1:]) & (w.start[1:] >= low) & (w.start[1:] <= high)) + 1
        sides.append((w, at))
    (a, x), (b, y) = sides
    _, i, j = np.intersect1d(a.start[x], b.start[y], return_indices=True)
    i, j = x[i], y[j]
    same = (a.ids[i] == b.ids[j]) & (a.ids[i - 1] == b.ids[j - 1]) & (a.start[i - 1] == b.start[j - 1]) & (a.end[i] == b.end[j])
    fine = np.flatnonzero(same)
    if not len(fine):
        return None
    k = fine[len(fine) // 2]
    return int(i[k]), int(j[k])


def stable_parts(text: str) -> list[str]:
    """The text cut before every single space between two characters that are not white space."""
    if not text:
        return []
    if ODD_SPACE.search(text):
        cut = STABLE.split(text)
        return cut[:1] + [" " + p for p in cut[1:]]
    first, *rest = text.split(" ")
    return [first] + [" " + p for p in rest]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text, without added special tokens, in column ``out``."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        out: list[int] = []
        for _, part in in_slices(texts):
            out += counter.counts(part)
        return pd.Series(out, dtype="int64")

    return docs.withColumn(out, counted(F.col(text)))
