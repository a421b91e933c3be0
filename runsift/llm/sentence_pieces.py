"""SentencePiece encoding and decoding as a weighted finite-state transducer.

From the model file three machines are compiled: the normaliser (its character map's longest
matches, white space rules, dummy prefix, space to the meta symbol), the pieces (an arc for every
piece that matches at a place, with byte arcs for characters that no piece covers) and, for models
of the BPE type, an acceptor of piece pairs: a pair has weight infinity (the tropical zero) when
merging by rank would never leave these two pieces side by side, else one; a sequence of pieces is
what merging gives exactly if all its neighbours are such pairs.  A run of meta symbols, whose
pieces can be merged in several ways, is an arc of its own, with what merging makes of the run.

A text composed with the machines is a lattice whose states are places with the piece that ends
there; its tropical shortest path from left to right is the encoding.  For models of the BPE type
one path only has a finite weight, so the first that is found, longest arcs first, is the shortest.
For unigram models an arc weighs minus the piece's score, and the path is found place by place.

Pieces never hold the meta symbol after another character, so the lattice falls apart before
every run of meta symbols; each distinct part is solved once and remembered by the worker.

Models with pieces set by their user, or with white space as a suffix, are refused.  Defined
results: null counts as empty, which has no pieces; any text of any length can be encoded; repeated rows
give repeated results; extra columns are kept, but for one with the name of the result, which is replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbag import Remembered

META = "▁"
CACHE_LIMIT, LONG_PART = 400_000, 48
PAIR_LIMIT = 2_000_000
PART = re.compile(f"{META}+[^{META}]*")
#: Kinds of pieces and of models in the file format.
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4
UNIGRAM, BPE = 1, 2
NEVER = 1 << 60


def fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class Normaliser:
    """The machine in front of the pieces: the longest match of the character map at each place is replaced, then white space is settled."""

    def __init__(self, spec: dict):
        self.rules = character_map(spec.get(2, b""))
        self.longest = max(map(len, self.rules), default=0)
        self.first = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in self.rules}))) + "]") if self.rules else None
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))

    def replaced(self, text: str) -> str:
        out, at = [], 0
        while m := self.first.search(text, at):
            out.append(text[at : m.start()])
            at = m.start()
            size = next((k for k in range(self.longest, 0, -1) if text[at : at + k] in self.rules), 0)
            out.append(self.rules[text[at : at + size]] if size else text[at])
            at += size or 1
        return "".join(out) + text[at:]

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.first:
            text = self.replaced(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return ""
        text = " " + text if self.prefix else text
        return text.replace(" ", META) if self.escape else text


def character_map(data: bytes) -> dict[str, str]:
    """Keys and their replacements, read off the double-array trie of a precompiled character map."""
    if not data:
        return {}
    size = struct.unpack_from("<I", data)[0]
    units, blob = np.frombuffer(data, "<u4", size // 4, 4), data[4 + size :]
    labels = np.arange(256, dtype=np.uint32)
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    found, todo = {}, [(offset(int(units[0])), b"")]
    while todo:
        at, key = todo.pop()
        beside = at ^ labels
        beside = beside[beside < len(units)]
        for place in beside[(units[beside] & 0x800000FF) == (beside ^ at)].tolist():
            unit, label = int(units[place]), place ^ at
            if not label:
                continue
            longer, below = key + bytes([label]), place ^ offset(unit)
            if unit >> 8 & 1:
                value = int(units[below]) & 0x7FFFFFFF
                found[longer.decode()] = blob[value : blob.index(b"\0", value)].decode()
            todo.append((below, longer))
    return found


class Transducer:
    def __init__(self, path: str):
        pieces, normal, trainer = [], {}, {}
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    d = dict(fields(value))
                    pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
                elif number == 2:
                    trainer = dict(fields(value))
                elif number == 3:
                    normal = dict(fields(value))
        if trainer.get(24) or any(k == USER for _, _, k in pieces):
            raise ValueError("pieces set by the user and white space as a suffix are not compiled")
        self.normaliser, self.kind = Normaliser(normal), trainer.get(3, UNIGRAM)
        self.text = [p for p, _, _ in pieces]
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.cost = [-s for _, s, _ in pieces]
        #: Fixed value of the format: an unknown character weighs 10 more than the dearest piece.
        self.unknown_cost = max((self.cost[i] for i in self.id.values()), default=0.0) + 10.0
        self.splits = not any(META in p.lstrip(META) for p in self.id)
        self.leading = max((len(p) - len(p.lstrip(META)) for p in self.id if p.strip(META)), default=0)
        order = sorted(self.id.values(), key=lambda i: (self.cost[i], i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.bytes = [b""] * len(pieces)
        for p, i in self.id.items():
            self.bytes[i] = p.replace(META, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.bytes[self.unknown] = b" \xe2\x81\x87 "
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        # Pieces that merging never gives have no arc.
        self.matches = {p: i for p, i in self.id.items() if self.kind != BPE or self.half(i) != (-1, -1)}
        self.longest = max(map(len, self.matches), default=1)
        # The pieces' automaton: every beginning of a piece, with the piece's id or -1.
        self.prefixes = dict(self.matches)
        for p in self.matches:
            for k in range(1, len(p)):
                self.prefixes.setdefault(p[:k], -1)
        self.path = self.merging_path if self.kind == BPE else self.cheapest_path
        self.known = Remembered(self.found, CACHE_LIMIT, LONG_PART)

    # -- merging by rank: compiles the pair acceptor

    def merged(self, text: str) -> tuple[list[str], tuple[int, int] | None]:
        """Pieces after all merges, the best rank first and the leftmost among equals, and the last merge's two ids."""
        sym, left, right, last = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1)), None
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(text):
                i = self.id.get(sym[a] + sym[b])
                if i is not None:
                    heapq.heappush(heap, (self.cost[i], a, b, sym[a], sym[b]))

        for a in range(len(text) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if sym[a] != x or sym[b] != y or right[a] != b or not x or not y:
                continue
            last = (self.id.get(x, -1), self.id.get(y, -1))
            sym[a], sym[b] = x + y, ""
            right[a] = right[b]
            if right[b] < len(text):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in sym if s], last

    def half(self, i: int) -> tuple[int, int] | None:
        """The two pieces that merge into i; None for one character, (-1, -1) if merging its text gives something else."""
        if i not in self.halves:
            got, last = self.merged(self.text[i])
            self.halves[i] = None if len(self.text[i]) == 1 else last if len(got) == 1 and last else (-1, -1)
        return self.halves[i]

    def spine(self, i: int, side: int) -> list[tuple[int, int, int]]:
        """(piece, when it is made, when the merge of which it is part is made) down one side of i's merge tree."""
        found = self.spines.get((i, side))
        if found is None:
            found, at, top = [], i, NEVER
            while True:
                own = self.half(at)
                found.append((at, self.rank[at] if own else -1, top))
                if not own or own[side] < 0:
                    break
                top, at = self.rank[at], own[side]
            self.spines[i, side] = found
        return found

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave a and b as neighbours."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            found = True
            for x, x_made, x_used in self.spine(a, 1):
                for y, y_made, y_used in self.spine(b, 0):
                    used = min(x_used, y_used)
                    if max(x_made, y_made) < used:
                        i = self.id.get(self.text[x] + self.text[y])
                        # Of equal ranks the leftmost merges first: x's own merge lies to the left of this one, y's to the right.
                        if i is not None and self.rank[i] < x_used and self.rank[i] <= y_used:
                            found = False
            if len(self.pairs) >= PAIR_LIMIT:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    # -- shortest paths

    def fallback(self, text: str) -> list[int]:
        """Ids of characters that no piece covers."""
        return [self.byte[b] for b in text.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def run(self, n: int) -> list[int]:
        """What the machine gives for n meta symbols with nothing beside them."""
        found = self.runs.get(n)
        if found is None:
            found = []
            for s in self.merged(META * n)[0]:
                found += [self.id[s]] if s in self.id else self.fallback(s)
            if n <= LONG_PART:
                self.runs[n] = found
        return found

    def walk(self, text: str, begin: int, last: int) -> list[int] | None:
        """Ids along the only path from place ``begin``, after the piece ``last``, to the end of the text; None if there is none.

        Arcs are tried longest first; a state (place, piece before it) that led nowhere is not entered again.
        """
        n, step, pairs, fits = len(text), self.prefixes.get, self.pairs.get, self.side_by_side
        ids, ends, arcs, dead = [], [], [], set()
        i, before = begin, last
        while True:
            if before is not None:  # a new state: its arcs, the longest last
                if i == n:
                    ids.append(before)
                    ends.append(i)
                    return [x for p, a, b in zip(ids[1:], ends, ends[1:]) for x in ((p,) if p >= 0 else self.fallback(text[a:b]))]
                out, j = [], i + 1
                piece = step(text[i:j])
                if piece is None or piece < 0:
                    out.append((-1, j))  # the byte arc
                while piece is not None:
                    if piece >= 0:
                        out.append((piece, j))
                    j += 1
                    piece = step(text[i:j]) if j <= n else None
                ids.append(before)
                ends.append(i)
                arcs.append(out)
            elif not ids:
                return None
            out, state = arcs[-1], ids[-1]
            before = None
            while out:
                piece, j = out.pop()
                if state >= 0 and piece >= 0:
                    ok = pairs(state << 32 | piece)
                    if not (fits(state, piece) if ok is None else ok):
                        continue
                if not dead or (piece, j) not in dead:
                    i, before = j, piece
                    break
            else:
                dead.add((ids.pop(), ends.pop()))
                arcs.pop()

    def merging_path(self, text: str) -> list[int]:
        """Ids of one part under a model of the BPE type: a run of meta symbols is one arc, which leaves no more of them to the pieces behind it than these can hold."""
        n = len(text) - len(text.lstrip(META))
        if n < 2:
            return self.walk(text, 0, -1)
        for k in range(n, max(n - self.leading, 0) - 1, -1):
            head = self.run(k) if k else []
            rest = self.walk(text, k, head[-1] if head else -1)
            if rest is not None:
                return head + rest
        raise AssertionError("the pieces and bytes cover every text")

    def cheapest_path(self, text: str) -> list[int]:
        """Ids along the path of the least sum of weights, for unigram models."""
        n, cost = len(text), self.cost
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(float("inf"), 0, -1)] * n
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = self.matches.get(text[i:j])
                if piece is not None and best[i][0] + cost[piece] < best[j][0]:
                    best[j] = (best[i][0] + cost[piece], i, piece)
            if text[i] not in self.id and best[i][0] + self.unknown_cost < best[i + 1][0]:
                best[i + 1] = (best[i][0] + self.unknown_cost, i, -1)
        out: list[list[int]] = []
        while n:
            _, i, piece = best[n]
            # Without bytes, neighbours that no piece covers are one unknown piece.
            while piece < 0 and not self.byte and i and best[i][2] < 0:
                i = best[i][1]
            out.append([piece] if piece >= 0 else self.fallback(text[i:n]))
            n = i
        return [x for ids in reversed(out) for x in ids]

    def found(self, part: str) -> bytes:
        return np.array(self.path(part), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        text = self.normaliser(text)
        if not text:
            return b""
        if not self.splits or text[0] != META:
            return self.found(text)
        return b"".join(map(self.known.__getitem__, PART.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The text of the ids; invalid byte sequences become U+FFFD."""
        table = self.bytes
        text = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.normaliser.prefix and text[:1] == " " else text


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    return _made.get(path) or _made.setdefault(path, Transducer(path))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as array<int> in column ``out``."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        machine = transducer(path)
        return pd.Series([np.frombuffer(machine.encode(t or ""), "<i4") for t in texts])

    return docs.withColumn(out, ids(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text of an array<int> of ids in column ``out``; null for null."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        machine = transducer(path)
        return pd.Series([None if v is None else machine.decode(np.asarray(v, "<u4").tobytes()) for v in values], dtype=object)

    return rows.withColumn(out, text(F.col(ids)))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip): digests of the encoding of docs(doc_id, text), and whether decoding gives the text back."""

    @F.pandas_udf("n_pieces long, ids_crc32 long, round_trip boolean")
    def made(texts: pd.Series) -> pd.DataFrame:
        machine, rows = transducer(path), []
        for t in texts:
            t = t or ""
            ids = machine.encode(t)
            rows.append((len(ids) // 4, zlib.crc32(ids), machine.decode(ids) == t))
        return pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "round_trip"])

    return docs.select("doc_id", made("text").alias("d")).select("doc_id", "d.*")
