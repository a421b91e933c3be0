"""Token files: the ids of documents in ascending order of doc_id, as Simple-8b segments.

Documents are dealt out by ranges of doc_id (rows of one doc_id by a hash of their text, and equal ones
by their place in the input), so that no range holds more because a key is frequent.  A task sorts its
range, encodes text after text and closes a segment behind the document with which it has SEGMENT ids or
more; a segment holds whole documents, a document of any length lies in one.  A file is a table of segments:

    part, segment     number of the range and of the segment in it; both ascend with doc_id
    begin             ids of the same part before the segment
    doc_ids, ends     the documents in order and the ids of the segment up to the end of each
    ids               the bytes described in simple8b

Spark writes the table, so any store that Spark knows will do, and a task that is run again leaves nothing
twice.  Readers get at single blocks by the offsets within a segment.

Defined results: null texts are empty, and have the end id alone; a null doc_id comes first and stays null;
rows that share a doc_id are documents of their own, ordered by the hash of their texts; columns other than
doc_id and the text are not written; an empty table makes files without rows.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .token_counts import BYTE_SIGNS, LONG_PART, PATTERN, STABLE, Counter
from .wordbag import Remembered

#: A segment is closed from so many ids on.
SEGMENT = 1 << 18
#: Documents decoded into one Arrow batch take this many ids, or one document.
READ_BATCH = 1 << 20
COLUMNS = "part int, segment int, begin long, doc_ids array<long>, ends array<long>, ids binary"


#: Parts that the pattern cuts alike in every version: as for counting, with line feeds inside.
PLAIN = re.compile(" ?[!-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff\n]{1,63}")
#: Signs that end a word and are no letters, digits or white space; no special string begins with one of them.
ENDINGS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
#: White space besides blanks, in ASCII and in all.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_SPACES = SPACES + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Distinct parts behind a blank, and others, that a worker remembers, twice at most.
CACHE_LIMIT, OTHERS_LIMIT = 500_000, 100_000
BLANK = BYTE_SIGNS[32]
#: Letters up to this one are letters in every version of Unicode.
LAST_LETTER = "\xff"


class CharacterSigns(dict):
    """Code point -> signs of its UTF-8 bytes in the vocabulary, for str.translate."""

    def __missing__(self, code: int) -> str:
        signs = self[code] = "".join([BYTE_SIGNS[b] for b in chr(code).encode()])
        return signs


SIGNS = CharacterSigns()


class Encoder(Counter):
    """Ids of whole texts as little-endian unsigned 32-bit; made once a worker.

    A text is cut where a token always begins, and distinct parts are encoded once, as for counting.  Parts behind a
    blank, which most are, are remembered without it.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.behind = Remembered(self.behind_blank, CACHE_LIMIT, LONG_PART)
        self.known = Remembered(self.part, OTHERS_LIMIT, LONG_PART)
        self.matches = Remembered(self.match, OTHERS_LIMIT, LONG_PART)
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # what is met again is remembered here

    def match(self, letters: str) -> bytes:
        """Ids of one match of the pattern."""
        return self.merged(letters.translate(SIGNS))

    def merged(self, signs: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def behind_blank(self, part: str) -> bytes:
        """Ids of a blank and a part that begins with another sign."""
        got = self.by_match(part, BLANK, self.behind)
        return self.whole(" " + part) if got is None else got

    def part(self, part: str) -> bytes:
        got = self.by_match(part, "", self.known)
        return self.whole(part) if got is None else got

    def by_match(self, part: str, blank: str, same: Remembered) -> bytes | None:
        """Ids of a part whose matches are found by its letters or lines, behind the sign ``blank``; same: remembers such parts; None for others."""
        if not self.cut_by_pattern or len(part) >= LONG_PART:
            return None
        word = part.rstrip(ENDINGS)
        if word.isalpha() and max(word) <= LAST_LETTER:
            if len(word) == len(part):
                return self.merged(blank + (part if part.isascii() else part.translate(SIGNS)))
            return None if "<" in part else same[word] + self.matches[part[len(word) :]]
        lines = part.split("\n")
        if len(lines) > 1 and all(lines) and PLAIN.fullmatch(part):  # a line feed between two signs that are no white space is a match by itself
            return self.matches["\n"].join([same[lines[0]], *map(self.known.__getitem__, lines[1:])])
        return None

    def whole(self, part: str) -> bytes:
        if self.cut_by_pattern and PLAIN.fullmatch(part):
            return b"".join(map(self.matches.__getitem__, PATTERN.findall(part)))
        if len(part) > self.window:
            return self.spliced_ids(part).astype("<u4").tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = STABLE.split(text) if has_odd_space(text) else text.split(" ")
        return self.known[first] + b"".join(map(self.behind.__getitem__, rest))


def has_odd_space(text: str) -> bool:
    """Whether a blank stands at an end or beside other white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return True
    return any(w in text and (" " + w in text or w + " " in text) for w in (SPACES if text.isascii() else WIDE_SPACES))


_encoders: dict[str, Encoder] = {}


def write(docs: DataFrame, path: str, folder: str, end_id: int, text: str = "text", doc_id: str = "doc_id", parts: int | None = None) -> None:
    """Writes the ids of docs under the tokenizer at path, end_id behind each document, as token files into a folder that is not there yet."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = end_id.to_bytes(4, "little")

    def segments(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        part, number, begin = TaskContext.get().partitionId(), 0, 0
        names, ends, held, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"part": part, "segment": number, "begin": begin, "doc_ids": names, "ends": ends, "ids": simple8b.encoded(ids)}
            kinds = {"part": pa.int32(), "segment": pa.int32(), "begin": pa.int64(), "doc_ids": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "ids": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds[c]) for c in kinds], list(kinds))

        for batch in batches:
            for name, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.append(encoder.encode(value.as_py() or "") + end)
                size += len(held[-1]) // 4
                names.append(name)
                ends.append(size)
                if size >= SEGMENT:
                    yield closed()
                    number, begin = number + 1, begin + size
                    names, ends, held, size = [], [], [], 0
        if names:
            yield closed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The last key parts rows that are equal in all else; it is fixed by the input's files.
    rows = rows.withColumns({"key": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), "key", "row"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(segments, COLUMNS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of each document in token files: the ids of all documents before it, and its own as little-endian unsigned 32-bit."""
    stored = spark.read.schema(COLUMNS).parquet(folder)
    # One row a file; the sum over all that are before is of so many rows.
    sizes = stored.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n"))
    before = sizes.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = simple8b.decoded(row["ids"]).astype("<u4"), row["ends"]
                low = 0
                while low < len(ends):
                    first = ends[low - 1] if low else 0
                    high = max(low + 1, int(np.searchsorted(ends, first + READ_BATCH, "right")))
                    starts = [first, *ends[low : high - 1]]
                    # One buffer for all documents of the batch: their ids lie one behind the other.
                    at = pa.array((np.array([first, *ends[low:high]], np.int64) - first) * 4).buffers()[1]
                    values = pa.Array.from_buffers(pa.large_binary(), high - low, [None, at, pa.py_buffer(ids[first : ends[high - 1]].tobytes())])
                    columns = [pa.array([row["part"]] * (high - low), pa.int32()), pa.array(row["doc_ids"][low:high], pa.int64()), pa.array([row["begin"] + s for s in starts], pa.int64()), values.cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "start", "ids"])
                    low = high

    found = stored.mapInArrow(documents, "part int, doc_id long, start long, ids binary")
    return found.join(F.broadcast(before), F.col("part") == F.col("of")).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "ids")


def digest(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents that read() gives."""
    return stored.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
