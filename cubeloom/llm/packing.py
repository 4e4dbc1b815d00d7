"""Best-fit packing of token pieces into sequences, with a fixed number of open bins.

Each task tokenises its own documents and packs their pieces as they come, so no text is shuffled and
a lost task is packed again alone. The open bins stand in lists by their free space, and one integer
serves as a bitset of the free spaces in use: the tightest bin that still takes a piece is the lowest
set bit at or above its length. When all bins are open, the fullest closes for a new one. What lies in bins that are
still open when a task ends is packed once more in the same way, together with that of other tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored, worker_cache

SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)


class OpenBins:
    """A fixed number of open bins of one capacity; place() gives the bin and the place in it."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - space


class CachedIds(dict):
    """Ids of texts from a tokenizer file, encoding each chunk once.

    Chunks lie between ASCII white space, which the tokenizer must drop and split at, so that the ids of a
    text are those of its chunks in turn; as it lower-cases, so may the chunks be. In plain texts (no other
    signs than letters up to U+00FF, digits, points and commas, and no two marks in a row) the marks are
    chunks too. The cache has two tiers of at most ``most`` chunks: when the new one is full it becomes the old one, and
    chunks that are met again move up, so that frequent ones stay. The tokenizer takes letters, each digit and other signs
    apart, so the parts of simple chunks go to its model at once, by way of the cache.
    """

    _PLAIN = bytes(range(ord("a"), ord("z") + 1)) + b"0123456789 \n\t.,\xc3" + bytes(range(0x80, 0xC0))
    _NOT_PLAIN = (b",,", b"..", b",.", b".,", b"\xc3\x97", b"\xc3\xb7")
    #: Simple chunks: no letters beyond U+00FF, no apostrophes, nothing that could be a special token; and their parts.
    _SIMPLE = re.compile(r"(?:[!-&(-;=-~]|[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])+")
    _PARTS = re.compile(r"[a-z\u00c0-\u00ff]+|[0-9]|[^a-z0-9\u00c0-\u00ff]+")

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        self.most = most
        # the signs that stand for bytes inside the model
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.signs = {k: 256 + n for n, k in enumerate(k for k in range(256) if k not in shown)}
        for probe in (b"verstst", b"\xc3\x89verstst", b"the,&&&", b"a1b22%%.\xc3\xa9"):
            if self._encode(probe) != self._whole(probe.decode()):
                raise ValueError("this tokenizer doesn't take texts apart as expected")
        self.clear()

    def chunks(self, text: bytes) -> list[bytes]:
        if b"<|" in text:  # special tokens are found before letters are lowered
            return text.split()
        text = text.lower()
        if not text.translate(None, self._PLAIN) and not any(p in text for p in self._NOT_PLAIN):
            text = text.replace(b",", b" , ").replace(b".", b" . ")
        return text.split()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, text: str) -> bytes:
        if not text.isascii():
            text = text.lower().encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if chunk.isalpha():
            return self._part(text.lower())
        if not self._SIMPLE.fullmatch(text):
            return self._whole(text)
        parts = self._PARTS.findall(text.lower())
        return self._part(parts[0]) if len(parts) == 1 else b"".join([self[x.encode()] for x in parts])

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
        self[chunk] = ids
        return ids

    def __call__(self, text: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        chunks = self.chunks(text)
        return b"".join(itemgetter(*chunks)(self)) if len(chunks) > 1 else self[chunks[0]] if chunks else b""


@worker_cache
def worker_ids(path: str) -> CachedIds:
    """One cache for all tasks of a Python worker."""
    return CachedIds(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack_best_fit(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    open_bins: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise every document and pack its pieces into sequences of at most ``capacity`` tokens.

    A document is its ids followed by ``end_id``; one that is longer than ``capacity`` is cut into
    pieces of ``capacity``, of which the last may be shorter. Returns a row for each piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty (one piece of one
    token), null ids stay null, repeated rows are packed each for itself, other columns are not read,
    and an empty table gives no rows. A text is tokenised whole, so the longest must fit in a worker's memory. Sequence
    numbers hold the task's number in their high bits.

    The pieces in bins that a task leaves open (at most ``open_bins`` of them, whatever its input) are dealt out by
    hash to tasks of about a million, which pack them anew in turns: those of a turn fill about half of the open bins, and
    come longest first.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_ids(tokenizer_path)
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                ids = memoryview(ids_of(text.as_py() or b"") + end)
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    number, offset = bins.place(length)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((doc_id, piece, start, length, crc, base | number, offset))
            yield _batch(out)
        yield _batch([(None, -1, 0, 0, 0, base | k, 0) for numbers in bins.free for k in numbers])

    def pack_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = 1 << 62 | TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(length) for length in batch.column(3).to_pylist()]
            columns = [[base | number for number, _ in places], [offset for _, offset in places]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, pa.int64()) for c in columns)], schema=_ARROW)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    packed = stored(rows.mapInArrow(pack, SCHEMA))
    pieces, still_open = packed.filter("piece >= 0"), packed.filter("piece < 0").select("sequence_id")
    left = stored(pieces.join(still_open, "sequence_id", "left_semi").select(*_ARROW.names))
    held = left.agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens")).first()
    tasks = max(1, -(-held.pieces // (1 << 20)))
    turns = max(1, -(-(held.tokens or 0) // (tasks * capacity * open_bins // 2)))
    dealt, turn = F.xxhash64("sequence_id", "offset"), F.pmod(F.xxhash64("sequence_id", "offset", F.lit(1)), F.lit(turns))
    again = left.repartition(tasks, dealt).sortWithinPartitions(turn, F.desc("length"), "sequence_id", "offset")
    closed = pieces.join(still_open, "sequence_id", "left_anti").select(*_ARROW.names)
    return closed.unionByName(again.mapInArrow(pack_again, SCHEMA))
