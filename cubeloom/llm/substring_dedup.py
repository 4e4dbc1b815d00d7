"""Removal of long strings that occur more than once anywhere in the corpus, by sorting suffixes shard by shard.

Shards are cut by content, so that equal strings meet in one shard: of the 32-byte grams in a string of the
given length, the one of the least hash is its anchor. The strings of a text that share an anchor follow
each other and make one piece of text. Pieces that are equal as a whole are counted and then kept once; where
an anchor has several pieces, the suffixes that start a string are sorted (suffix_sort) to find what they have in common. The
pieces of an anchor that has too many for one shard are cut again, by the anchors that another hash gives, until they fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored
from .suffix_sort import repeated_starts
from .words import Slice, mix, slices

GRAM = 32
#: Strings of one anchor are told apart by so many distances from their start to it.
PARTS = 8
#: Places in a block take so many bits; a longer text is read in blocks that overlap.
_BITS = 28
_PLACE = np.uint64((1 << _BITS) - 1)
_BLOCK = 1 << 21
_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)


def _sliding(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row."""
    n = len(values) - size + 1
    full = np.full(-(-len(values) // size) * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(values)] = values
    grid = full.reshape(-1, size)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def _grams(data: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each GRAM bytes in a row. Grams of one hash only share a group, so nothing rests on it."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    total = eight[:n] * _FACTORS[0]
    for k in range(1, GRAM // 8):
        total += eight[8 * k : 8 * k + n] * _FACTORS[k]
    return mix(total + np.uint64(salt) * _FACTORS[4])


def pieces(s: Slice, length: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Owner, first and last string start (inside the text), the anchor's distance from the first, anchor hash and piece hash of
    each piece of a slice."""
    owners = np.repeat(np.arange(s.n), np.diff(s.offsets))
    ends = s.offsets[1:]
    found = [tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)]
    for lo in range(0, len(s.data) - length + 1, _BLOCK):
        hi = min(lo + _BLOCK, len(s.data) - length + 1)
        grams = _grams(s.data[lo : hi + length - 1], salt)
        least = _sliding((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
        place = (least & _PLACE).astype(np.int64)
        owner = owners[lo:hi]
        start = np.flatnonzero(np.arange(lo, hi) + length <= ends[owner])
        if not len(start):
            continue
        owner, place = owner[start], place[start]
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        found.append((owner[first], start[first] + lo, start[last] + lo, place[first] + lo, grams[place[first]]))
    o, a, b, p, anchor = (np.concatenate(c) for c in zip(*found, strict=True))
    whole = mix(s.hashes(a, b + length) + (p - a).astype(np.uint64))
    return o, a - s.offsets[o], b - s.offsets[o], p - a, anchor, whole


_PIECE = "k1 long, k2 long, a long, b long, place long, anchor long, piece long"


def _find_pieces(length: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(2)):
                owner, a, b, place, anchor, piece = pieces(s, length, salt)
                rows = pa.array(owner + s.lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(a), pa.array(b), pa.array(place), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64))],
                    ["k1", "k2", "a", "b", "place", "anchor", "piece"],
                )

    return run


def _parts(length: int) -> tuple[int, int]:
    """How many parts the places before an anchor make at which a string of it may start, and how long one is; what is left over
    belongs to the last."""
    parts = max(1, min(PARTS, length - GRAM))
    return parts, max(1, (length - GRAM) // parts)


def _contexts(length: int):
    """Digests of what lies around a piece's anchor, for each part that has starts of its strings: from the nearest start of that
    part to the end of the string of its farthest one, which every string that starts in this part covers."""
    parts, size = _parts(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.asarray(batch.column(2))
            for s in slices(batch.column(3)):
                place, starts = places[s.lo : s.hi], np.diff(s.offsets) - length
                near = np.minimum(np.maximum(place - starts, 0) // size, parts - 1)
                n = np.minimum(place // size, parts - 1) - near + 1
                owner = np.repeat(np.arange(s.n), n)
                part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - near, n)
                lo = s.offsets[owner] + place[owner] - part * size
                context = mix(s.hashes(lo, lo + GRAM + (parts - 1) * size) + part.astype(np.uint64))
                rows = pa.array(owner + s.lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(part), pa.array(context.view(np.int64))],
                    ["anchor", "piece", "part", "context"],
                )

    return run


_FOUND = "anchor long, piece long, lo long, hi long"


def _sort_shard(length: int, memory: int):
    """Of the pieces of one shard, what strings cover that another piece, or another place in this one, has too."""

    def run(table: pa.Table) -> pa.Table:
        texts = [x.as_py() for x in table.column("bytes")]
        row, lo, hi = [], [], []
        for k, starts in enumerate(repeated_starts(texts, length, memory)):
            if len(starts):
                gap = np.flatnonzero(starts[1:] - starts[:-1] > length)
                row.append(np.full(len(gap) + 1, k))
                lo.append(starts[np.append(0, gap + 1)])
                hi.append(starts[np.append(gap, len(starts) - 1)] + length)
        row, lo, hi = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (row, lo, hi))
        rows = pa.array(row)
        skip = np.asarray(table.column("skip"))[row]
        return pa.table({"anchor": table.column("anchor").take(rows), "piece": table.column("piece").take(rows), "lo": pa.array(lo + skip), "hi": pa.array(hi + skip)})

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        texts, spans = batch.column(1).cast(pa.large_binary()), batch.column(2)
        for text, own in zip(texts, spans, strict=True):
            text, own = text.as_py() or b"", own.as_py() or []
            rest, end, removed, n = [], 0, 0, 0
            for lo, hi in sorted(zip((x["lo"] for x in own), (x["hi"] for x in own), strict=True)):
                if lo > end or not n:
                    rest.append(text[end:lo])
                    n += 1
                    removed, end = removed + hi - lo, hi
                elif hi > end:
                    removed, end = removed + hi - end, hi
            rest.append(text[end:])
            kept = b"".join(rest)
            out.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )


def repeated_parts(units: DataFrame, length: int, shard_bytes: int, crowd_bytes: int, memory: int, salt: int = 0) -> DataFrame:
    """``k1, k2, lo, hi``: the parts of ``units`` (k1, k2, text) that strings cover which start somewhere else too.

    Where the pieces of one anchor are more than ``crowd_bytes``, they are units of their own, cut by other anchors.
    """
    found_in = stored(units.mapInArrow(_find_pieces(length, salt), _PIECE))
    # the columns of one row: all five are taken together
    one = [F.first(c).alias(c) for c in ("k1", "k2", "a", "b", "place")]
    kinds = stored(found_in.groupBy("anchor", "piece").agg(F.count("*").alias("n"), *one))
    width = F.col("b") - F.col("a") + length
    # pieces that occur more than once go as a whole
    twice = kinds.filter("n > 1").select("anchor", "piece", F.lit(0).cast("long").alias("lo"), width.alias("hi"))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    several = kinds.join(several, "anchor")
    one_each = units.dropDuplicates(["k1", "k2"])
    texts = several.join(one_each, ["k1", "k2"]).select(
        "anchor", "piece", "place", F.substring(F.col("text").cast("binary"), F.col("a") + 1, width).alias("bytes")
    )
    texts = stored(texts)
    # a repeated string starts in a part whose context is repeated too; the piece is cut to what such parts' strings cover
    contexts = stored(texts.mapInArrow(_contexts(length), "anchor long, piece long, part long, context long"))
    met = contexts.groupBy("anchor", "context").agg(F.min("piece").alias("p"), F.max("piece").alias("q")).filter("p != q")
    met = contexts.join(met.select("anchor", "context"), ["anchor", "context"])
    met = met.groupBy("anchor", "piece").agg(F.min("part").alias("near"), F.max("part").alias("far"))
    parts, size = _parts(length)
    farthest = F.when(F.col("far") < parts - 1, F.greatest(F.col("place") - (F.col("far") + 1) * size + 1, F.lit(0))).otherwise(0)
    nearest = F.least(F.col("place") - F.col("near") * size, F.octet_length("bytes") - length)
    texts = texts.join(met, ["anchor", "piece"]).withColumn("skip", farthest)
    texts = stored(texts.select("anchor", "piece", "skip", F.substring("bytes", F.col("skip") + 1, nearest - F.col("skip") + length).alias("bytes")))
    sizes = stored(texts.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("size")))
    total = sizes.filter(F.col("size") <= crowd_bytes).agg(F.sum("size")).first()[0] or 0
    crowds = sizes.filter(F.col("size") > crowd_bytes).select("anchor")
    found = twice
    if total:
        shards = -(-total // shard_bytes)
        few = texts.join(crowds, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        # dealt out by hand: shards are small in bytes, but each takes its time
        few = few.select("shard", "anchor", "piece", "skip", "bytes").repartition(shards, "shard").groupBy("shard")
        found = found.unionByName(few.applyInArrow(_sort_shard(length, memory), _FOUND))
    if not crowds.isEmpty():
        many = stored(texts.join(crowds, "anchor", "left_semi").selectExpr("anchor k1", "piece k2", "skip", "bytes text"))
        inner = repeated_parts(many.drop("skip"), length, shard_bytes, 2 * crowd_bytes, memory, salt + 1)  # so it ends
        inner = inner.join(many.drop("text"), ["k1", "k2"])
        found = found.unionByName(inner.selectExpr("k1 anchor", "k2 piece", "lo + skip lo", "hi + skip hi"))
    return stored(
        found_in.join(stored(found), ["anchor", "piece"]).select("k1", "k2", (F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi")).alias("hi"))
    )


def remove_repeats(
    docs: DataFrame, length: int = 400, shard_bytes: int = 1 << 22, crowd_bytes: int = 1 << 22, memory: int = 1 << 19,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text``: one row for each row of ``docs``.

    Every byte that is covered by a string of ``length`` bytes which also starts anywhere else, in this text or another,
    is removed; overlapping places count, and all is judged on the input. Null texts are empty; texts shorter
    than ``length`` stay as they are; repeated rows are texts of their own and so remove each other; null ids and extra
    columns make no difference; an empty table gives no rows. A text is read in blocks of 2 MiB, but must itself fit in a
    worker's memory. ``kept_text`` has replacement signs where a cut went through a character; the digest is that of the
    bytes themselves.

    ``shard_bytes`` is the size of a shard in the mean, ``crowd_bytes`` the most that the pieces of one anchor may hold to be
    sorted together, and ``memory`` the number of names that are sorted at once rather than by recursion, an eighth of the suffixes
    of a shard; the sorter's queues hold a fourth as many tuples before they go to disk, about an eighth of the suffixes that it sorts.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "text")
    spans = repeated_parts(rows.select("k1", "k2", "text"), length, shard_bytes, crowd_bytes, memory)
    # a text has as many spans as its own bytes allow
    by_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    marked = rows.join(by_text, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(
        _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
