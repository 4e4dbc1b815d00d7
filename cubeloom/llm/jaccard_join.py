"""Similarity join of documents on their word shingles, by vertical partitions of the shingles' global order.

The global order has the rare shingles first, by hash, and after them the frequent ones of the corpus, rarest first. It is
cut into fragments, and a document's set into segments, one for each fragment. Two sets of a similarity of at least t
differ in few shingles, and with more fragments than that, at least one segment is the same in both: that makes
candidates, fragment by fragment. How many fragments it takes depends on the sizes, so sizes fall into classes whose
bounds grow by 1/t; a set is cut as its own class asks and as the class below asks, where it can be the larger of
a pair. Frequent shingles are left out of these segments, which keeps common passages from making candidates; sets of which
too many segments are empty, and very small ones, also meet by the first shingles in the order (the prefix that two
similar sets must share).

Candidates that differ in too many places of a bit sketch are out for certain. For the others the segments meet
fragment by fragment; the partial overlaps are counted where they meet, and summed for each pair, exactly.

Not every candidate has to be looked at, as only components are asked for. The documents that share a segment make a
group. In each group, one member is held against the others, and only where that leaves several components, members of
different ones meet. Large groups are first cut up again: in an order of the group's own, the shingles that its hub
lacks come first, the members deal themselves out by the first shingles in that order, and only what shares one of them
meets, if the places of the shingle leave enough to share. Copies that have wandered off from a common origin, each in its
own way, don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .session import Workspace, few, free_name, release_caches, stored
from .words import Slice, mix, slices, windows

WORDS = 5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Sets smaller than this are compared by their first shingles, as fragments would often be empty.
_SMALL = 25
#: Bits of a shingle's hash; the next bit is set in the keys of frequent ones.
_BITS = 51
_HIGH = np.uint64(1 << _BITS)
#: Rows of signatures, or shingles, that a task sorts together.
_BLOCK = 1 << 19
#: So many ids are sent to every executor, 16 MB; texts meet more of them in a shuffle.
_FEW_IDS = 2_000_000
#: Shingles with at least this share of all occurrences are frequent; so many there are at most.
_FREQUENT = 1 << 20
#: Groups of more members are cut up before members of different components meet.
_LARGE = 16


def shingles(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash (of _BITS bits) of each text's distinct shingles, in order."""
    starts, ends, owner = s.words()
    word = s.hashes(starts, ends)
    at, window = windows(word, owner, WORDS)
    count = np.bincount(owner, minlength=s.n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    short = np.flatnonzero((count > 0) & (count < WORDS))
    whole = [mix(np.array([sum(int(word[first[k] + j]) * (2 * j + 3) for j in range(count[k])) + int(count[k]) & (1 << 64) - 1], np.uint64))[0] for k in short]
    texts = np.concatenate([owner[at], short]).astype(np.uint64)
    found = np.concatenate([window, np.array(whole, np.uint64)])
    # number and hash in one word, so that one plain sort does
    both = np.sort((texts << np.uint64(52)) | (found >> np.uint64(64 - _BITS)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return (both >> np.uint64(52)).astype(np.int64), both & np.uint64(_HIGH - np.uint64(1))


class Order:
    """The global order: frequent shingles come last, rarest first."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.frequent = frequent[order]
        rank = np.empty(len(frequent), np.uint64)
        rank[np.lexsort((self.frequent, counts[order]))] = np.arange(len(frequent), dtype=np.uint64)
        self.keys = rank | _HIGH

    def split(self, texts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text numbers and keys of the rare shingles, and of the frequent ones, each in order."""
        if not len(self.frequent):
            return texts, found, texts[:0], found[:0]
        at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
        common = self.frequent[at] == found
        if not common.any():
            return texts, found, texts[:0], found[:0]
        t, keys = texts[common], self.keys[at[common]]
        order = np.lexsort((keys, t))
        return texts[~common], found[~common], t[order], keys[order]


def set_keys(texts: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The size and a 128-bit key of each text's set."""
    size = np.bincount(texts, minlength=n)
    full = np.flatnonzero(size)
    keys = np.zeros((2, n), np.uint64)
    if len(full):
        first = np.searchsorted(texts, full)
        for k, salt in enumerate((_A, _B)):
            keys[k][full] = np.add.reduceat(mix(found ^ salt), first)
    return size, keys[0], keys[1]


class Levels:
    """The size classes for a similarity of num/den, and into how many fragments each is cut."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] <= largest + 1:
            bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * den // num + 1))
        self.bounds = np.array(bounds)
        self.fragments, self.spare = [], []
        for low, high in zip(bounds, bounds[1:], strict=False):
            a = high - 1
            b = a * den // num  # most shingles in which two sets of the class and the next can differ:
            differ = (a + b) * (den - num) // (den + num)
            spare = max(1, -(-45 * differ // 1000))  # fragments that may be empty in both
            self.fragments.append(0 if low < _SMALL else differ + 1 + spare)
            self.spare.append(spare)

    def signatures(self, texts: np.ndarray, found: np.ndarray, n: int, order: Order) -> tuple[np.ndarray, np.ndarray]:
        """Signature and text number: two sets that are similar enough have one in common."""
        size = np.bincount(texts, minlength=n)
        own = np.searchsorted(self.bounds, size, "right") - 1
        fragments, spare = np.array(self.fragments), np.array(self.spare)
        rare_texts, rare, common_texts, common = order.split(texts, found)
        prefix = np.zeros(n, bool)
        signs, owners = [], []
        for back in (0, 1):
            level = np.maximum(own - back, 0)
            cut_in = np.where((size > 0) & (own >= back), fragments[level], 0)
            prefix |= (size > 0) & (own >= back) & (cut_in == 0)
            take = cut_in[rare_texts] > 0
            t, h = rare_texts[take], rare[take]
            at = np.zeros(0, np.int64)
            if len(t):
                part = (h >> np.uint64(20)) * cut_in[t].astype(np.uint64) >> np.uint64(_BITS - 20)
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1])
                at = np.flatnonzero(new)
                total = np.add.reduceat(mix(h ^ _A), at)
                count = np.diff(np.append(at, len(t))).astype(np.uint64)
                place = part[at] * _B + level[t[at]].astype(np.uint64) * _C
                signs.append(mix(total + mix(place + count)))
                owners.append(t[at])
            # two sets have no more segments empty in both than either has: with enough to spare, one of them suffices
            empty = cut_in - np.bincount(t[at] if len(t) else t, minlength=n)
            prefix |= (cut_in > 0) & (empty > spare[level])
        if prefix.any():
            held = np.bincount(rare_texts, minlength=n)
            lead = np.where(prefix, size + (-size * self.num // self.den) + 1, 0)
            for t, h, before, count in ((rare_texts, rare, np.zeros(n, np.int64), held), (common_texts, common, held, size - held)):
                first = np.concatenate([[0], np.cumsum(count)[:-1]])
                take = np.arange(len(t)) - first[t] + before[t] < lead[t]
                signs.append(mix(h[take] ^ _C))
                owners.append(t[take])
        if not signs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(signs), np.concatenate(owners)


def sketches(texts: np.ndarray, found: np.ndarray, n: int) -> list[bytes]:
    """For each set, which of its hash ranges hold shingles; two to four ranges a shingle, 256 at least."""
    size = np.bincount(texts, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])
    out = []
    for k in range(n):
        bits = max(8, int(2 * size[k]).bit_length())
        marks = np.zeros(1 << bits, bool)
        marks[found[first[k] : first[k + 1]] >> np.uint64(_BITS - bits)] = True
        out.append(np.packbits(marks).tobytes())
    return out


def certain_differences(a: bytes, b: bytes) -> int:
    """A number of shingles that two sets at least differ in, by their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        marks = np.unpackbits(y).reshape(8 * len(x), -1)
        y = np.packbits(marks.any(axis=1))
    return int(np.bitwise_count(x ^ y).sum())


def _once(rows: np.ndarray, one: np.ndarray, two: np.ndarray, n: int, seen: set) -> np.ndarray:
    """Which of the rows hold a set that hasn't been seen."""
    once = np.zeros(n, bool)
    for k in rows:
        key = (one[k], two[k])
        if key not in seen:
            seen.add(key)
            once[k] = True
    return once


_SETS = "counted boolean, doc_id long, n_shingles long, k1 long, k2 long, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; and, marked as counted, the shingles that have the share of a frequent one in a block of texts (k1:
    the shingle, n_shingles: how often), equal sets counted once."""
    release_caches()
    names = ["counted", "doc_id", "n_shingles", "k1", "k2", "sketch"]

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        shingle, n = np.unique(np.concatenate(parts), return_counts=True)
        keep = (n > 2) & (n * _FREQUENT >= n.sum())
        shingle, n = pa.array(shingle[keep].view(np.int64)), pa.array(n[keep])
        nothing = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), bool)), nothing, n, shingle, nothing, pa.nulls(len(n), pa.binary())], names)

    parts, held, seen = [], 0, set()
    for batch in batches:
        for s in slices(batch.column(1), lower=True):
            texts, found = shingles(s)
            size, one, two = set_keys(texts, found, s.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(s.n, bool)), batch.column(0).slice(s.lo, s.n), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sketches(texts, found, s.n), pa.binary())],
                names,
            )
            once = _once(np.flatnonzero(size), one, two, s.n, seen)
            parts.append(found[once[texts]])
            held += len(parts[-1])
            if held > 4 * _BLOCK:
                yield counted(parts)
                parts, held, seen = [], 0, set()
    if held:
        yield counted(parts)


def frequent_shingles(counted: DataFrame) -> Order:
    """The order that the counts of _sets() give: at most _FREQUENT shingles are frequent, by the share that each has."""
    counts = counted.groupBy("k1").agg(F.sum("n_shingles").alias("n"))
    total = counted.agg(F.sum("n_shingles")).first()[0] or 0
    rows = counts.filter(F.col("n") * _FREQUENT >= total).toPandas()
    return Order(rows["k1"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def _plane(x: np.ndarray) -> bytes:
    """Columns of bytes: the high bytes of neighbours are alike and shrink to nothing on the way."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplane(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _heads(sign: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by sign: the number of rows of each row's group, and which of them has the least key."""
    at = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
    count = np.diff(np.append(at, len(sign)))
    least = np.flatnonzero(key == np.repeat(np.minimum.reduceat(key, at), count))
    return np.repeat(count, count), np.repeat(least[np.searchsorted(least, at)], count)


_ROWS = (("sign", np.uint64), ("key", np.uint64), ("n", np.uint32))


def _groups(levels: Levels, buckets: int, order):
    """The signatures of a task's sets, sorted a block at a time and sent to buckets as packed columns. Of a block's rows
    with one signature, the head goes to the signature's bucket; the others know it and go anywhere."""

    def packed(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        by_sign = np.argsort(columns[0], kind="stable")
        columns = [c[by_sign] for c in columns]
        sign, key, _ = columns
        count, head = _heads(sign, key)
        own = np.arange(len(sign))
        for known in (False, True):
            rows = np.flatnonzero((head != own) == known)
            if not len(rows):
                continue
            at = mix(sign[rows] ^ key[rows]) if known else sign[rows]
            bucket = ((at >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            if known:
                by_bucket = np.argsort(bucket, kind="stable")
                rows, bucket = rows[by_bucket], bucket[by_bucket]
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            spans = list(zip(edges, np.append(edges[1:], len(rows)), strict=True))
            cut = lambda x: pa.array([_plane(x[a:b]) for a, b in spans], pa.binary())  # noqa: E731, B023
            values = {"bucket": pa.array(bucket[edges].astype(np.int32)), "known": pa.array([known] * len(spans))}
            values |= {name: cut(c[rows]) for (name, _), c in zip(_ROWS, columns, strict=True)}
            # of rows that know their head, which it is; of heads, whether others know them
            heads = [cut(c[head[rows]]) for c in columns[1:]] if known else [cut((count[rows] > 1).astype(np.uint8)), pa.nulls(len(spans), pa.binary())]
            values |= {f"head_{name}": c for (name, _), c in zip(_ROWS[1:], heads, strict=True)}
            yield pa.RecordBatch.from_pydict(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        parts, held, seen = [], 0, set()
        for batch in batches:
            for s in slices(batch.column(0), lower=True):
                texts, found = shingles(s)
                size, one, two = set_keys(texts, found, s.n)
                take = _once(np.flatnonzero(size), one, two, s.n, seen)[texts]
                sign, t = levels.signatures(texts[take], found[take], s.n, order.value)
                parts.append((sign, one[t], size[t].astype(np.uint32)))
                held += len(t)
                if held >= _BLOCK:
                    yield from packed([np.concatenate(c) for c in zip(*parts, strict=True)])
                    parts, held, seen = [], 0, set()
        if held:
            yield from packed([np.concatenate(c) for c in zip(*parts, strict=True)])

    return run


_PACKED = "bucket int, known boolean, sign binary, key binary, n binary, head_key binary, head_n binary"
_MEMBERS = "sign long, key long, n long, head_key long, head_n long, members long"


def _shared(num: int, den: int):
    """Of one bucket, the rows whose signature other sets have too, each with the head of its group. ``members`` is the size of
    the group, very large where some of it isn't here. The sizes of a group of two must allow a link."""

    def run(table: pa.Table) -> pa.Table:
        release_caches()
        out, here, more = [], [], []
        for row in table.to_pylist():
            columns = [_unplane(row[name], kind) for name, kind in _ROWS]
            if row["known"]:
                heads = [_unplane(row[f"head_{name}"], kind) for name, kind in _ROWS[1:]]
                out.append([*columns, *heads, np.full(len(columns[0]), 1 << 30)])
            else:
                here.append(columns)
                more.append(_unplane(row["head_key"], np.uint8).astype(bool))
        del table
        if here:
            sign, key, n = (np.concatenate(c) for c in zip(*here, strict=True))
            also = np.concatenate(more)
            by_sign = np.lexsort((key, sign))
            sign, key, n, also = (c[by_sign] for c in (sign, key, n, also))
            # equal sets of several blocks are one
            new = np.append(True, (sign[1:] != sign[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1]))
            at = np.flatnonzero(new)
            also = np.logical_or.reduceat(also, at)
            sign, key, n = (c[at] for c in (sign, key, n))
            count, head = _heads(sign, key)
            group = np.cumsum(np.append(0, sign[1:] != sign[:-1]))
            beyond = np.bincount(group, also)[group] > 0
            n_a, n_b = n.astype(np.int64), n[head].astype(np.int64)
            fits = (n_a * den >= n_b * num) & (n_b * den >= n_a * num) & (head != np.arange(len(head)))
            keep = beyond | (count > 2) | ((count == 2) & (np.bincount(group, fits)[group] > 0))
            out.append([c[keep] for c in (sign, key, n, key[head], n[head], np.where(beyond, 1 << 30, count))])
        columns = [np.concatenate(c).astype(np.uint64).view(np.int64) for c in zip(*out, strict=True)]
        names = [part.split()[0] for part in _MEMBERS.split(", ")]
        return pa.table(dict(zip(names, (pa.array(c) for c in columns), strict=True)))

    return run


def _may_link(n_a, place_a, n_b, place_b, num: int, den: int):
    """Whether two sets whose first common shingle has these places can be similar enough."""
    a, b = (n_a - place_a) * (num + den), (n_b - place_b) * (num + den)
    need = (n_a + n_b) * num
    return (a >= need) & (b >= need)


def _segments(fragments: int, order):
    """Segments of those of the texts that hold the set of the given key: the keys that each fragment of the order has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            for s in slices(batch.column(1), lower=True):
                texts, found = shingles(s)
                asked = set_keys(texts, found, s.n)[1].view(np.int64) == batch.column(2).slice(s.lo, s.n).to_numpy()
                rare_t, rare, common_t, common = order.value.split(texts[asked[texts]], found[asked[texts]])
                text, keys = np.concatenate([rare_t, common_t]), np.concatenate([rare, common])
                part = np.minimum(keys * np.uint64(fragments - 1) >> np.uint64(_BITS), np.uint64(fragments - 1)).astype(np.int64)
                place = text * fragments + part
                by_place = np.argsort(place, kind="stable")
                place, keys = place[by_place], keys[by_place]
                at = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(keys)).astype(np.int32)), pa.array(keys.view(np.int64)))
                rows = pa.array(place[at] // fragments + s.lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array((place[at] % fragments).astype(np.int32)), lists], ["id", "fragment", "keys"])

    return run


def jaccard_components(
    docs: DataFrame, threshold: tuple[int, int] = (4, 5), fragments: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row for each row of ``docs``, linked from a similarity of ``threshold`` on.

    A-Z are lower-cased; words lie between ASCII white space; a set holds the distinct 5-word shingles, with fewer
    words the whole sequence. ``component_id`` is the smallest id reachable by links. Null and wordless texts
    have the empty set, which links with nothing. Rows without an id get a null component where no row with an id
    has the same set. Ids name documents: rows that repeat an id are one document, all of whose texts lie in one component (a text without words
    aside, which stays by itself). Other columns are not read; an empty table gives no rows. A text is read whole, so the longest must fit in a worker's memory, some twenty bytes
    for each of its own. Shingles are told apart by hashes of 51 bits, equal sets by 128.
    """
    num, den = threshold
    work = Workspace(docs.sparkSession)  # for what the result doesn't need
    table = work.stored
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    both = table(rows.mapInArrow(_sets, _SETS))
    sets = both.filter("not counted").drop("counted")
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(both.filter("counted")))
    # equal sets are one, with a number of its own
    equal = table(sets.filter("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("low")).withColumn("rep", F.monotonically_increasing_id()))
    few_equal = few(equal)
    members = stored(sets.drop("sketch").join(few_equal, ["n_shingles", "k1", "k2"], "left").select("doc_id", "n_shingles", "rep", "low"))
    stands = few_equal.filter("low is not null").withColumnRenamed("low", "doc_id")
    known = sets.join(few(stands, equal), ["doc_id", "n_shingles", "k1", "k2"]).selectExpr("rep id", "n_shingles n", "k1 key", "sketch", "doc_id low")
    known = table(known.dropDuplicates(["id"]))  # rows that repeat id and set
    # an id with several texts is one document: its sets are linked, whatever they hold
    several = members.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last")
    several = table(several)
    total = members.agg(F.sum("n_shingles").alias("all"), F.max("n_shingles").alias("most")).first()
    levels = Levels(num, den, total["most"] or 0)
    buckets = max(16, -(-(total["all"] or 0) // 1_000_000))

    blocks = rows.select("text").mapInArrow(_groups(levels, buckets, order), _PACKED)
    shared = table(blocks.groupBy("bucket").applyInArrow(_shared(num, den), _MEMBERS))

    # the component of each id that has links, of which None are known yet
    labels = None
    if not several.isEmpty():
        labels = connected_components(members.selectExpr("doc_id", "rep b").join(few(several), "doc_id").select("a", "b"))

    def link(candidates: DataFrame) -> None:
        """Adds those pairs of ids ``a, b`` that are similar enough to the links: the components they connect are joined."""
        nonlocal labels
        candidates = table(candidates)
        if labels is not None and candidates.isEmpty():
            return
        one, two = (known.selectExpr(f"id {x}", f"n n_{x}", f"sketch sketch_{x}") for x in "ab")
        sketched = one.join(few(candidates), "a").join(two, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        likely = table(sketched.mapInArrow(_not_ruled_out(num, den), "a long, b long, n_a long, n_b long"))
        if labels is not None and likely.isEmpty():
            return
        held = segments(likely.select(F.explode(F.array("a", "b")).alias("id")), fragments)
        meet = held.selectExpr("id a", "fragment", "keys keys_a").join(few(likely.select("a", "b")), "a")
        meet = meet.join(held.selectExpr("id b", "fragment", "keys keys_b"), ["b", "fragment"])
        partial = meet.select("a", "b", "fragment", F.size(F.array_intersect("keys_a", "keys_b")).cast("long").alias("overlap"))
        summed = partial.groupBy("a", "b").agg(F.sum("overlap").alias("o"))
        found = summed.join(few(likely), ["a", "b"]).filter(f"o * {den} >= (n_a + n_b - o) * {num}").select("a", "b")
        if labels is None:
            labels = connected_components(found)
            return
        few_labels = few(labels)
        for x in "ab":
            found = found.join(few_labels.selectExpr(f"id {x}", f"component component_{x}"), x, "left")
        found = table(found.selectExpr("coalesce(component_a, a) a", "coalesce(component_b, b) b").filter("a != b"))
        if found.isEmpty():
            return
        above = connected_components(found)
        few_above = few(above)
        new = above.join(few_labels.select("id"), "id", "left_anti")
        old = labels.join(few_above.selectExpr("id component", "component top"), "component", "left").selectExpr("id", "coalesce(top, component) component")
        labels = table(old.unionByName(new))

    def segments(ids: DataFrame, parts: int) -> DataFrame:
        """For each of the ids, which may repeat, what each fragment of the order has of its set."""
        ids = table(known.selectExpr("id", "low doc_id", "key").join(few(ids), "id", "left_semi"))
        sent = F.broadcast(ids) if ids.count() <= _FEW_IDS else ids
        texts = rows.join(sent, "doc_id").select("id", "text", "key")
        return table(texts.mapInArrow(_segments(parts, order), "id long, fragment int, keys array<long>").groupBy("id", "fragment").agg(F.first("keys").alias("keys")))

    def pairs(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # the head of each group against its other members
    head = shared.filter(f"(key != head_key or n != head_n) and n * {den} >= head_n * {num} and head_n * {den} >= n * {num}")
    head = head.select("key", "n", "head_key", "head_n").distinct()
    ids = few(known.select("id", "n", "key"))
    head = head.join(ids, ["key", "n"]).join(ids.selectExpr("id hub", "key head_key", "n head_n"), ["head_key", "head_n"])
    link(head.select(*pairs("id", "hub")).filter("a < b").distinct())

    def mixed(grouped: DataFrame, by: list[str]) -> DataFrame:
        """The groups that still hold several components: their members, with component and size."""
        named = grouped.join(few(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
        seen = named.groupBy(*by).agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        return table(named.join(few(table(seen.filter("low < high").drop("low", "high"))), by))

    def across(grouped: DataFrame, by: list[str]) -> DataFrame:
        """Pairs of members that may be linked, and would link two components."""
        sides = [grouped.select(*by, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "place"))) for x in "ab"]
        met = sides[0].join(few(sides[1], grouped), by).filter("id_a < id_b and component_a != component_b")
        met = met.filter(_may_link(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"), num, den))
        return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()

    joined = shared.filter("members > 2").join(ids, ["key", "n"]).select("sign", "id", "n", F.lit(0).alias("place")).distinct()
    open_ = mixed(table(joined), ["sign"])
    link(across(open_.filter(F.col("size") <= _LARGE), ["sign"]))

    open_ = mixed(open_.filter(F.col("size") > _LARGE).select("sign", "id", "n"), ["sign"])
    if not open_.isEmpty():
        # the hub of a group is the member that is in most groups; in an order of the group's own, what the hub lacks comes first
        often = open_.groupBy("id").agg(F.count("*").alias("groups"))
        hubs = open_.join(few(often, open_), "id").groupBy("sign").agg(F.max(F.struct("groups", "id")).alias("hub"))
        owned = table(open_.join(few(hubs.select("sign", F.col("hub.id").alias("hub")), open_), "sign").select("hub", "id", "n").distinct())
        whole = segments(owned.select("id").unionByName(owned.select(F.col("hub").alias("id"))), 2)
        whole = table(whole.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("keys"))).alias("keys")))
        own = owned.join(whole, "id").join(whole.selectExpr("id hub", "keys hub_keys"), "hub")
        first = F.concat(F.array_except("keys", "hub_keys"), F.array_intersect("keys", "hub_keys"))
        # with no member smaller than `least`, the first shingle in common is one of the first (den n - num least) / (num + den) + 1
        own = own.join(few(owned.groupBy("hub").agg(F.min("n").alias("least")), owned), "hub")
        least = F.expr(f"greatest(least, (n * {num} + {den - 1}) div {den})")
        lead = F.floor((F.col("n") * den - least * num) / (num + den) + 1).cast("int")
        dealt = table(own.select("hub", "id", "n", F.posexplode(F.slice(first, F.lit(1), lead)).alias("place", "sign")))
        for last in (False, True):
            open_ = mixed(dealt, ["hub", "sign"])
            if last:
                found = across(open_, ["hub", "sign"])
            else:  # first, the member in which the shingle comes earliest
                leads = open_.groupBy("hub", "sign").agg(F.min(F.struct("place", "id", "n", "component")).alias("h"))
                met = open_.join(few(leads, open_), ["hub", "sign"]).filter("id != h.id and component != h.component")
                met = met.filter(_may_link(F.col("n"), F.col("place"), F.col("h.n"), F.col("h.place"), num, den))
                found = met.select(*pairs("id", "h.id")).distinct()
            link(found)
    lows = table(known.select("id", "low").join(few(labels), "id"))
    lowest = lows.groupBy("component").agg(F.min("low").alias("lowest"))
    labels = stored(lows.join(few(lowest, lows), "component").selectExpr("id rep", "lowest component"))
    work.drop()
    return members.join(few(labels), "rep", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "low")).alias("component_id"),
    )


def _not_ruled_out(num: int, den: int):
    """Pairs whose sketches differ in no more places than similar sets of their sizes can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            most = sizes * (den - num) // (den + num)
            keep = [certain_differences(a.as_py(), b.as_py()) <= m for a, b, m in zip(batch.column(4), batch.column(5), most, strict=True)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return run


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: that of the smallest id.

    Rows without an id stay, as do rows without a word; rows that repeat the id of one that stays stay with it. An empty
    table gives no rows.
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    own = free_name(docs, "dropped_id")
    dropped = found.filter("doc_id != component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped[own], "left_anti")
