"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance through BK-trees.

Fingerprints are cut into blocks. Two that differ in at most ``radius`` bits are equal in all but ``radius`` blocks at least, so for each choice
of blocks the fingerprints that agree there make a shard, and every link lies in some shard. A shard is a BK-tree: a child hangs under its
parent by its integer Hamming distance to it, and a search with a query at distance d of a node follows only the edges from d - radius to
d + radius. A shard beyond ``tree_size`` is several trees, and each of them is sent to every slice of the shard's queries.

Only components are asked for, so a search leaves out subtrees that are already wholly in the query's component: in a
dense group nearly all searches end at the root, and a tree emits a link for each merger, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from re import compile as pattern

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .session import Workspace, cut

WORDS, RADIUS, BITS = 3, 3, 64
TREE_SIZE = 1 << 16
_PART, _SPACE = 1 << 20, pattern(rb"[\x20\x09-\x0D]")
#: Pairs of query and node that a search holds at a time.
_FRONTIER = 1 << 21


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all shingles of a text, a part of the text at a time."""
    carried: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        gap = _SPACE.search(text, min(len(text), at + _PART))
        end = gap.start() if gap else len(text)
        found = carried + text[at:end].lower().split()
        at = end
        if len(found) >= words:
            some = True
            shingles = map(b" ".join, zip(*[found[k:] for k in range(words)], strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(found) - words + 1)
            found = found[len(found) - words + 1 :]
        carried = found
    if not some and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), 42)], np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits that are set in over half of the shingles' hashes; zero without words."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words):
        for k in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(((2 * counts > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64)) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long, for every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(read, f"`{id_col}` {kind}, fp long")


class Forest:
    """BK-trees over ``trees`` groups at a time; ``nodes`` are fingerprints, ``group`` the number of each one's tree (ascending)."""

    def __init__(self, nodes: np.ndarray, group: np.ndarray, trees: int):
        self.nodes = nodes
        n = len(nodes)
        self.root = np.full(trees, -1, np.int64)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.root[group[first]] = first
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.levels = [first]
        # everyone goes down together: of those that come to a node by the same distance, the first stays and the others go on under it
        left = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[group[left]]
        while len(left):
            key = at * (BITS + 1) + np.bitwise_count(nodes[left] ^ nodes[at])
            _, kept, which = np.unique(key, return_index=True, return_inverse=True)
            child = left[kept]
            parent[child], edge[child] = at[kept], key[kept] % (BITS + 1)
            self.levels.append(child)
            on = np.ones(len(left), bool)
            on[kept] = False
            left, at = left[on], child[which[on]]
        self.parent = parent
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.lexsort((edge[kids], parent[kids]))]
        self.kids, self.key = kids, parent[kids] * (BITS + 1) + edge[kids]

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """For each node the label that its whole subtree has, or -1."""
        found = label[: len(self.nodes)].copy()
        for level in reversed(self.levels[1:]):
            up = self.parent[level]
            found[up[(found[level] != found[up])]] = -1
        return found

    def near(self, query: np.ndarray, number: np.ndarray, group: np.ndarray, label: np.ndarray, whole: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query (by its number) and node within the radius whose labels differ."""
        node = self.root[group]
        todo = [(query[node >= 0], number[node >= 0], node[node >= 0])]
        while todo:
            query, number, node = todo.pop()
            if len(node) > _FRONTIER:
                half = len(node) // 2
                todo += [(query[half:], number[half:], node[half:]), (query[:half], number[:half], node[:half])]
                continue
            apart = np.bitwise_count(query ^ self.nodes[node]).astype(np.int64)
            hit = (apart <= radius) & (label[number] != label[node])
            if hit.any():
                yield number[hit], node[hit]
            low = np.searchsorted(self.key, node * (BITS + 1) + np.maximum(apart - radius, 0), "left")
            n = np.searchsorted(self.key, node * (BITS + 1) + np.minimum(apart + radius, BITS), "right") - low
            total = int(n.sum())
            if not total:
                continue
            of = np.repeat(np.arange(len(n)), n)
            child = self.kids[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + low[of]]
            open_ = whole[child] != label[number[of]]
            of, child = of[open_], child[open_]
            todo.append((query[of], number[of], child))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Labels after linking the rows ``a`` with ``b``, and which of the links merged something."""
    pairs, first = np.unique(np.stack([label[a], label[b]]), axis=1, return_index=True)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    used = []
    for k, x, y in zip(first.tolist(), *pairs.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            used.append(k)
    names, which = np.unique(label, return_inverse=True)
    return np.array([top(x) for x in names.tolist()], np.int64)[which], used


def shard_links(fp: np.ndarray, group: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one group, enough to connect all that lies within the radius.

    In a group where some rows ask, the others make its tree; in one where none does, every row is in the tree and asks.
    """
    trees = int(group[-1]) + 1 if len(group) else 0
    forest = Forest(fp[~asks], group[~asks], trees)
    served = np.zeros(trees, bool)
    served[group[asks]] = True
    inside, outside = np.flatnonzero(~served[group[~asks]]), np.flatnonzero(asks)
    every = np.concatenate([forest.nodes, fp[outside]])
    label = np.arange(len(every))
    number = np.concatenate([inside, np.arange(len(forest.nodes), len(every))])
    asked, group = every[number], np.concatenate([group[~asks][inside], group[outside]])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1024, -(-len(asked) // 32))
    whole = forest.uniform(label)
    for lo in range(0, len(asked), step):
        at = slice(lo, lo + step)
        changed = False
        for a, b in forest.near(asked[at], number[at], group[at], label, whole, radius):
            label, used = _merged(label, a, b)
            found.append((every[a[used]], every[b[used]]))
            changed = True
        if changed:
            whole = forest.uniform(label)
    none = np.zeros(0, np.uint64)
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (none, none)


def block_keys(fp: Column, blocks: int, radius: int = RADIUS) -> Column:
    """For each choice of ``blocks - radius`` blocks, the choice's number and the bits in them, as one decimal text."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    chosen = [sum(masks[k] for k in c) for c in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]
    return F.array(*[F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)])


def enough_blocks(n: int, radius: int = RADIUS, shard: int = 1 << 10) -> int:
    """The least number of blocks with which random fingerprints make shards of about ``shard`` in the mean."""
    blocks = radius + 1
    while n >> (BITS * (blocks - radius) // blocks) > shard and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def near_links(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, blocks: int | None = None) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` (repeats do no harm) that connect all within the radius.

    Trees hold ``tree_size`` fingerprints at most in the mean; a shard with more is dealt into pieces, and every two of its pieces meet as
    tree and queries.
    """
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks or enough_blocks(fps.count(), radius), radius)).alias("s")).select("fp", "s.*")
    large = keyed.groupBy("choice", "bits").count().filter(F.col("count") > 1)
    large = large.select("choice", "bits", F.ceil(F.col("count") / tree_size).alias("pieces"))
    met = keyed.join(large, ["choice", "bits"])
    own = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    met = met.select("choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.col("own") > F.col("other"), "fp").toDF("choice", "bits", "low", "high", "asks", "fp")
    keys = ["choice", "bits", "low", "high"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, *keys).sortWithinPartitions(*keys)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            cols = [rows.column(k).to_numpy() for k in range(4)]
            group = np.cumsum(np.r_[False, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            asks, fp = rows.column("asks").to_numpy().astype(bool), rows.column("fp").to_numpy().view(np.uint64)
            a, b = (x.view(np.int64) for x in shard_links(fp, group, asks, radius))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            # whole shards only: what may go on in the next batch stays behind
            cols = [batch.column(k).to_numpy() for k in range(4)]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) if batch.num_rows else []
            if rows > TREE_SIZE and held and batch.num_rows:
                last = held[-1]
                new = any(last.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(4))
                end = 0 if new else int(changes[0]) + 1 if len(changes) else None
                if end is not None:
                    yield linked([*held, batch.slice(0, end)])
                    held, rows, batch = [], 0, batch.slice(end)
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield linked(held)

    return met.mapInArrow(link, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, tree_size: int = TREE_SIZE, blocks: int | None = None) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row; fingerprints link when at most ``radius`` bits differ.

    ``component_id`` is the smallest id reachable. A null or empty text, and one without words, has the fingerprint zero, which links
    like any other; a text with fewer than ``words`` words is one shingle; long texts are read whole, a part at a time. Rows that repeat an id are rows of their
    own, and join what they link. Rows without an id link too, but give no id: a component of theirs alone is null. Other columns are
    not read. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    rows = work.stored(fingerprints(docs, id_col, text_col, words))
    least = work.stored(rows.groupBy("fp").agg(F.min(id_col).alias("id")))
    linked = connected_components(near_links(least, radius, tree_size, blocks)).withColumnsRenamed({"id": "fp", "component": "top"})
    linked = work.stored(linked.join(least, "fp"))
    lowest = linked.groupBy("top").agg(F.min("id").alias("low"))
    known = least.join(linked.join(lowest, "top").select("fp", "low"), "fp", "left").select("fp", F.coalesce("low", "id").alias("component_id"))
    found = cut(rows.join(known, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
    work.drop()
    return found
