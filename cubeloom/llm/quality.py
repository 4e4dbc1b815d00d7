"""Quality scores: random-indexing word vectors pooled per document, and a small calibrated network.

Every word has a fixed sparse index vector of a few +1 and -1; its word vector is the sum of the index
vectors around it in all texts, labelled or not. A document is the mean of its word vectors, their spread, and how they go along
with their neighbours; two numpy layers turn those into a probability whose temperature is fitted on rows kept out of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACE, Slice, slices

#: Kinds of bytes: white space, signs, letters and digits (all bytes beyond ASCII count as letters).
_KIND = np.full(256, 2, np.int8)
_KIND[:128] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2
_KIND[SPACE] = 0
#: Words share 2**BITS vectors by hash, and each vector has so many places, of which the index fills a few.
BITS, PLACES, FILLED, REACH = 15, 48, 4, 2
BUCKETS = 1 << BITS
WIDTH = 3 * PLACES + 2


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Owner and vector number of each run of letters or of signs."""
    if not len(s.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[s.data]
    cuts = s.offsets[1:-1]
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[cuts] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    number = (s.hashes(starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.searchsorted(s.offsets, starts, "right") - 1, number


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    places = np.stack([rng.permutation(PLACES)[:FILLED] for _ in range(BUCKETS)])
    return places, rng.choice([-1.0, 1.0], (BUCKETS, FILLED))


def context_sums(s: Slice, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For each word, the sum of the index vectors within its reach."""
    owner, word = tokens(s)
    total = np.zeros(BUCKETS * PLACES)
    for step in range(1, REACH + 1):
        same = owner[step:] == owner[:-step]
        for one, two in ((word[step:][same], word[:-step][same]), (word[:-step][same], word[step:][same])):
            at = (one[:, None] * PLACES + places[two]).ravel()
            total += np.bincount(at, signs[two].ravel(), BUCKETS * PLACES)
    return total.reshape(BUCKETS, PLACES)


def pooled(s: Slice, vectors: np.ndarray) -> np.ndarray:
    """Mean and root mean square of each text's word vectors, the mean product of neighbours, the length of the mean, and the
    log of the number of words."""
    owner, word = tokens(s)
    out = np.zeros((s.n, WIDTH), np.float32)
    count = np.bincount(owner, minlength=s.n)
    full = np.flatnonzero(count)
    if len(full):
        first = np.searchsorted(owner, full)
        rows = vectors[word]
        n = count[full][:, None]
        out[full, :PLACES] = np.add.reduceat(rows, first) / n
        pairs = np.zeros_like(rows)
        pairs[1:] = rows[1:] * rows[:-1]
        pairs[first] = 0  # the word before stands in another text
        out[full, 2 * PLACES : 3 * PLACES] = np.add.reduceat(pairs, first) / n
        rows *= rows
        out[full, PLACES : 2 * PLACES] = np.sqrt(np.add.reduceat(rows, first) / n)
        out[full, -2] = np.linalg.norm(out[full, :PLACES], axis=1)
        out[full, -1] = np.log1p(count[full])
    return out


@dataclass
class Network:
    """Two layers over standardised features; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the log loss; a fifth of the rows is kept out and gives the temperature."""
    rng = np.random.default_rng(seed)
    prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    width = WIDTH
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), np.log(prior / (1 - prior)))
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return net  # nothing to tell apart: the share of label 1
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    net.mean, net.scale = x[used].mean(0), x[used].std(0) + 1e-4
    net.w1 = rng.normal(0, 1 / np.sqrt(width), (width, hidden))
    net.w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    z = (x - net.mean) / net.scale
    step = 0
    for _ in range(epochs):
        used = rng.permutation(used)
        for lo in range(0, len(used), 128):
            rows = used[lo : lo + 128]
            inner = np.tanh(z[rows] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(inner @ values[2] + values[3][0], -60, 60))) - y[rows]) / len(rows)
            back = error[:, None] * values[2] * (1 - inner * inner)
            slopes = [z[rows].T @ back + 1e-4 * values[0], back.sum(0), inner.T @ error + 1e-4 * values[2], np.array([error.sum()])]
            step += 1
            for v, m, r, g in zip(values, first, second, slopes, strict=True):
                m += 0.1 * (g - m)
                r += 0.001 * (g * g - r)
                v -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(r / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    logits, truth = net.logits(x[held]), y[held]

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, -np.where(truth == 1, 1, -1) * logits / t)))

    low, high = np.log(0.2), np.log(20.0)
    for _ in range(60):  # golden section on the log of the temperature
        a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    net.temperature = float(np.exp((low + high) / 2))
    return net


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def summed_contexts(texts: DataFrame, places: np.ndarray, signs: np.ndarray, parts: int = 64, together: int = 64) -> np.ndarray:
    """The sums of context_sums() over all texts of the only column, as one matrix.

    A task sends its sums in ``parts`` blocks of words. They are added up in steps: of each block, those of ``together`` neighbouring tasks, of as many of these groups, and
    so on, so that no task reads more than ``together`` blocks of 98 KB, however many tasks there are.
    """
    rows_each = BUCKETS // parts

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, PLACES))
        for batch in batches:
            for s in slices(batch.column(0)):
                total += context_sums(s, places, signs)
        lane = TaskContext.get().partitionId() // together
        for part, block in enumerate(total.reshape(parts, rows_each, PLACES)):
            used = np.flatnonzero(block.any(axis=1)).astype(np.int32)  # most tasks see few of the words
            if len(used):
                yield packed(part, lane, used, block[used])

    def packed(part: int, lane: int, used: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        values = {"part": pa.array([part], pa.int32()), "lane": pa.array([lane], pa.int32()), "words": pa.array([used.tobytes()], pa.binary()), "m": pa.array([block.astype(np.int64).tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(values)

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros((rows_each, PLACES), np.int64)  # sums of whole numbers: exact in any order
        for words, m in zip(table.column("words"), table.column("m"), strict=True):
            total[np.frombuffer(words.as_py(), np.int32)] += np.frombuffer(m.as_py(), np.int64).reshape(-1, PLACES)
        used = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        part, lane = table.column("part")[0].as_py(), table.column("lane")[0].as_py()
        return pa.Table.from_batches([packed(part, lane // together, used, total[used])])

    kind = "part int, lane int, words binary, m binary"
    found, tasks = texts.mapInArrow(sums, kind), max(1, texts.rdd.getNumPartitions())
    while True:
        found, tasks = found.groupBy("part", "lane").applyInArrow(added, kind), -(-tasks // together)
        if tasks == 1:
            break
    vectors = np.zeros((BUCKETS, PLACES))
    for row in found.collect():  # one matrix in all
        vectors[row.part * rows_each + np.frombuffer(row.words, np.int32)] += np.frombuffer(row.m, np.int64).reshape(-1, PLACES)
    return vectors


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 12_000, seed: int = 3) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts of ``docs``, and a network fitted on at most ``sample`` labelled rows, spread by hash, none
    of them held out. The vectors need no labels; they do not depend on how ``docs`` is partitioned.

    Null labels, null ids and labels of documents that aren't there are left out; of several labels of an id the largest
    counts, and of several texts of an id the first in order. Null texts are empty. Without labels of both kinds the network
    gives the share of label 1 to every text, without any a half. Other columns aren't read."""
    chosen = (
        labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    )
    # the sample has a fixed number of rows, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))  # a row for each id
    places, signs = index_vectors(seed)

    vectors = summed_contexts(docs.select("text"), places, signs)
    # a word's own index vector stays in it, so that words without neighbours differ too
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors -= vectors.mean(axis=0)  # what all words have in common tells nothing
    np.add.at(vectors, (np.arange(BUCKETS)[:, None], places), signs / np.sqrt(FILLED))
    vectors = vectors.astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                rows = [r.tobytes() for r in pooled(s, vectors)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s.lo, s.n) for c in (0, 2)), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    rows = texts.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), WIDTH)
    return vectors, train_network(x.astype(float), np.array([r.quality for r in rows], float))


def quality_scores(
    docs: DataFrame, model: tuple[np.ndarray, Network], least: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, one row for each row of ``docs``.

    Only the text goes into a score. Null and empty texts have the score of an empty document; null ids are not
    held out; repeated rows and extra columns make no difference; an empty table gives no rows.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = spread.value
        for batch in batches:
            for s in slices(batch.column(1)):
                found = net.scores(pooled(s, vectors))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, s.n), pa.array(found, pa.float64()), pa.array((found >= least).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    rows = rows.mapInArrow(score, "doc_id long, score double, predicted int")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
