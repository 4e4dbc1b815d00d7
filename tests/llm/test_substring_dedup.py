"""Repeated strings against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cubeloom.llm.substring_dedup import PARTS, _contexts, pieces, remove_repeats
from cubeloom.llm.suffix_sort import DiskQueue, repeated_starts, suffix_order
from cubeloom.llm.words import slices


def brute(rows, length):
    texts = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for k, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        n_spans = int(((gone == 1) & (np.append(0, gone[:-1]) == 0)).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((k, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    out = remove_repeats(df, **options).drop("kept_text").collect()
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("crowd_bytes", [1 << 23, 1500])
def test_equals_count_of_all_strings(spark, crowd_bytes):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh éß\n") for _ in range(n))
    passages = [make(n) for n in (395, 410, 600, 1500)]
    rows = []
    for k in range(60):
        text = make(rng.randrange(0, 900))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 100)
            text += p[a : len(p) - rng.randrange(0, 100)] + make(rng.randrange(0, 300))
        rows.append((k, text))
    rows += [(100, rows[7][1]), (101, "xyz " * 500), (102, None), (103, ""), (104, "q" * 401), (104, "q" * 401), (105, "r" * 400), (None, "xyz " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, crowd_bytes=crowd_bytes, shard_bytes=20_000, memory=1000) == brute(rows, 400)


def test_many_pieces_of_one_anchor(spark):
    """Copies of one text, each with changes of its own, so that its anchors have hundreds of different pieces."""
    rng = random.Random(4)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(150)]
    rows = []
    for k in range(250):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, crowd_bytes=20_000, shard_bytes=10_000, memory=1000) == brute(rows, 400)


def test_opposite_letters_do_not_repeat(spark):
    """Texts of a pair of letters in the Thue-Morse order and in its complement, which sums modulo 2**64 can't tell apart."""
    rng = random.Random(7)
    middle = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(256))
    half = "".join("58"[bin(k).count("1") % 2] for k in range(256))
    other = half.translate(str.maketrans("58", "85"))
    rows = [(1, half + middle + half), (2, other + middle + other)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 400)


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60_000)) * 60  # longer than a block, and it repeats itself
    rows = [(1, long), (2, "x" * 2000), (3, long[:700] + "é" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as k1", "text as spans", "1 as anchor")
    out = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert [out[k].n_removed for k in (1, 2)] == [len(long), 2000] and [out[k].n_spans for k in (1, 2)] == [1, 1]
    # of the last, what the first holds goes, and what it repeats itself
    want = brute([(3, rows[2][1]), (4, long[:2000])], 400)[0]
    assert (out[3].n_removed, out[3].kept_sha256) == (want[2], want[4]) and out[3].kept_text == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert found(df) == []


def test_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    for t in range(200):
        n, k = rng.choice([1, 2, 3, 5, 10, 40, 200]), rng.choice([1, 2, 3, 26])
        x = [rng.randrange(1, k + 1) for _ in range(n)] * rng.choice([1, 1, 3]) + [0]
        cap = rng.choice([1, 3, 8, 400])
        want = sorted(range(len(x)), key=lambda i: x[i:])
        order, shared = suffix_order(np.array(x), rng.choice([5, 50, 1 << 20]), cap)
        assert order.tolist() == want, t
        for a, b, s in zip(want, want[1:], shared[1:].tolist(), strict=False):
            agree = next((q for q in range(cap) if max(a, b) + q >= len(x) or x[a + q] != x[b + q]), cap)
            assert s == agree


def test_a_text_much_larger_than_the_queues():
    """Ten times what the queues hold and more: they go to disk, and the names are sorted by recursion."""
    rng = np.random.default_rng(5)
    part = rng.integers(97, 103, 3000).astype(np.uint8).tobytes()
    pieces = [rng.integers(97, 103, 5000).astype(np.uint8).tobytes() + part[k * 100 : k * 100 + 900] for k in range(8)] * 2
    spilled = []
    spill = DiskQueue._spill
    try:
        DiskQueue._spill = lambda self: (spilled.append(self.held), spill(self))[1]
        small = repeated_starts(pieces, 400, memory=4000)
    finally:
        DiskQueue._spill = spill
    assert len(spilled) > 5 and max(map(len, small)) == 5501
    assert [x.tolist() for x in small] == [x.tolist() for x in repeated_starts(pieces, 400)]


def test_repeated_starts():
    rng = random.Random(2)
    for t in range(40):
        pieces = ["".join(rng.choice("ab" if t % 2 else "abcd\0\xff") for _ in range(rng.randrange(0, 60))).encode("latin1") for _ in range(6)]
        count = Counter(p[i : i + 8] for p in pieces for i in range(len(p) - 7))
        want = [[i for i in range(len(p) - 7) if count[p[i : i + 8]] > 1] for p in pieces]
        assert [a.tolist() for a in repeated_starts(pieces, 8)] == want


def test_order_of_some_suffixes():
    rng = random.Random(9)
    for t in range(300):
        n, k = rng.choice([1, 2, 3, 5, 10, 40, 200]), rng.choice([1, 2, 3, 26])
        x = [rng.randrange(1, k + 1) for _ in range(n)] * rng.choice([1, 1, 3]) + [0]
        cap, share = rng.choice([1, 3, 8, 400]), rng.choice([0, 0.1, 0.5])
        wanted = np.array([rng.random() < share if t % 2 else i // 7 % 4 == 0 for i in range(len(x))])
        want = [i for i in sorted(range(len(x)), key=lambda i: x[i:]) if wanted[i]]
        order, shared = suffix_order(np.array(x), rng.choice([5, 50, 1 << 20]), cap, wanted)
        assert order.tolist() == want, t
        for a, b, s in zip(want, want[1:], shared[1:].tolist(), strict=False):
            agree = next((q for q in range(cap) if max(a, b) + q >= len(x) or x[a + q] != x[b + q]), cap)
            assert s == agree


def test_only_starts_of_strings_are_sorted():
    """Of pieces of 500 bytes, the first 101 start a string of 400: the queues take these and few others, not all suffixes."""
    rng = np.random.default_rng(6)
    part = rng.integers(97, 123, 430).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, 70).astype(np.uint8).tobytes() + part for _ in range(40)]
    pushed, push = [], DiskQueue.push
    try:
        DiskQueue.push = lambda self, key, *more: (pushed.append(len(key)), push(self, key, *more))[1]
        found = repeated_starts(texts, 400, memory=2000)
    finally:
        DiskQueue.push = push
    assert all(x.tolist()[-31:] == list(range(70, 101)) for x in found)
    assert sum(pushed) < 0.8 * sum(map(len, texts))  # 2.6 times as many as bytes where all are sorted


def test_contexts_lie_around_the_anchor_only():
    """A text that repeats its anchor's bytes has contexts for the parts of its starts, not for each place of those bytes."""
    rng = random.Random(10)
    unit = "".join(rng.choice("abcdefghij") for _ in range(40))
    text = "".join(rng.choice("klmnopqrst") for _ in range(100)) + unit * 20
    (s,) = slices(pa.array([text]))
    found = pieces(s, 400)
    kinds = np.unique(found[5], return_index=True)[1]  # equal pieces are counted and kept once
    _, a, b, place, anchor, piece = (x[kinds] for x in found)
    own = [text.encode()[x : y + 400] for x, y in zip(a, b, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(place), pa.array(own)], names=["anchor", "piece", "place", "bytes"])
    (out,) = _contexts(400)(iter([batch]))
    assert max(Counter(out.column("piece").to_pylist()).values()) <= PARTS
    size = (400 - 32) // PARTS
    starts = [(k, min((p - d) // size, PARTS - 1)) for k, x, y, p in zip(piece.view(np.int64).tolist(), a, b, place, strict=True) for d in range(y - x + 1)]
    assert set(starts) == set(zip(out.column("piece").to_pylist(), out.column("part").to_pylist(), strict=True))


@pytest.mark.parametrize("length", [32, 75])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [make(n) for n in (length, length + 3, 2 * length)]
    rows = []
    for k in range(40):
        p = rng.choice(passages)
        rows.append((k, make(rng.randrange(100)) + p[rng.randrange(5) :] + make(rng.randrange(100)) + rng.choice(["", p])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found(df, length=length, crowd_bytes=2000, shard_bytes=5000, memory=500) == brute(rows, length)


def test_queues_spill_at_the_default_share():
    """With room for an eighth of a shard's suffixes, of which about a fifth start a string, the queues still go to disk."""
    rng = np.random.default_rng(12)
    part = rng.integers(97, 123, 430).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, 70).astype(np.uint8).tobytes() + part for _ in range(80)]
    spilled, spill = [], DiskQueue._spill
    try:
        DiskQueue._spill = lambda self: (spilled.append(self.held), spill(self))[1]
        found = repeated_starts(texts, 400, memory=sum(map(len, texts)) // 8)
    finally:
        DiskQueue._spill = spill
    assert spilled and all(x.tolist()[-31:] == list(range(70, 101)) for x in found)
