"""Exact groups, packing, token counts, mixing, quality rules, licences and archives: odd rows, and brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cubeloom.llm.exact_dedup import exact_dedup, exact_groups
from cubeloom.llm.licences import digest, known_digests, license_scan
from cubeloom.llm.line_labels import FEATURES, decode, fit_field, fit_line_labels, keep_quality, quality_rules
from cubeloom.llm.mixing import mix_copies, mix_sources
from cubeloom.llm.packing import OpenBins, pack_best_fit
from cubeloom.llm.token_counts import token_counts
from cubeloom.llm.warc_audit import archive_index, leaves, merkle_audit, record_digests, response_records

SCHEMA = "doc_id long, text string, source string, kept string, keep_id string"
TEXTS = [None, "", "a", "a b", "A b", "same text here", "same text here", "one. two, three\nfour", " x  y ", "é ☃ <s>", "w " * 3000, "▁ ▁▁z \n\n\t q.", "don't <|endoftext|> it's"]


def odd_rows(spark):
    rows = [(k, t, f"s{k % 3}" if k % 4 else None, "x", "y") for k, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a", "s1", "x", "y"), (None, "only here", None, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[0], r[1]) for r in rows]


def test_exact_groups(spark):
    df, rows = odd_rows(spark)
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    want = []
    for k, t in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((k, keep, len(ids), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: str(r)
    got = [tuple(r) for r in exact_groups(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    # digests that collide send the lookup to the full texts
    short = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    assert sorted((tuple(r) for r in exact_groups(df, digest=short, salts=2).collect()), key=key) == sorted(want, key=key)
    assert exact_groups(df.limit(0)).count() == 0
    left = exact_dedup(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12]


def test_open_bins_close_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 4, 5, 3, 5)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 7), (2, 5)]
    bins = OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (6, 8, 7, 3, 4)] == [0, 1, 2, 2, 0]


def test_packing(spark):
    from tokenizers import Tokenizer

    df, rows = odd_rows(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    found = pack_best_fit(df, path, capacity=256, open_bins=3).collect()
    want = Counter()
    for k, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            want[k, p, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
    assert pack_best_fit(df.limit(0), path).count() == 0


def test_packing_hardly_depends_on_partitions(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["tree", "of", "Éste", "naïve", "w7", "no."]) for _ in range(rng.randrange(1, 900)))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    for n in (1, 150):
        found = pack_best_fit(df.repartition(n), path).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("m"), F.countDistinct("doc_id", "piece").alias("p"), F.count("*").alias("all")).first()
        assert found.m <= 1.02 * -(-found.n // 2048) + 1 and found.p == found["all"]


def test_ids_with_a_small_cache():
    from tokenizers import Tokenizer

    from cubeloom.llm.packing import CachedIds

    rng = random.Random(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    model, ids = Tokenizer.from_file(path), CachedIds(path, most=50)
    letters = "abcdeéèÉßñÀÿ'%&19.ª×÷µ<|"
    for _ in range(40):
        texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) + rng.choice(["", ".", ",", "9", "&&&", "'s", "€", "e\u0301", "!!"]) for _ in range(rng.randrange(40))) for _ in range(5)]
        assert [ids(t.encode()) for t in texts] == [struct.pack(f"<{len(x)}I", *x) for x in (model.encode(t, add_special_tokens=False).ids for t in texts)]


def test_token_counts(spark):
    import sentencepiece

    df, rows = odd_rows(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((k, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for k, t in rows)
    assert Counter(tuple(r) for r in token_counts(df, path, limit=100).collect()) == want
    assert token_counts(df.limit(0), path).count() == 0


def test_mixing_by_hand(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), "big" if k % 4 else f"s{k % 3}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    p = np.array([tokens[s] for s in sorted(tokens)], float)
    p /= p.sum()

    def weights(a):
        return p**a / (p**a).sum()

    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        w = weights(a)
        low, high = (a, high) if -(w * np.log(w)).sum() >= 0.97 * np.log(len(p)) else (low, a)
    want = dict(zip(sorted(tokens), weights(low), strict=True))
    found = mix_copies(df, target_entropy=0.97, max_repeats=50, block_tokens=200).collect()
    assert len(found) == 600
    read = Counter()
    for r in found:
        assert r.weight == pytest.approx(want[r.source], abs=1e-6) and r.copies >= 1
        read[r.source] += r.copies * r.n_tokens
    total = sum(read.values())
    for s in tokens:
        assert read[s] / total == pytest.approx(want[s], abs=0.01)
    # a limit on repeats wins over entropy, and a small budget drops documents but deals out no more than it has
    limited = mix_copies(df, target_entropy=1.0, max_repeats=2.0, block_tokens=200)
    assert limited.agg(F.max("copies")).first()[0] <= 3
    small = mix_copies(df, budget=1000.0, block_tokens=200).agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    assert 700 <= small <= 1000
    assert mix_sources(df, target_entropy=0.97, max_repeats=50, block_tokens=200).count() == sum(r.copies for r in found)


def test_mixing_odd_rows(spark):
    df, rows = odd_rows(spark)
    assert mix_copies(df).count() == len(rows)
    assert mix_sources(df).columns == df.columns and mix_copies(df.limit(0)).count() == 0
    one = df.withColumn("source", F.lit("s"))
    assert {r.copies for r in mix_copies(one).collect()} == {1}


def counts(text):
    words = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    tokens = [m.group() for m in words]
    grams = Counter(tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4))
    covered = {j for k in range(len(tokens) - 4) if grams[tuple(tokens[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(tokens)
    return (n, sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_quality_rules(spark):
    rng = random.Random(8)
    texts = [*TEXTS, "\n", "\nab\n\nab\n", "a b c d e f a b c d e g h i j k l m n o p", "x\r\nx\r\nx"]
    for _ in range(40):
        texts.append("\n".join(" ".join(rng.choice(["a", "bé", "c#", "%%%", "d|", ""]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 6))))
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    field = fit_line_labels(df, spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(50)], "doc_id long, quality int"))
    for r in quality_rules(df, field).collect():
        assert tuple(r)[1:7] == counts(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality_rules(df, field).filter("kept").collect()}
    left = keep_quality(df, field)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == kept
    assert quality_rules(df.limit(0), field).count() == 0 and keep_quality(df.limit(0), field).count() == 0


def test_viterbi_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(0, 6, 5)
        owner = np.repeat(np.arange(5), sizes)
        emission, transition = rng.normal(size=(len(owner), 2)), rng.normal(size=(2, 2))
        got = decode(emission, transition, owner, 5)
        for k in range(5):
            rows = np.flatnonzero(owner == k)
            score = lambda y, rows=rows: sum(emission[r, v] for r, v in zip(rows, y, strict=True)) + sum(transition[a, b] for a, b in zip(y, y[1:], strict=False))
            best = max(product((0, 1), repeat=len(rows)), key=score)
            assert tuple(got[rows]) == best


def test_field_learns_labels_that_change_inside_a_text():
    rng = np.random.default_rng(2)
    width = len(FEATURES)

    def make(y):  # content, then boilerplate, or the other way round, or all of one kind
        labels = np.repeat({0: [0, 0], 1: [1, 1], 2: [1, 0], 3: [0, 1]}[y], 5)
        noise = rng.random((10, width - 1)) < np.where(labels, 0.7, 0.3)[:, None]
        return np.column_stack([np.ones(10), noise]), labels, int(labels.mean() >= 0.5)

    data = [make(k % 4) for k in range(300)]
    weights, transition = fit_field(data[:200])
    assert all(transition[k, k] > transition[k, 1 - k] for k in (0, 1))
    right = [(decode(x @ weights, transition, np.zeros(len(x), int), 1) == y).mean() for x, y, _ in data[200:]]
    assert np.mean(right) > 0.95


def line_corpus(n=300, copies=80):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(8, 16))).capitalize() + "."
    junk = lambda: " ".join(rng.choice(words) + rng.choice(["%%%", "&&&", "###"]) for _ in range(10))
    notice = "Accept all cookies to go on reading this page."
    rows, labels = [], []
    for k in range(n):
        bad = k % 3 == 0
        lines = [junk() if bad else line() for _ in range(rng.randrange(3, 9))]
        if k % 2:
            lines.insert(rng.randrange(len(lines) + 1), notice)
        rows.append((k, "\n".join(lines)))
        labels.append((k, int(not bad)))
    text = "\n".join(line() for _ in range(6))
    rows += [(n + k, text) for k in range(copies)]  # copies of one text: its lines are no boilerplate
    half = "\n".join([line() for _ in range(5)] + [junk() for _ in range(5)])
    return rows, labels, notice, half


def test_line_labels(spark):
    rows, labels, notice, half = line_corpus()
    docs = spark.createDataFrame([*rows, (9999, half), (9998, half + "\n" * 5000 + "Tail of it, all the same.")], "doc_id long, text string").repartition(2)
    field = fit_line_labels(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(field.common) == 1
    found = {r.doc_id: r for r in quality_rules(docs, field).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([found[k].kept == bool(y) for k, y in held]) > 0.95
    assert all(found[k].kept for k in range(300, 380))
    assert 0.3 < found[9999].content_share < 0.7 and 0 < found[9998].content_share < 1
    with_notice = [k for k, y in labels if y and k % 2]
    assert np.mean([0 < found[k].content_share < 1 for k in with_notice]) > 0.9


def test_repeated_ids_train_once(spark):
    rows, labels, _, _ = line_corpus(60, 4)
    docs = spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string")
    assert quality_rules(docs, fit_line_labels(docs, spark.createDataFrame(labels + labels[:1] * 9, "doc_id long, quality int"))).count() == len(rows) + 500


def test_licences(spark):
    mit = next(t for n, t in __import__("cubeloom.llm.licences", fromlist=["KNOWN"]).KNOWN if n == "MIT")
    disguised = "Copyright (c) 2019 Some One\nAll rights reserved.\n" + mit.upper().replace(",", " ; ").replace("SUBLICENSE", "SUBLICENCE")
    rows = [(1, disguised), (2, "text\nLicenced under the Apache Licence, v2.0!\nmore\n  RELEASED under the MIT license"), (3, "nothing"), (4, None), (5, ""), (5, ""), (None, "SPDX-License-Identifier: MIT")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    found = sorted(((r.doc_id, r.license_id, r.line_license_ids, r.n_license_lines) for r in license_scan(df).collect()), key=str)
    assert found == sorted([(1, "MIT", "", 0), (2, None, "Apache-2.0,MIT", 2), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0), (5, None, "", 0), (None, "MIT", "MIT", 1)], key=str)
    own = spark.createDataFrame([("Mine", "nothing")], "license_id string, text string").select(digest(F.col("text")).alias("digest"), "license_id")
    assert license_scan(df, own).filter("license_id = 'Mine'").first().doc_id == 3
    assert known_digests(spark).groupBy("digest").count().filter("count > 1").count() == 0
    assert license_scan(df.limit(0)).count() == 0


def test_archives(spark):
    rng = random.Random(9)
    pages = [(k, f"http://h/{k}", "x" * rng.randrange(0, 900)) for k in range(300)] + [(None, None, None), (7, "again", "y")]
    one = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    bad = [(k, u, h + "!" if k == 5 else h) for k, u, h in pages if k != 9] + [(7, "again", "z")]
    two = spark.createDataFrame(bad, "page_id long, url string, html string")
    sound = record_digests(response_records(one))
    index = archive_index(sound, archive_bytes=20_000).persist()
    first = leaves(index, sound)
    assert merkle_audit(first, first, 2000, 3).count() == 0
    found = merkle_audit(first, leaves(index, record_digests(response_records(two))), 2000, 3)
    assert sorted((r.record_id, r.damage) for r in found.collect()) == [(5, "changed"), (7, "changed"), (9, "missing")]
    back = merkle_audit(leaves(index, record_digests(response_records(two))), first, 2000, 3)
    assert (9, "extra") in [(r.record_id, r.damage) for r in back.collect()]
    empty = first.limit(0)
    assert merkle_audit(empty, empty).count() == 0
    ends = index.join(sound, "record_id").groupBy("archive").agg(F.max(F.col("offset") + F.col("n_bytes")).alias("end"), F.sum("n_bytes").alias("all"))
    assert ends.filter("end != all").count() == 0


def clashing(spark):
    """Columns that have the names which operators use inside."""
    rows = [(1, "a b c d e f g", "s", 99), (2, "a b c d e f g", "s", 98), (3, None, None, 97), (None, "a b c d e f g", "t", 96), (3, None, None, 95)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    for name in ("_copy", "_copies", "copies", "mix", "mix_pass", "mix_s", "number", "_dropped_id", "dropped_id", "row", "lines", "canonical", "digest", "_id", "_text", "k1", "kept"):
        df = df.withColumn(name, F.col("n"))
    return df


def test_clashing_columns(spark):
    df = clashing(spark)
    mixed = mix_sources(df, max_repeats=9.0)
    assert mixed.columns == df.columns
    assert all(r["_copy"] == r.n == r.mix == r.number for r in mixed.collect())
    left = exact_dedup(df)
    assert left.columns == df.columns and sorted(r["_dropped_id"] for r in left.collect()) == [95, 96, 97, 98]
    assert license_scan(df).count() == 5 and mix_copies(df).count() == 5
    path = public_tokenizers.path("word_bpe_49k.json")
    assert pack_best_fit(df, path).count() == 5 and token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 5


def test_very_long_texts(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    long = "word, " * 150_000 + "x" * 300_000
    df = spark.createDataFrame([(1, long), (2, long), (3, "short")], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r.doc_id: r.keep_id for r in exact_groups(df).collect()} == {1: 2, 2: 2, 3: 3}
    assert license_scan(df).count() == 3 and {r.copies for r in mix_copies(df).collect()} == {1}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r.n_tokens for r in token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert found[1] == found[2] == len(model.encode(long))
    ids = len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(long, add_special_tokens=False).ids) + 1
    pieces = pack_best_fit(df, public_tokenizers.path("word_bpe_49k.json")).filter("doc_id = 1").collect()
    assert sum(r.length for r in pieces) == ids and len(pieces) == -(-ids // 2048)


def test_equivalent_licences_have_one_digest(spark):
    same = ["MIT Licence licence text, v2.0", "mit license LICENSE text version 2.0", "(c) 1999 Me\nMIT license\nlicence text ver 2 0", "MIT-license; licence text; V. 2.0"]
    other = ["MIT license text version 2.0", "licensee", ""]
    rows = spark.createDataFrame([(t,) for t in same + other], "text string").select(digest(F.col("text")).alias("d")).collect()
    assert len({r.d for r in rows[: len(same)]}) == 1 and len({r.d for r in rows}) == 4


def test_own_table_of_licences_for_lines(spark):
    own = spark.createDataFrame([("Mine", "free for all"), ("Mine", "FREE, for all!"), ("Other", "ask first")], "license_id string, text string")
    own = own.select(digest(F.col("text")).alias("digest"), "license_id")
    df = spark.createDataFrame([(1, "text\nFree for all.\nask  FIRST\nfree for all"), (2, "free for all"), (3, "no")], "doc_id long, text string")
    found = {r.doc_id: (r.license_id, r.line_license_ids, r.n_license_lines) for r in license_scan(df, own).collect()}
    assert found == {1: (None, "Mine,Other", 3), 2: ("Mine", "Mine", 1), 3: (None, "", 0)}


def test_mixing_with_a_hot_source_and_a_hot_id(spark):
    rows = [(k, "w " * 40, "hot" if k % 3 else f"s{k % 30}") for k in range(3000)] + [(7, "w " * 40, "hot")] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    copies = mix_copies(df, target_entropy=0.9, max_repeats=5.0, block_tokens=2000).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n"), F.avg("weight").alias("w"), F.min("copies").alias("least"))
    found = {r.source: r for r in copies.collect()}
    total = sum(r.n for r in found.values())
    assert len(found) == 11 and all(r.least >= 1 for r in found.values())
    assert all(abs(r.n / total - r.w) < 0.02 for r in found.values())


def test_copies_lie_a_pass_apart(spark):
    rows = [(k, "w " * 50, "big") for k in range(400)] + [(k, "w " * 50, "small") for k in range(400, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    read = [r.doc_id for r in mix_sources(df, target_entropy=1.0, max_repeats=9.0, block_tokens=500).coalesce(1).collect()]
    assert Counter(read)[450] == 4 and Counter(read)[3] == 1
    for k in (420, 450, 499):
        places = [n for n, x in enumerate(read) if x == k]
        assert all(b - a > 20 for a, b in zip(places, places[1:], strict=False))
    half = Counter(x >= 400 for x in read[: len(read) // 2])
    assert 0.35 < half[True] / sum(half.values()) < 0.65
