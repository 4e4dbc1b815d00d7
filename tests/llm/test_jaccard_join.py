"""The similarity join against all pairs."""

import re

import pytest

from cubeloom.llm.jaccard_join import jaccard_components


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}


def make(rng, n_base=12, copies=9):
    vocabulary = [f"w{k}" for k in range(400)]
    rows, number = [], 0
    passage = rng.sample(vocabulary, 60)
    for base in range(n_base):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 30, 60, 150, 400]))]
        if base % 3 == 0:
            words += passage
        for _ in range(copies):
            new = list(words)
            for _ in range(int(len(new) * rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.045]))):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                new += [rng.choice(vocabulary) for _ in range(len(new) // 8)]
            rows.append((number * 7 % 1009, " ".join(new).upper() if rng.random() < 0.2 else "\n".join(new)))
            number += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    import random

    rows = make(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A\tb"), (6, "b a"), (7, "x y z u v"), (8, "x y z u v")]
    df = spark.createDataFrame(rows + rows[3:4], "doc_id long, text string").selectExpr("*", "doc_id as n_shingles", "text as a")
    assert found(df) == brute(rows)
    assert jaccard_components(df).count() == 9
    assert jaccard_components(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (4, "a b"), (None, "q")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(nameless).collect()) == [(0, 0), (0, 4), (4, 4)]


def test_a_large_group_of_near_copies(spark):
    """Copies that wander off from one text, a good half of them beyond the threshold, some from each other."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows, last = [], base
    for k in range(900):
        words = list(last if k % 9 == 0 else base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        words = words[: 120 - rng.randrange(0, 20)] if k % 5 == 0 else words
        last = words
        rows.append((k * 7 % 907, " ".join(words)))
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
    assert 2 < len({c for _, c in want.values()}) < 900


def test_groups_are_cut_up_where_nothing_is_frequent(spark, monkeypatch):
    """Without the table of frequent shingles, large groups go through the order of their hubs."""
    import random

    from cubeloom.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "frequent_shingles", lambda counted: jj.Order(jj.np.zeros(0, jj.np.uint64), jj.np.zeros(0, jj.np.int64)))
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(90)]
    rows = []
    for k in range(400):
        words = list(base) if k % 7 else list(rows[-1][1].split() if rows else base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_words_of_opposite_letters_differ(spark):
    """Strings in which two letters follow the Thue-Morse sequence and its complement cancel out in sums modulo 2**64."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one two three four {one}"), (2, f"one two three four {two}")]
    assert {k: v[1] for k, v in found(spark.createDataFrame(rows, "doc_id long, text string")).items()} == {1: 1, 2: 2}


def test_near_duplicates_keep_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (3, None, 7), (None, "a b c d e f g", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped_id long").withColumn("component_id", df_lit())
    left = jj_drop(df)
    assert left.columns == df.columns and sorted((r.doc_id or 0, r.dropped_id) for r in left.collect()) == [(0, 8), (1, 5), (3, 7)]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("mine")


def jj_drop(df):
    from cubeloom.llm.jaccard_join import drop_near_duplicates

    return drop_near_duplicates(df)


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 3_000_000)]
    assert {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3}


def test_ids_with_several_texts(spark):
    """Each text of an id counts: its document is linked with whatever one of them is linked with."""
    import random

    rng = random.Random(3)
    base = [" ".join(f"t{k}w{rng.randrange(500)}" for _ in range(60)) for k in range(6)]
    near = [b + " more" for b in base]
    rows = [(1, base[0]), (1, base[1]), (2, near[0]), (3, near[1]), (4, base[2]), (5, base[3]), (5, base[3]), (6, near[3]), (7, base[4]), (8, near[4]), (8, base[5]), (9, near[5]), (9, None), (10, base[0])]
    want = {1: {1}, 2: {1}, 3: {1}, 4: {4}, 5: {5}, 6: {5}, 7: {7}, 8: {7}, 9: {7, 9}, 10: {1}}
    for parts in (1, 5):
        seen = {}
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        for r in jaccard_components(df).collect():
            seen.setdefault(r.doc_id, set()).add(r.component_id)
        assert seen == want
    assert jaccard_components(spark.createDataFrame([(1, base[0]), (1, base[1])], "doc_id long, text string")).select("component_id").distinct().count() == 1


def test_tables_too_large_to_send(spark, monkeypatch):
    """The same links where the tables meet in shuffles."""
    import random

    monkeypatch.setattr("cubeloom.llm.session.FEW", 0)
    rows = make(random.Random(3), n_base=6)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_tasks_release_the_caches_of_other_operators():
    """A Python worker that has packed or counted tokens doesn't hold their tokenizers beside the join's sets."""
    import public_tokenizers
    import pyarrow as pa

    from cubeloom.llm import jaccard_join as jj
    from cubeloom.llm.packing import worker_ids
    from cubeloom.llm.token_counts import worker_lengths

    class Sent:
        value = jj.Order(jj.np.zeros(0, jj.np.uint64), jj.np.zeros(0, jj.np.int64))

    ids, texts = pa.array([1, 2]), pa.array(["a b c d e f", "a b c d e g"])
    sets = pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])
    (packed,) = jj._groups(jj.Levels(4, 5, 2), 1, Sent)(iter([sets.select([1])]))
    for task in (
        lambda: list(jj._sets(iter([sets]))),
        lambda: list(jj._groups(jj.Levels(4, 5, 2), 1, Sent)(iter([sets.select([1])]))),
        lambda: jj._shared(4, 5)(pa.Table.from_batches([packed])),
        lambda: list(jj._segments(4, Sent)(iter([pa.RecordBatch.from_arrays([ids, texts, ids], ["id", "text", "key"])]))),
    ):
        worker_ids(public_tokenizers.path("word_bpe_49k.json"))
        worker_lengths(public_tokenizers.path("piece_bpe_32k.model"))
        task()
        assert worker_ids.cache_info().currsize == worker_lengths.cache_info().currsize == 0
