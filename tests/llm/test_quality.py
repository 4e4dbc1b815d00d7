"""The classifier on held-out rows, and on texts that are odd."""

import random

from cubeloom.llm.quality import fit_quality, quality_scores


def corpus(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad = k % 4 == 0
        if bad:
            text = [w + rng.choice(["%%%", "###", "!!"]) for w in text]
        rows.append((k, " ".join(text), "x"))
        labels.append((k, 0 if bad else 1))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    model = fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    truth = dict(labels)
    found = quality_scores(docs, model).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(rows) and 40 < len(held) < 120
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    odd = [(1, None), (2, ""), (None, "a"), (3, "word " * 200_000), (3, "word " * 200_000)]
    scores = {r.doc_id: r.score for r in quality_scores(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert scores[1] == scores[2] and len(scores) == 4


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_scores(docs, fit_quality(docs, none)).first().score == 0.5
    assert quality_scores(docs.limit(0), fit_quality(docs.limit(0), none)).count() == 0
