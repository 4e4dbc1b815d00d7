"""Connected components against plain union, and what they cost."""

import random

from cubeloom.llm.components import connected_components


def brute(edges):
    root = {k: k for e in edges if None not in e and e[0] != e[1] for k in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def chains_and_stars():
    rng, edges = random.Random(3), []
    for k in range(6):
        ids = rng.sample(range(1000 * k, 1000 * k + 900), 60)
        edges += list(zip(ids, ids[1:])) if k % 2 else [(ids[0], x) for x in ids[1:]]
    edges += [edges[0], (5, 5), (None, 3), (7000, None)]
    rng.shuffle(edges)
    return edges


def found(spark, edges, parts):
    df = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(parts))
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_equals_union(spark, monkeypatch):
    edges = chains_and_stars()
    assert found(spark, edges, 5) == brute(edges)
    assert found(spark, edges[:0], 1) == {}
    monkeypatch.setattr("cubeloom.llm.session.FEW", 0)
    assert found(spark, edges, 5) == brute(edges)


def test_few_rounds_of_shuffles(spark):
    """A round costs its shuffles' tasks however few edges there are, so chains mustn't take a round for each doubling."""
    context = spark.sparkContext
    context.setJobGroup("components", "counted")
    try:
        found(spark, chains_and_stars(), 5)
        jobs = context.statusTracker().getJobIdsForGroup("components")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 30
