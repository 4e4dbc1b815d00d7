"""The pipeline's stages one by one on a small corpus, each against what it should do with its own input."""

import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from test_jaccard_join import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from cubeloom.llm.line_labels import fit_line_labels, quality_rules  # noqa: E402


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    rows = []
    for k in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(15, 150)))
        if k % 10 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append([k, text, "en", "big" if k % 3 else f"s{k % 4}", len(text)])
    for k in range(120, 150):
        base = rows[rng.randrange(120)][1].split()
        if k % 2 and len(base) > 60:
            base[rng.randrange(len(base))] = "changed"
        rows.append([k, " ".join(base), "en", "big", 0])
    rows += [[150, None, None, None, None], [151, "", "en", None, 0]]
    rows += [list(rows[k]) for k in (3, 3, 4, 131)]  # repeated rows
    rows += [[None, rows[5][1], "en", "big", 0], [None, rows[5][1], "en", None, 0], [None, "too short", None, None, None]]  # rows without an id
    labels = [(k, int(k % 10 != 0), 0) for k in range(100)]
    return [tuple(r) for r in rows], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((docs, after))
        docs = after
    assert all(after.columns == columns for _, after in seen[:-1])
    ids = lambda df: Counter(r.doc_id for r in df.collect())

    before, after = seen[0]
    field = fit_line_labels(before, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert ids(after) == ids(quality_rules(before, field).filter("kept")) and 0 < after.count() < before.count()
    assert {k for k in range(100) if k % 10 and len(rows[k][1].split()) > 9} <= set(ids(after))

    before, after = seen[1]
    largest = {}
    for r in before.filter("doc_id is not null").collect():
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    named = lambda df: {k for k in ids(df) if k is not None}
    assert named(after) == set(largest.values()) and after.count() < before.count()
    assert ids(after)[None] == ids(before)[None] == 2 and all(ids(after)[k] == ids(before)[k] for k in named(after))

    before, after = seen[2]
    want = brute([(r.doc_id, r.text) for r in before.filter("doc_id is not null").collect()])
    assert named(after) == {c for _, c in want.values()} and after.count() < before.count()
    assert ids(after)[None] == 2

    before, after = seen[3]
    assert set(ids(after)) == set(ids(before)) and all(n <= 4 * ids(before)[k] for k, n in ids(after).items())

    before, after = seen[4]
    pieces = Counter((r.doc_id, r.piece) for r in after.collect())
    assert Counter({k: n for (k, p), n in pieces.items() if p == 0}) == ids(before)
    assert after.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
