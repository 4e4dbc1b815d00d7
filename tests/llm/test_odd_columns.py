"""Clashing columns, very long texts and other partitions, where the operators' own tests leave them out."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from test_pipeline import corpus  # noqa: E402
from test_small_operators import counts  # noqa: E402

import corpus_pipeline  # noqa: E402
from cubeloom.llm.line_labels import fit_line_labels, keep_quality, quality_rules  # noqa: E402
from cubeloom.llm.quality import fit_quality, quality_scores  # noqa: E402
from cubeloom.llm.warc_audit import archive_index, leaves, merkle_audit, record_digests, response_records  # noqa: E402


def test_scores_beside_columns_of_the_same_names(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["red", "blue", "%%", "##"][2 * (k % 2) :][:2]) for _ in range(30))) for k in range(80)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k, _ in rows], "doc_id long, quality int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = plain
    for name in ("score", "held_out", "predicted", "quality", "label", "part", "task", "vector", "number", "_text", "source", "lang"):
        clashing = clashing.withColumn(name, F.col("doc_id") % 3)
    beside = labels
    for name in ("text", "score", "source", "number"):
        beside = beside.withColumn(name, F.lit("misleading"))
    found = [sorted(tuple(r) for r in quality_scores(df, fit_quality(df, own)).select("doc_id", "held_out", "score", "predicted").collect()) for df, own in ((plain, labels), (clashing, beside))]
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_pages_with_columns_of_the_same_names_and_long_ones(spark):
    pages = [(k, f"http://h/{k}", "x" * (3_000_000 if k == 4 else 50)) for k in range(40)]
    one = spark.createDataFrame(pages, "page_id long, url string, html string")
    two = spark.createDataFrame([(k, u, h[:-1] + "y" if k in (4, 9) else h) for k, u, h in pages], one.schema)
    for name in ("record_id", "archive", "offset", "node", "up", "parent", "digest", "digest_1", "other", "n_bytes", "record"):
        one, two = (df.withColumn(name, F.lit("z")) for df in (one, two))
    sound = record_digests(response_records(one))
    index = archive_index(sound, archive_bytes=5000)
    found = merkle_audit(leaves(index, sound), leaves(index, record_digests(response_records(two))), 1000, 3)
    assert sorted((r.record_id, r.damage) for r in found.collect()) == [(4, "changed"), (9, "changed")]
    whole = {r.record_id: r.digest for r in sound.collect()}
    html = pages[4][2]
    record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nWARC-Target-URI: http://h/4\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n{html}\r\n\r\n"
    assert whole[4] == hashlib.sha256(record.encode()).hexdigest()


def test_quality_rules_of_very_long_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(7)) for _ in range(60_000)]
    one_line = " ".join(words)
    many_lines = "\n".join(" ".join(words[k : k + 3]) for k in range(0, len(words), 3)) + "\n" + words[0]
    texts = [one_line, many_lines, "w " * 200_000, "short text of a few plain words that says nothing at all.", "x" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("other")).withColumn("kept", F.lit(1))
    field = fit_line_labels(df, spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int"))
    found = {r.doc_id: r for r in quality_rules(df, field).collect()}
    for k, text in enumerate(texts):
        assert tuple(found[k])[1:7] == counts(text)
    assert found[2].base_failed and found[4].base_failed and not found[0].base_failed
    assert {r.doc_id for r in keep_quality(df, field).collect()} == {k for k, r in found.items() if r.kept}


def test_stages_do_not_depend_on_partitions(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    for n in (1, 13):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        kept = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{k}").repartition(n)
            kept.append(Counter((r.doc_id, r.text) for r in docs.collect()))
        seen.append(kept)
    assert seen[0] == seen[1] and all(seen[0])
