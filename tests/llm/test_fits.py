"""What the fitted operators learn from, and records that an index lacks."""

import random

import numpy as np
import pyarrow as pa

from cubeloom.llm.line_labels import FEATURES, fit_line_labels
from cubeloom.llm.quality import fit_quality, tokens
from cubeloom.llm.warc_audit import archive_index, leaves, merkle_audit, record_digests, response_records
from cubeloom.llm.words import slices


def test_word_vectors_come_from_all_texts(spark):
    labelled = [(k, f"plain words number {k} here") for k in range(20)]
    alike = [(1000 + k, f"the red {w} sat on a mat") for k, w in enumerate(["zonka", "zonkb"] * 30)]  # no labels
    labels = spark.createDataFrame([(k, k % 2) for k, _ in labelled], "doc_id long, quality int")
    docs = spark.createDataFrame(labelled + alike, "doc_id long, text string")
    vectors = fit_quality(docs.repartition(5), labels)[0]
    one, two, other = (vectors[tokens(next(slices(pa.array([w]))))[1][0]] for w in ("zonka", "zonkb", "nowhere"))
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert cosine(one, two) > 0.4 > cosine(one, other)
    assert np.array_equal(vectors, fit_quality(docs.coalesce(1), labels)[0])


def test_late_lines_train(spark):
    rng = np.random.default_rng(1)
    lines = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) + f" {rng.integers(1e6)} some more words." for _ in range(n)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    plain = [lines(250) for _ in range(8)]
    marked = [t[:150] + (["|||###" + x[:6] + "###|||" for x in lines(100)] if k % 2 == 0 else t[150:]) for k, t in enumerate(plain)]
    weights = []
    for texts in (plain, marked):
        df = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
        weights.append(fit_line_labels(df, labels).weights)
    at = FEATURES.index("marks 1/4")
    assert abs(weights[0][at]).max() < 0.1 < weights[1][at, 0] - weights[1][at, 1]


def test_records_that_the_index_lacks(spark):
    rows = [(k, f"http://a/{k}", f"<p>{k}</p>") for k in range(300)]
    new = [(k, "http://b", "<p>new</p>") for k in (-5, 300, 1 << 41, (1 << 63) - 1)]
    pages = lambda r: record_digests(response_records(spark.createDataFrame(r, "page_id long, url string, html string")))
    index = archive_index(pages(rows))
    found = merkle_audit(leaves(index, pages(rows)), leaves(index, pages(rows[1:] + new))).collect()
    assert {(r.record_id, r.damage) for r in found} == {(0, "missing")} | {(k, "extra") for k, *_ in new}
    assert all((r.archive == -1) == (r.damage == "extra") for r in found)
    assert merkle_audit(leaves(index, pages(rows + new)), leaves(index, pages(new + rows))).count() == 0


def features_by_hand(text, common):
    """The features of each line of a text, one at a time."""
    import re
    from collections import Counter

    word = re.compile(r"[^\x20\x09-\x0D]+")
    lines = text.split("\n") if text else []
    owner = [k for k, line in enumerate(lines) for _ in word.findall(line)]
    words = word.findall(text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    out = []
    for k, line in enumerate(lines):
        own = word.findall(line)
        raw = line.encode()
        chars = max(sum(map(len, own)), 1)
        letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b > 127
        letters, upper = max(sum(map(letter, raw)), 1), sum(65 <= b <= 90 for b in raw)
        digits, symbols = sum(48 <= b <= 57 for b in raw), sum(b in b"#*$%&|<>" for b in raw)
        marks = sum(not letter(b) and not 48 <= b <= 57 and b not in b" \t\n\v\f\r" for b in raw)
        recur, n = sum(j in again for j, o in enumerate(owner) if o == k), len(own)
        out.append([
            1, n == 0, 0 < n < 3, 2 < n < 10, n > 9, 50 * symbols > chars, 10 * symbols > chars, 2 * upper > letters, 5 * digits > chars,
            8 * marks > chars, 4 * marks > chars, n > 0 and line in lines[:k], 4 * recur > max(n, 1), 4 * recur > 3 * max(n, 1),
            n > 0 and own[-1][-1] in ".!?:;\"'", k == 0, k == len(lines) - 1, n > 0 and line in common,
        ])
    return np.array(out, bool).reshape(-1, len(FEATURES))


def test_features_and_verdicts_by_hand():
    import random
    from itertools import product

    from cubeloom.llm.line_labels import Field, Lines, verdict

    rng = random.Random(12)
    common = ["a b c", "Tail é."]
    hashes = np.sort(np.concatenate([Lines(s).line for s in slices(pa.array(common))]))
    texts = [None, "", "\n", "a b c", "x\n\na b c\na b c\nTail é."]
    for _ in range(150):
        line = lambda: " ".join(rng.choice(["a", "b", "c", "B", "9", "é.", "%%", "d|", "##x", "", "long-word"]) for _ in range(rng.randrange(0, 9)))
        texts.append("\n".join(rng.choice([line(), line(), rng.choice(common)]) for _ in range(rng.randrange(1, 6))))
    gen = np.random.default_rng(1)
    field = Field(gen.normal(size=(len(FEATURES), 2)), gen.normal(size=(2, 2)), hashes)
    at = 0
    for s in slices(pa.array(texts), most=400):
        part = Lines(s, hashes)
        kept, failed, share = verdict(part, field, 0.5)
        for k in range(s.n):
            text = texts[at + k] or ""
            want = features_by_hand(text, common)
            assert np.array_equal(part.features[part.owner == k], want), text
            scores = want @ field.weights
            value = lambda y, scores=scores: sum(scores[i, v] for i, v in enumerate(y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:], strict=False))
            best = max(product((1, 0), repeat=len(want)), key=value)
            sizes = [sum(len(w) for w in line.split()) for line in text.split("\n")] if text else []
            content = sum(n for n, y in zip(sizes, best, strict=True) if y) / max(sum(sizes), 1)
            assert abs(share[k] - content) < 1e-9 and kept[k] == (not failed[k] and content >= 0.5)
        at += s.n
    assert at == len(texts)


def test_common_lines_do_not_depend_on_partitions(spark):
    """Exact counts of lines, of the company they stand in and of all lines, against plain Python, whatever the cut."""
    from collections import Counter, defaultdict

    from cubeloom.llm.line_labels import common_lines, fit_line_labels, quality_rules

    rng = random.Random(11)
    footers = [f"footer number {k} of the site" for k in range(12)]
    rows = []
    for k in range(600):
        lines = [" ".join(rng.choice("abcdefgh") * rng.randrange(2, 7) for _ in range(8)) + "." for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(3)):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(footers[: 1 + k % 12]))
        rows.append((k, "\n".join(lines + ["", " "])))
    rows += [(k, "copied text\nof two lines") for k in range(600, 640)] + [(640, None), (641, "")]
    seen, company = Counter(), defaultdict(set)
    for _, text in rows:
        lines = (text or "").split("\n")
        first = [(w.split() or [""])[0] for w in lines]
        for k, line in enumerate(lines):
            if line.split() and line not in lines[:k]:
                seen[line] += 1
                company[line].add((first[k - 1] if k else "", first[k + 1] if k + 1 < len(lines) else ""))
    want = {x for x, n in seen.items() if n > 3 and 4 * len(company[x]) >= 3 * n}
    for share in (1 << 16, 100):
        least = {x for x in want if seen[x] * share >= sum(seen.values())}
        assert len(least) > 0
        found = [common_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), share).tolist() for n in (1, 8, 64, 211)]
        assert all(f == found[0] for f in found) and len(found[0]) == len(least)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 600, 3)], "doc_id long, quality int, toxic int")
    kept = []
    for n in (1, 211):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        kept.append(sorted((r.doc_id, r.kept, round(r.content_share, 9)) for r in quality_rules(df, fit_line_labels(df, labels)).collect()))
    assert kept[0] == kept[1]


def test_context_sums_do_not_depend_on_tasks(spark):
    from cubeloom.llm.quality import index_vectors, summed_contexts

    rng = random.Random(1)
    df = spark.createDataFrame([(" ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(30)),) for _ in range(90)], "text string")
    one = summed_contexts(df.coalesce(1), *index_vectors(3))
    assert one.any()
    for tasks, together in ((30, 2), (20, 4), (9, 64)):
        assert (summed_contexts(df.repartition(tasks), *index_vectors(3), together=together) == one).all()
