"""Content or boilerplate, line by line: a linear-chain conditional random field over the lines of a text.

Each line has a set of binary features read off its bytes, and one that tells whether the corpus has it in many texts; the
field scores a label for each line and a pair of labels for each two neighbours. Viterbi decoding marks the lines, and the
share of a document's word characters that lie in content lines decides whether the document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .session import Workspace
from .words import SPACE, Slice, mix, slices, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"'")] = True
_POINT = (np.arange(256) & 0xC0) != 0x80

FEATURES = (
    "bias", "no word", "1-2 words", "3-9 words", "10+ words", "symbols 1/50", "symbols 1/10", "upper 1/2", "digits 1/5",
    "marks 1/8", "marks 1/4", "equals an earlier line", "words recur 1/4", "words recur 3/4", "ends a sentence", "first line", "last line",
    "stands in many texts",
)


class Frame:
    """Where the lines of a slice lie, their hashes, and which of them stood in their text before."""

    def __init__(self, s: Slice, starts: np.ndarray, ends: np.ndarray):
        self.lo, self.hi, self.owner = s.lines()
        self.first_word, self.last_word = np.searchsorted(starts, self.lo), np.searchsorted(starts, self.hi)
        self.words = self.last_word - self.first_word
        self.has_word = self.words > 0
        self.line = s.hashes(self.lo, self.hi)
        key = mix(self.line + self.owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.earlier = np.zeros(len(self.lo), bool)
        rows = np.flatnonzero(self.has_word)
        order = rows[np.argsort(key[rows], kind="stable")]
        self.earlier[order[1:]] = key[order[1:]] == key[order[:-1]]
        self.new, self.old = np.ones(len(self.lo), bool), np.ones(len(self.lo), bool)
        self.new[1:] = self.owner[1:] != self.owner[:-1]
        self.old[:-1] = self.new[1:]


def lines_in_company(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a slice that hold a word, once for each text: their hashes, and hashes of what the lines around them begin with."""
    starts, ends, _ = s.words()
    frame = Frame(s, starts, ends)
    first = frame.first_word[frame.has_word]
    opening = np.zeros(len(frame.lo) + 2, np.uint64)
    opening[1:-1][frame.has_word] = s.hashes(starts[first], ends[first])
    around = mix(np.where(frame.new, np.uint64(0), opening[:-2]) ^ np.uint64(0x9E3779B97F4A7C15)) + np.where(frame.old, np.uint64(0), opening[2:])
    use = frame.has_word & ~frame.earlier
    return frame.line[use], around[use]


class Lines:
    """The lines of a slice: owner, features, word characters; and the counts of each text."""

    def __init__(self, s: Slice, common: np.ndarray = np.zeros(0, np.uint64)):  # noqa: B008
        n = s.n
        starts, ends, owner = s.words()
        word = s.hashes(starts, ends)
        points = _POINT[s.data] & ~SPACE[s.data]
        self.n_words = np.bincount(owner, minlength=n)
        self.word_chars = s.per_text(points)
        self.n_symbols = s.per_text(SYMBOLS[s.data])
        # words in windows that recur in their text
        at, window = windows(word, owner)
        covered = np.zeros(len(word) + 1, np.int64)
        if len(at):
            key = mix(window + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            again = at[_recurs(key)]
            np.add.at(covered, again, 1)
            np.add.at(covered, np.minimum(again + 5, len(word)), -1)
        covered = np.cumsum(covered)[: len(word)] > 0
        self.n_repeat_words = np.bincount(owner[covered], minlength=n)
        frame = Frame(s, starts, ends)
        lo, hi, line_owner, words, has_word, earlier = frame.lo, frame.hi, frame.owner, frame.words, frame.has_word, frame.earlier
        first_word, last_word, new, old = frame.first_word, frame.last_word, frame.new, frame.old
        self.line, self.has_word = frame.line, has_word
        self.n_dup_lines = np.bincount(line_owner[earlier], minlength=n)

        def within(mask: np.ndarray) -> np.ndarray:
            run = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=run[1:])
            return run[hi] - run[lo]

        chars = np.maximum(within(points), 1)
        letters = np.maximum(within(_LETTER[s.data]), 1)
        symbols, upper, digits = within(SYMBOLS[s.data]), within(_UPPER[s.data]), within(_DIGIT[s.data])
        marks = within(~_LETTER[s.data] & ~_DIGIT[s.data] & ~SPACE[s.data])
        run = np.zeros(len(covered) + 1, np.int64)
        np.cumsum(covered, out=run[1:])
        recur = run[last_word] - run[first_word]
        tail = np.zeros(len(lo), np.uint8)
        tail[has_word] = s.data[ends[last_word[has_word] - 1] - 1]
        count = np.maximum(words, 1)
        many = np.zeros(len(lo), bool)
        if len(common):
            many = has_word & (common[np.minimum(np.searchsorted(common, self.line), len(common) - 1)] == self.line)
        self.owner, self.chars, self.n = line_owner, within(points), n
        self.features = np.stack(
            [
                np.ones(len(lo), bool), ~has_word, (words > 0) & (words < 3), (words > 2) & (words < 10), words > 9,
                50 * symbols > chars, 10 * symbols > chars, 2 * upper > letters, 5 * digits > chars,
                8 * marks > chars, 4 * marks > chars, earlier, 4 * recur > count, 4 * recur > 3 * count, _STOP[tail], new, old, many,
            ],
            axis=1,
        )


def _recurs(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def decode(emission: np.ndarray, transition: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The best label (1: content) of each line; emission: lines x 2, owner: the text of each line, ascending.

    All texts go forward together, line by line, longest texts first, so that those still going are a prefix.
    Of equal scores label 1 wins.
    """
    length = np.bincount(owner, minlength=n)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    texts = np.argsort(-length, kind="stable")
    first, size = start[texts], length[texts]
    back = np.zeros((len(owner), 2), np.int8)
    score = np.zeros((n, 2))
    active = int((size > 0).sum())
    score[:active] = emission[first[:active]]
    label = np.ones(len(owner), np.int8)
    depth = int(size.max(initial=0))
    alive = np.searchsorted(-size, -np.arange(1, depth + 1), "right")
    for t in range(1, depth):
        k = alive[t]
        via = score[:k, :, None] + transition[None]
        best = (via[:, 1] >= via[:, 0]).astype(np.int8)
        back[first[:k] + t] = best
        score[:k] = np.take_along_axis(via, best[:, None, :].astype(np.int64), 1)[:, 0] + emission[first[:k] + t]
    now = (score[:, 1] >= score[:, 0]).astype(np.int8)
    for t in range(depth - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        label[at] = now[:k]
        now[:k] = back[at, now[:k]]
    return label


@dataclass
class Field:
    """Weights (features x 2), transitions (2 x 2), and the hashes of the lines that many texts have."""

    weights: np.ndarray
    transition: np.ndarray
    common: np.ndarray


def fit_field(
    sequences: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3, window: int = 100
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2) by gradient ascent on the likelihood of labelled sequences.

    ``sequences``: of each text, the features of its lines, their labels, and the label of the text. Texts of
    both labels weigh the same in total. A longer text than ``window`` lines is read whole, in windows that follow each other:
    only the transitions where two of them meet are left out.
    """
    sequences = [part for part in sequences if len(part[0])]
    width = sequences[0][0].shape[1] if sequences else len(FEATURES)
    weights, transition = np.zeros((width, 2)), np.zeros((2, 2))
    if len({y for _, _, y in sequences}) < 2:
        weights[0, 1] = 1.0  # nothing to tell apart: everything is content
        return weights, transition
    counts = np.bincount([y for _, _, y in sequences], minlength=2)
    each = len(sequences) / (2 * counts)
    # a text counts once, however long it is
    windows = []
    for lines, labels, y in sequences:
        parts = -(-len(lines) // window)
        windows += [(f, k, each[y] / len(lines)) for f, k in zip(np.array_split(lines, parts), np.array_split(labels, parts), strict=True)]
    windows.sort(key=lambda p: -len(p[0]))
    size = np.array([len(f) for f, _, _ in windows])
    depth, n = int(size[0]), len(windows)
    x, y = np.zeros((depth, n, width)), np.zeros((depth, n), np.int8)
    for k, (f, labels, _) in enumerate(windows):
        x[: len(f), k], y[: len(f), k] = f, labels
    weight = np.array([w for _, _, w in windows])
    weight /= weight @ size
    alive = [int((size > t).sum()) for t in range(depth)]
    log_sum = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for _ in range(steps):
        emission = x @ weights
        forward, backward = np.zeros((depth, n, 2)), np.zeros((depth, n, 2))
        forward[0] = emission[0]
        for t in range(1, depth):
            k = alive[t]
            forward[t, :k] = log_sum(forward[t - 1, :k, :, None] + transition, 1) + emission[t, :k]
        for t in range(depth - 2, -1, -1):
            k = alive[t + 1]
            backward[t, :k] = log_sum(transition + (emission[t + 1, :k] + backward[t + 1, :k])[:, None, :], 2)
        norm = log_sum(forward[0] + backward[0], 1)
        slope, pairs = np.zeros_like(weights), np.zeros((2, 2))
        for t in range(depth):
            k = alive[t]
            truth = np.eye(2)[y[t, :k]]
            slope += x[t, :k].T @ ((truth - np.exp(forward[t, :k] + backward[t, :k] - norm[:k, None])) * weight[:k, None])
            if t:
                joint = forward[t - 1, :k, :, None] + transition + (emission[t, :k] + backward[t, :k])[:, None, :]
                joint = np.exp(joint - norm[:k, None, None])
                joint[np.arange(k), y[t - 1, :k], y[t, :k]] -= 1
                pairs -= (joint * weight[:k, None, None]).sum(0)
        weights += rate * 4 * (slope - decay * weights)
        transition += rate * (pairs - decay * transition)
    return weights, transition


def common_lines(docs: DataFrame, share: int = 1 << 16, block: int = 1 << 20, text_col: str = "text") -> np.ndarray:
    """Hashes, sorted, of the lines that stand in many texts of ``docs``, in various company: at most ``share`` of them.

    A line counts once for each text that has it. It is common if it stands in four texts at least, makes up 1/``share`` of all that is counted, and
    the lines around it begin differently in three quarters of its places at least (copies of a text have their lines in
    common too, but in one company). All counts are exact and don't depend on how ``docs`` is partitioned: tasks add up equal lines in
    equal company, ``block`` lines at a time, and drop none. Lines without a word don't count, so null and empty texts have none; repeated rows
    count as texts of their own, in one company; a text of any length counts whole; an empty table has no common lines. Other columns aren't read.
    """

    def combined(lines: np.ndarray, around: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((around, lines))
        lines, around = lines[order], around[order]
        at = np.flatnonzero(np.append(True, (lines[1:] != lines[:-1]) | (around[1:] != around[:-1])))
        n = np.diff(np.append(at, len(lines)))
        return pa.RecordBatch.from_pydict({"line": pa.array(lines[at].view(np.int64)), "around": pa.array(around[at].view(np.int64)), "n": pa.array(n)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for s in slices(batch.column(0)):
                parts.append(lines_in_company(s))
                held += len(parts[-1][0])
                if held > block:
                    yield combined(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    parts, held = [], 0
        if held:
            yield combined(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    work = Workspace(docs.sparkSession)
    met = work.stored(docs.select(text_col).mapInArrow(count, "line long, around long, n long"))
    total = met.agg(F.sum("n")).first()[0] or 0
    many = work.stored(met.groupBy("line").agg(F.sum("n").alias("total")).filter((F.col("total") > 3) & (F.col("total") * share >= total)))
    # no more than `share` lines have that share
    kinds = met.join(F.broadcast(many), "line").groupBy("line", "around").agg(F.first("total").alias("total")).groupBy("line").agg(F.first("total").alias("total"), F.count("*").alias("kinds"))
    rows = kinds.filter(4 * F.col("kinds") >= 3 * F.col("total")).select("line").toPandas()
    work.drop()
    return np.sort(rows["line"].to_numpy(np.int64).view(np.uint64))


def fit_line_labels(docs: DataFrame, labels: DataFrame, sample: int = 4000, window: int = 100) -> Field:
    """Fit the field on at most ``sample`` labelled rows, spread over ``docs`` by hash and none of them held out, and all their
    lines, in windows of at most ``window``.

    Lines have no labels of their own. Those that stand in many texts (common_lines(), over all of ``docs``) count as
    boilerplate wherever they are, and so do all lines of documents of quality 0; the other lines of documents of quality 1
    count as content. Documents that fail the base rules have no say. Null labels, null ids and labels of documents that aren't
    there are left out, of several labels of an id the largest counts, and of several texts of an id the first in order;
    without labels of both kinds every line is content. Other columns aren't read.
    """
    common = common_lines(docs)
    chosen = (
        labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in slices(batch.column(1)):
                part = Lines(s, common)
                edges = np.searchsorted(part.owner, np.arange(s.n + 1))
                # what fails the base rules goes in any case, and its lines would only speak against repetition
                starts = np.where(base_failed(part), edges[1:], edges[:-1])
                found += [np.packbits(part.features[a:b], axis=None).tobytes() for a, b in zip(starts, edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["quality", "lines"])

    # the sample has a fixed number of rows, so it may be broadcast; a row for each id
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    rows = rows.select("quality", "text").mapInArrow(read, "quality int, lines binary").collect()
    width, many = len(FEATURES), FEATURES.index("stands in many texts")
    sequences = []
    for row in sorted(rows, key=lambda r: (r.quality, bytes(r.lines))):
        bits = np.unpackbits(np.frombuffer(row.lines, np.uint8))
        lines = bits[: len(bits) // width * width].reshape(-1, width)
        sequences.append((lines, row.quality * (1 - lines[:, many]), row.quality))
    return Field(*fit_field(sequences, window=window), common)


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()),
    ]
)


def quality_rules(
    docs: DataFrame, field: Field, least_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts and the verdict for every whole text, one row for each row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share``.
    A document fails the base rules with fewer than 10 words, or with more than a fifth of its words in 5-word
    windows that recur in it; otherwise it stays when at least ``least_content`` of its word characters lie in lines that
    the field marks as content. Null texts have no words and fail; null ids, repeated rows and extra columns make
    no difference; an empty table gives no rows. A text is read whole, so the longest must fit in a worker's memory, with
    some hundred bytes for each of its lines.
    """
    spread = docs.sparkSession.sparkContext.broadcast(field)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                part = Lines(s, spread.value.common)
                kept, failed, share = verdict(part, spread.value, least_content)
                columns = [part.n_words, part.word_chars, part.n_symbols, part.n_dup_lines, part.n_repeat_words, failed, kept, share]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.n), *(pa.array(c) for c in columns)], schema=_OUT)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return rows.mapInArrow(judge, ", ".join(f"{f.name} {_DDL[f.type]}" for f in _OUT))


def keep_quality(
    docs: DataFrame, field: Field, least_content: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that quality_rules() keeps; nothing is shuffled.

    Null and empty texts go, repeated rows stay or go together, null ids and extra columns make no difference.
    """
    spread = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for s in slices(batch.column(at)):
                kept.append(verdict(Lines(s, spread.value.common), spread.value, least_content)[0])
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(judge, docs.schema)


def base_failed(part: Lines) -> np.ndarray:
    return (part.n_words < 10) | (100 * part.n_repeat_words > 20 * part.n_words)


def verdict(part: Lines, field: Field, least_content: float) -> tuple[np.ndarray, ...]:
    """Of each text: whether it stays, whether it fails the base rules, and its share of content."""
    label = decode(part.features @ field.weights, field.transition, part.owner, part.n)
    share = np.bincount(part.owner, part.chars * label, part.n) / np.maximum(part.word_chars, 1)
    failed = base_failed(part)
    return ~failed & (share >= least_content), failed, share


_DDL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
