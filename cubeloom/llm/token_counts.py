"""Token counts by a two-tier table of pre-token lengths, without a shuffle of pre-tokens.

Tier one is a broadcast table of the lengths of frequent pre-tokens, tier two a cache in each Python
worker that encodes what the table misses. No piece of the vocabulary crosses from one pre-token to
the next (checked when the model is loaded), so a text has as many tokens as its pre-tokens together.

The frequent pre-tokens come from one pass over all texts: every task keeps those that make up at
least 1/``share`` of its own pre-tokens (so at most ``share`` rows a task leave it), their counts are
added up, and the table keeps those at or above 1/``table`` of all that was counted (so it has at
most ``table`` rows, however large the corpus is).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, worker_cache

#: The library's sign for a space.
SPACE = "\u2581"
_RUNS = re.compile(" +[^ ]*")
#: A point or comma that doesn't close a word.
_SIGN = "0-9A-Za-zÀ-ÖØ-öø-ÿ"
_ODD_MARK = re.compile(rf"[.,][^ \n]|[^{_SIGN}][.,]|^[.,]")
#: Characters of text whose pre-tokens are in memory at once (a longer text is taken alone).
_TOGETHER = 1 << 20


def units(text: str) -> tuple[list[str], int]:
    """The keys of a text's pre-tokens, and the number of tokens besides theirs.

    A pre-token is a run of spaces and what follows, and its key lacks the first of them; the library puts
    a space before every text that isn't empty, so that each has one. In plain texts (no two spaces in
    a row) a line feed opens a pre-token too, and points and commas that close words are counted apart.
    A key that begins with a line feed has no space before it.
    """
    if not text:
        return [], 0
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or " \n" in text or text[0] in " \n":
        keys = [u[1:] for u in _RUNS.findall(" " + text)]
        return keys, sum(k[:1] == "\n" for k in keys)  # nothing joins a space and a line feed
    marks = 0
    if not _ODD_MARK.search(text):
        marks = text.count(".") + text.count(",")
        text = text.replace(".", "").replace(",", "")
    return text.replace("\n", " \n").split(" "), marks


def together(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in order, null as empty, some at a time."""
    part, size = [], 0
    for value in column:
        part.append(value.as_py() or "")
        size += len(part[-1])
        if size > _TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


class UnitLengths:
    """Lengths in tokens of pre-tokens: a given table, and a cache of what else has been encoded."""

    def __init__(self, path: str, most: int = 600_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.known, self.lengths = most, {}, {}
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        crosses = re.compile(rf"[^{SPACE}]{SPACE}|[{_SIGN}][.,]|\n")
        if any(crosses.search(p) for p in pieces) or not {".", ","} <= set(pieces):
            raise ValueError("a piece of this model crosses pre-tokens")

    def encode(self, keys: list[str]) -> list[int]:
        # the library puts a space before a line feed too, and none is there; alone, a space is one token
        found = self.model.encode(keys, num_threads=1)
        return [len(ids) - (k[0] == "\n") if k else 1 for k, ids in zip(keys, found, strict=True)]

    def use(self, known: dict[str, int]) -> None:
        """Take a table of known lengths in."""
        if known is not self.known:
            self.known, self.lengths = known, dict(known)

    def counts(self, texts: list[str]) -> list[int]:
        parts = [units(t) for t in texts]
        if len(self.lengths) > self.most + len(self.known):
            self.lengths = dict(self.known)
        lengths = self.lengths
        found = [list(map(lengths.get, p)) for p, _ in parts]
        new = list({u for (p, _), n in zip(parts, found, strict=True) if None in n for u in p if u not in lengths})
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            lengths.update(zip(part, self.encode(part), strict=True))
        return [
            marks + (sum(map(lengths.__getitem__, p)) if None in n else sum(n))
            for (p, marks), n in zip(parts, found, strict=True)
        ]


@worker_cache
def worker_lengths(path: str) -> UnitLengths:
    """One cache for all tasks of a Python worker."""
    return UnitLengths(path)


def frequent_units(docs: DataFrame, text_col: str = "text", share: int = 4096, table: int = 1 << 15) -> DataFrame:
    """``unit, n``: the frequent pre-tokens of all texts and their counts, at most ``table`` rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        total = lost = 0
        for batch in batches:
            for text in (t for texts in together(batch.column(0)) for t in texts):
                found, _ = units(text)
                total += len(found)
                counts.update(found)
                if len(counts) > 64 * share:  # summary of bounded size: all counts fall alike
                    floor = sorted(counts.values(), reverse=True)[16 * share]
                    lost += floor
                    counts = Counter({u: n - floor for u, n in counts.items() if n > floor})
        kept = [(u, n) for u, n in counts.items() if (n + lost) * share >= total]
        yield pa.RecordBatch.from_pydict(
            {"unit": pa.array([u for u, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())}
        )

    summaries = docs.select(text_col).mapInArrow(local, "unit string, n long")
    found = cut(summaries.groupBy("unit").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    return found.filter(F.col("n") * table >= total)


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, one row for each row of ``docs``.

    Counts equal those of the sentencepiece library without added tokens. Null texts are empty and
    have no tokens; null ids, repeated rows and extra columns make no difference; an empty table gives
    no rows. A worker's cache holds about 600,000 pre-tokens and is then emptied.
    """
    frequent = frequent_units(docs, text_col)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_lengths(model_path)
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"unit": pa.array(found, pa.string()), "length": pa.array(model.encode(found) if found else [], pa.int64())})

    # at most 2**15 rows, by the share that a frequent pre-token has
    rows = frequent.select("unit").mapInArrow(lengths, "unit string, length long").collect()
    known = docs.sparkSession.sparkContext.broadcast({r.unit: r.length for r in rows})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_lengths(model_path)
        model.use(known.value)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).cast(pa.int64())
            n_tokens = pa.array([n for part in together(texts) for n in model.counts(part)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
