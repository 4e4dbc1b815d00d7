"""Structure repair of conversations by Knuth's lightest derivation.

A repaired conversation has roles of the form ``(s?(ua)+)?``. Repairs are derivations: the item (i, q) says that the first i rows were
edited so that the roles so far lead to state q of that form, and its weight is (cost, audit), the edits' letters. Each edit is an
unary deduction that adds to the cost and appends a letter, so it never makes a weight smaller, and smaller weights stay smaller:
the functions are superior. An agenda pops the smallest weight first; a popped item is final, and so is the first goal that is popped.

Conversations aren't gathered. Rows are dealt into ranges of conversation and turn and pass a task in order, a bounded
chunk at a time, whose final items are the axioms of the next. A conversation that crosses the edge of a range gives one item for each state it
may enter and leave with, in each range; these hyperedges (what came before, this piece) are derived once more, over pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import Workspace, cut

#: States of the form: nothing yet, after s, after u, after ua.
START, SYSTEM, USER, PAIRED = range(4)
GOALS = (START, PAIRED)
#: From each state, where a role's initial leads; and the role that an edit would put there.
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIRED}, PAIRED: {"u": USER}}
PUT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIRED), PAIRED: ("user", USER)}
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
#: What a row is: forced out (blank or said before), sound, or without an end.
GONE, SOUND, TRUNCATED = range(3)
CHUNK_ROWS, TEXT_BYTES = 256, 1 << 25
_BLANKS = " \t\n\x0b\x0c\r"
Weight = tuple[int, str]


def edits(row: tuple[str, int, int], state: int) -> Iterator[tuple[int, str, int]]:
    """Cost, letter and next state of each edit that takes a row ``(initial, kind, times)``."""
    initial, kind, times = row
    yield DELETE * times, "D" * times, state
    if kind != GONE:
        more = UNFINISHED if kind == TRUNCATED else 0
        if initial in MOVES[state]:
            yield more, "K", MOVES[state][initial]
        yield more + REROLE, "R", PUT[state][1]


def lightest(rows: list[tuple[str, int, int]], axioms: dict[int, Weight], goals: tuple[int, ...] | None = None) -> dict[int, Weight]:
    """The lightest weights of the items after ``rows``, by state, from those before them.

    With ``goals``, only the lightest goal among them: the agenda stops as it is popped.
    """
    agenda = [(cost, audit, 0, state) for state, (cost, audit) in axioms.items()]
    agenda.sort()
    final: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    while agenda:
        cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows):
            if goals is None or state in goals:
                found[state] = cost, audit
                if goals is not None or len(found) == len(PUT):
                    break
        else:
            for more, letter, after in edits(rows[i], state):
                if (i + 1, after) not in final:
                    heappush(agenda, (cost + more, audit + letter, i + 1, after))
        after = PUT[state][1]
        if (i, after) not in final:
            heappush(agenda, (cost + INSERT, audit + "I", i, after))
    return found


class Repaired:
    """Hashes the repaired conversation as its rows and the audit's letters come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = PUT[self.state]
            self._say(role, "")
            self.at += 1

    def row(self, role: str, text: str | None, times: int) -> None:
        self._inserted()
        letter = self.audit[self.at]
        if letter == "K":
            self._say(role, text or "")
            self.state = MOVES[self.state][role[:1]]
        elif letter == "R":
            role, self.state = PUT[self.state]
            self._say(role, text or "")
        self.at += times if letter == "D" else 1

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


class _Piece:
    """The rows of a conversation in one range, read chunk by chunk."""

    def __init__(self, conv, entries: tuple[int, ...]):
        self.conv, self.weights = conv, {p: {p: (0, "")} for p in entries}
        self.chunk: list[tuple[str, int, int]] = []
        self.texts: list[tuple[str, str | None, int]] | None = []
        self.size = self.illegal = 0
        self.first = self.last = None

    def add(self, role: str, text: str | None, times: int, kind: int) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += (times - 1) * (initial + initial not in ("su", "ua", "au"))
        self.last = initial
        if len(self.chunk) == CHUNK_ROWS:
            self.weights = {p: lightest(self.chunk, w) for p, w in self.weights.items()}
            self.chunk = []
        self.chunk.append((initial, kind, times))
        if self.texts is not None:
            self.size += len(role) + len(text or "") + 64
            self.texts.append((role, text, times))
            if self.size > TEXT_BYTES:
                self.texts = None

    def close(self, part: int, whole: bool) -> tuple:
        found = {p: lightest(self.chunk, w, GOALS if whole else None) for p, w in self.weights.items()}
        cost = audit = digest = None
        goals = [found[START][q] for q in GOALS if q in found.get(START, {})]
        if goals:
            cost, audit = min(goals)
            if self.texts is not None:
                said = Repaired(audit)
                for row in self.texts:
                    said.row(*row)
                digest = said.digest()
        table = None if whole else [(p, q, *w) for p, to in found.items() for q, w in to.items()]
        return self.conv, part, self.illegal, self.first, self.last, cost, audit, digest, table


def derived(pieces: list[list[tuple[int, int, int, str]]]) -> Weight:
    """The lightest derivation over pieces ``(entry, exit, cost, audit)`` in order: each is joined to what came before it."""
    now: dict[int, Weight] = {START: (0, "")}
    for piece in pieces:
        agenda: list[tuple[int, str, int]] = []
        for p, q, cost, audit in piece:
            if p in now:
                heappush(agenda, (now[p][0] + cost, now[p][1] + audit, q))
        now = {}
        while agenda:
            cost, audit, q = heappop(agenda)
            now.setdefault(q, (cost, audit))
    return min(now[q] for q in GOALS if q in now)


def damage(rows: DataFrame) -> DataFrame:
    """The damaged form of ``conv_id, turn, role, text``, with ``times``: how often each row is there.

    CRC-32 of ``conv_id:turn`` modulo 20 chooses: 0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 doubles
    it, 4 makes its role user. A null counts as one space in the hash, the role and the text; null turns stay null.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    role = F.when(fate == 4, "user").otherwise(one("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("times"))


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with its ``times``, and how many of them are ``blank``, ``duplicate`` and ``truncated``.

    Combined before they are shuffled, so a row that is there very often is one row for each task. The first turn that has the same role and text decides which
    are said before; it is looked up by the text's SHA-256.
    """
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumn("said", F.sha2(F.col("text").cast("binary"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = once.filter("times > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("said").alias("_said")).agg(F.min(turn)["turn"].alias("_turn"))
    once = once.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("said") == F.col("_said")), "left")
    end = F.rtrim(F.col("text"), F.lit(_BLANKS))
    blank, first = end == "", F.col("turn").eqNullSafe(F.col("_turn"))
    ends = F.right(end, F.lit(1)).isin(".", "!", "?")
    n = F.col("times")
    return once.select(
        "conv_id", "turn", "role", "text", "times",
        F.when(blank, n).otherwise(0).alias("blank"),
        F.when(blank, 0).when(first, n - 1).otherwise(n).alias("duplicate"),
        F.when(~blank & first & ~ends, 1).otherwise(0).cast("long").alias("truncated"),
    ).withColumn("duplicate", F.greatest(F.col("duplicate"), F.lit(0)).cast("long"))


def repaired(rows: DataFrame, work: Workspace, partitions: int | None = None) -> DataFrame:
    """``conv_id, illegal, cost, audit, repaired_sha256`` of the conversations in faults()' rows."""
    spark = rows.sparkSession
    kind = F.when(F.col("times") == F.col("blank") + F.col("duplicate"), GONE).when(F.col("truncated") > 0, TRUNCATED).otherwise(SOUND)
    rows = rows.filter("times > 0").select("conv_id", "turn", "role", F.when(kind != GONE, F.col("text")).alias("text"), F.col("text").alias("_text"), "times", kind.alias("kind"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    spread = [*order, F.substring("_text", 1, 64).asc()]
    ranges = rows.repartitionByRange(partitions, *spread) if partitions else rows.repartitionByRange(*spread)
    ranges = ranges.sortWithinPartitions(*order, F.col("_text").asc()).select(F.spark_partition_id().alias("part"), "conv_id", "role", "text", "times", "kind")
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, part int, illegal long, first string, last string, cost long, audit string, repaired_sha256 string, pieces array<struct<p:int,q:int,cost:long,audit:string>>"
    found = work.stored(ranges.mapInArrow(_pieces, schema))
    whole = found.filter("pieces is null").drop("pieces", "part", "first", "last")
    joined = work.stored(found.filter("pieces is not null").groupBy("conv_id").applyInArrow(_joined, f"conv_id {conv}, illegal long, cost long, audit string, repaired_sha256 string"))
    done = whole.unionByName(joined)
    # what has no digest yet (several pieces, or too long to be held) is hashed in one more pass over its rows, in order
    late = done.filter("repaired_sha256 is null").drop("repaired_sha256")
    steps = rows.join(late.select(F.col("conv_id").alias("_conv")), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    steps = steps.withColumns({"audit": F.lit(None).cast("string"), "step": F.lit(1)})
    read = late.select("conv_id", "audit", F.lit(0).alias("step")).unionByName(steps, allowMissingColumns=True)
    read = read.repartition("conv_id").sortWithinPartitions(order[0], "step", *order[1:], F.col("_text").asc())
    hashed = read.select("conv_id", "audit", "role", "text", "times", "kind").mapInArrow(_hashed, f"_conv {conv}, repaired_sha256 string")
    late = late.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return done.filter("repaired_sha256 is not null").unionByName(late)


def _steps(role: str, text: str | None, times: int, kind: int) -> Iterator[tuple[str, str | None, int, int]]:
    """Of equal rows only the first can stay."""
    if kind != GONE:
        yield role, text, 1, kind
        times -= 1
    if times:
        yield role, None, times, GONE


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "part", "illegal", "first", "last", "cost", "audit", "repaired_sha256", "pieces"]
    piece, edge, kind, out = None, True, None, []
    table = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = [None, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), table]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows, strict=True)]
        columns[-1] = [v and [dict(zip("p q cost audit".split(), x, strict=True)) for x in v] for v in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind if k is None else k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        kind = batch.schema.field(1).type
        for part, conv, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if piece is None or conv != piece.conv:
                if piece is not None:
                    out.append(piece.close(part, whole=not edge))
                    edge = False
                piece = _Piece(conv, tuple(PUT) if edge else (START,))
            for step in _steps(*row):
                piece.add(*step)
        if len(out) > 1000:
            yield batch_of(out)
            out = []
    if piece is not None:
        out.append(piece.close(part, whole=False))
    if out:
        yield batch_of(out)


def _joined(pieces: pa.Table) -> pa.Table:
    """One conversation's pieces: at most one for each range that it touches."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["part"])
    cost, audit = derived([[(x["p"], x["q"], x["cost"], x["audit"]) for x in r["pieces"]] for r in rows])
    illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = rows[0]["repaired_sha256"] if len(rows) == 1 else None
    kinds = [pieces.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
    values = [rows[0]["conv_id"], illegal, cost, audit, digest]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["conv_id", "illegal", "cost", "audit", "repaired_sha256"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    said, conv, kind = None, None, None
    give: Callable = lambda: pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([said.digest()])], names=["_conv", "repaired_sha256"])
    for batch in batches:
        kind = batch.schema.field(0).type
        for c, audit, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if audit is not None:
                if said is not None:
                    yield give()
                said, conv = Repaired(audit), c
            else:
                for step in _steps(*row):
                    said.row(*step[:3])
    if said is not None:
        yield give()


def repair_conversations(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each conversation of ``conv_id, turn, role, text`` (as damage() leaves them, with ``times``) with its faults and cheapest repair.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row for each ``conv_id`` (null is one of its own, a conversation like
    any other). Rows go by turn, nulls first; rows of one turn by role and text, so that equal ones are adjacent. A row's first fault counts: blank, duplicate (role and text stood
    earlier), truncated. A conversation all of whose rows are gone has zeros, an empty audit and the hash of nothing. Roles and texts that are null
    should be replaced before, as damage() does. Very long texts are hashed in bounded memory; the audit, one letter for each row, is a single value of the
    result and so has to fit in a row. Other columns are not read; an empty table gives no rows.
    """
    work = Workspace(rows.sparkSession)
    if "times" not in rows.columns:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    marked = work.stored(faults(rows))
    there: Column = F.when(F.col("times") > 0, F.col("turn"))
    total = lambda c: F.sum(F.when(F.col("times") > 0, F.col(c)).otherwise(0)).cast("long").alias(c)
    turns = marked.groupBy("conv_id", there.alias("turn")).agg(total("blank"), total("duplicate"), total("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    stats = turns.groupBy("conv_id").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    fixed = repaired(marked, work, partitions).withColumnRenamed("conv_id", "_conv")
    found = stats.join(fixed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    found = cut(found.select("conv_id", "gaps", "blank", "duplicate", "truncated", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("illegal", "cost")],
                             F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))
    work.drop()
    return found
