"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source ``s`` with a share ``p`` of all tokens gets the weight ``p**a / sum(p**a)``. The exponent ``a`` is the
largest in [0, 1] whose weights reach the target entropy; if that repeats a source more often than
allowed, it is the smallest at which no source is. Both searches narrow a bracket on ``a``; each step
evaluates the candidates in one aggregate over the table of sources, so that the driver sees
a row for each candidate and never the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import free_name, stored

#: Candidates a step and steps: together as fine as 45 halvings of the bracket.
_SECTIONS, _STEPS = 512, 5


def token_estimate(text) -> F.Column:
    """Words between ASCII white space; at least one, so that empty documents have a place too."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def temperature_weights(
    sources: DataFrame, target_entropy: float, max_repeats: float, budget: float | None = None
) -> tuple[DataFrame, float]:
    """Weights of ``source, tokens`` rows, and the exponent they come from.

    ``target_entropy`` is a fraction of the largest entropy that so many sources allow, ``max_repeats`` the most
    often that any source may be read. ``budget`` is the number of tokens to deal out; None takes
    the least with which no source is read less than once in full. Adds ``share, weight, budget_tokens, repeats``.
    """
    all_tokens = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(all_tokens or 1)))

    def judged(low: float, high: float) -> list:
        grid = F.explode(F.sequence(F.lit(0), F.lit(_SECTIONS))).alias("k")
        powers = shares.select("share", grid).withColumn("a", F.lit(low) + F.lit(high - low) * F.col("k") / F.lit(_SECTIONS))
        powers = powers.withColumn("q", F.pow("share", "a"))
        sums = powers.groupBy("a").agg(
            F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("qlq"), F.count("*").alias("n"),
            F.max(F.col("q") / F.col("share")).alias("most"), F.min(F.col("q") / F.col("share")).alias("least"),
        )
        # repeats of s: weight * budget / tokens = q/share * budget / (z * all tokens)
        spread = F.col("most") / F.col("least")
        repeats = spread if budget is None else F.col("most") / F.col("z") * F.lit(float(budget)) / F.lit(float(all_tokens or 1))
        entropy = F.log("z") - F.col("qlq") / F.col("z")
        found = sums.select(
            "a",
            (F.col("n") <= 1).alias("single"),
            (entropy >= F.lit(target_entropy) * F.log("n") - 1e-12).alias("even"),
            (repeats <= F.lit(max_repeats) + 1e-12).alias("allowed"),
        )
        return sorted(found.collect(), key=lambda r: r.a)  # a row for each candidate

    low, high = 0.0, 1.0
    for _ in range(_STEPS):  # entropy falls as the exponent grows
        rows = judged(low, high)
        if not rows or rows[0].single or rows[-1].even:
            low = high
            break
        at = max((k for k, r in enumerate(rows) if r.even), default=0)
        low, high = rows[at].a, rows[min(at + 1, len(rows) - 1)].a
    exponent = low
    rows = judged(exponent, 1.0) if all_tokens and exponent < 1 else []
    if rows and not rows[0].allowed:  # repeats fall as the exponent grows
        low, high = exponent, 1.0
        for _ in range(_STEPS):
            rows = judged(low, high)
            at = min((k for k, r in enumerate(rows) if r.allowed), default=len(rows) - 1)
            low, high = rows[max(at - 1, 0)].a, rows[at].a
        exponent = high
    q = F.pow("share", F.lit(exponent))
    norm = shares.agg(F.sum(q)).first()[0] or 1.0
    weighed = shares.withColumn("weight", q / F.lit(norm))
    if budget is None:
        budget = weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    weighed = weighed.withColumn("budget_tokens", F.col("weight") * F.lit(float(budget)))
    return weighed.withColumn("repeats", F.col("budget_tokens") / F.col("tokens")), exponent


def random_number(*parts) -> Column:
    """A number from 0 to 16**15 - 1 that the text of the parts decides."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix_plan(
    docs: DataFrame, target_entropy: float, max_repeats: float, budget: float | None, block_tokens: int, seed: int,
    id_col: str, text_col: str, source_col: str,
) -> tuple[DataFrame, DataFrame]:
    """What is read how often, by source and by block.

    Of each source: ``source, weight, repeats, times, blocks``, where ``times`` is how often it is read in full. Of each
    block: ``source, block, upto``, where its documents up to the random number ``upto`` are read once more. Rows count as mix_copies() says; an empty
    table gives two empty plans.
    """
    rows = docs.select(
        F.col(source_col).cast("string").alias("source"),
        token_estimate(F.col(text_col)).alias("n_tokens"),
        random_number(F.lit(str(seed)), F.col(id_col).cast("string")).alias("number"),
    )
    rows = stored(rows)
    sources = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    weighed, _ = temperature_weights(sources, target_entropy, max_repeats, budget)
    weighed = stored(
        weighed.select(
            "source", "weight", "repeats", "tokens", "budget_tokens",
            F.floor(F.col("repeats") + 1e-9).cast("long").alias("times"),
            F.ceil(F.col("tokens") / block_tokens).cast("long").alias("blocks"),
        )
    )
    s = weighed.selectExpr("source s", "times", "blocks", "budget_tokens - times * tokens rest")
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.col("number") % F.col("blocks")).drop("s")
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("times").alias("times"))
    # in the order of the permutation of the last pass, by running sums of ranges of it and inside each range
    blocks = blocks.withColumn("at", random_number(F.lit(str(seed)), "source", "block", "times"))
    blocks = stored(blocks.withColumn("range", F.shiftright("at", 48)))
    of_range = blocks.groupBy("source", "range").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("range")) - F.col("sum")
    of_range = of_range.select(F.col("source").alias("s"), F.col("range").alias("r"), before.alias("before"))
    blocks = blocks.join(of_range, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    inside = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("at", "block")) - F.col("tokens")
    blocks = stored(blocks.withColumn("left", F.col("rest") - F.col("before") - inside))
    # documents of the block in which the budget runs out, by number; those of one number go together
    last = blocks.filter("left > 0 and left < tokens").select(F.col("source").alias("s"), F.col("block").alias("b"), "left")
    met = rows.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    met = met.groupBy("source", "block", "number").agg(F.sum("n_tokens").alias("tokens"), F.first("left").alias("left"))
    run = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("number"))
    met = met.withColumn("run", run).filter(F.col("run") <= F.col("left") + 1e-6)
    met = met.groupBy("source", "block").agg(F.max("number").alias("last")).withColumnsRenamed({"source": "s", "block": "b"})
    blocks = blocks.join(met, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    upto = F.when(F.col("left") <= 0, F.lit(-1)).when(F.col("left") >= F.col("tokens"), F.lit(16**15)).otherwise(F.coalesce("last", F.lit(-1)))
    return weighed, stored(blocks.select("source", "block", upto.cast("long").alias("upto")))


def _with_copies(rows: DataFrame, plan: tuple[DataFrame, DataFrame], source: str, number: str, own: str) -> DataFrame:
    """``rows`` with a column of structs: weight, repeats, times, block, copies."""
    weighed, blocks = plan
    s = weighed.select(F.struct(*weighed.columns).alias(f"{own}_s"))
    b = blocks.select(F.struct(*blocks.columns).alias(f"{own}_b"))
    rows = rows.join(s, F.col(source).eqNullSafe(F.col(f"{own}_s.source")))
    block = F.col(number) % F.col(f"{own}_s.blocks")
    rows = rows.join(b, F.col(source).eqNullSafe(F.col(f"{own}_b.source")) & (block == F.col(f"{own}_b.block")))
    copies = F.col(f"{own}_s.times") + (F.col(number) <= F.col(f"{own}_b.upto")).cast("long")
    fields = [F.col(f"{own}_s.weight"), F.col(f"{own}_s.repeats"), F.col(f"{own}_s.times"), F.col(f"{own}_b.block"), copies.alias("copies")]
    return rows.withColumn(own, F.struct(*fields)).drop(f"{own}_s", f"{own}_b")


def mix_copies(
    docs: DataFrame,
    target_entropy: float = 0.9999,
    max_repeats: float = 4.0,
    budget: float | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each document is read: ``doc_id, source, n_tokens, weight, block, copies``, one row for each.

    A source's documents are dealt by a random number of their id into blocks of about ``block_tokens`` tokens. Each pass
    over a source reads its blocks in a permutation of its own. A source is read in full as often as its budget allows; what
    is left goes to whole blocks in the permutation of the last pass, and of the block in which it runs out to documents in
    the order of their numbers, up to the last that still fits. Null sources are one source of their own, null texts are
    empty, documents count as one token at least, rows that repeat an id (or have none) are read alike, and an empty table
    gives no rows; other columns are not read. Running sums are those of blocks (by ranges, and inside a range) or of the
    documents of one block, so a source with a third of all rows is never gathered.
    """
    plan = mix_plan(docs, target_entropy, max_repeats, budget, block_tokens, seed, id_col, text_col, source_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        token_estimate(F.col(text_col)).alias("n_tokens"),
        random_number(F.lit(str(seed)), F.col(id_col).cast("string")).alias("number"),
    )
    found = _with_copies(rows, plan, "source", "number", "mix")
    return found.select("doc_id", "source", "n_tokens", "mix.weight", "mix.block", "mix.copies")


def mix_sources(
    docs: DataFrame, target_entropy: float = 0.9999, max_repeats: float = 4.0, budget: float | None = None, block_tokens: int = 1 << 20,
    seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` with each row as often as mix_copies() says, in all its columns, in the order of reading.

    Pass ``p`` over a source reads its blocks in their permutation ``p``; passes and sources are interleaved, so that any
    stretch of the order has about the target weights, and copies of a document lie a pass apart. Null sources are one source of their own, null and
    empty texts count as one token, long ones by all their words; rows that repeat an id (or have none) are read alike; columns may have any names; an
    empty table stays empty.
    """
    plan = mix_plan(docs, target_entropy, max_repeats, budget, block_tokens, seed, id_col, text_col, source_col)
    own = free_name(docs, "mix")
    source, number, turn, place = (f"{own}_{x}" for x in ("source", "number", "pass", "place"))
    rows = docs.withColumns({source: F.col(source_col).cast("string"), number: random_number(F.lit(str(seed)), F.col(id_col).cast("string"))})
    rows = _with_copies(rows, plan, source, number, own).filter(F.col(f"{own}.copies") > 0)
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{own}.copies") - 1)))
    at = random_number(F.lit(str(seed)), source, F.col(f"{own}.block").cast("string"), F.col(turn).cast("string")) / F.lit(16.0**15)
    part = F.least(F.lit(1.0), F.col(f"{own}.repeats") - F.col(turn))
    rows = rows.withColumn(place, (F.col(turn) + at * part) / F.col(f"{own}.repeats"))
    return rows.repartitionByRange(place, number).sortWithinPartitions(place, number).select(*docs.columns)
