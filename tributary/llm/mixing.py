"""Mixing sources to target weights, with DataFrame functions only.

A source's weight is its share of tokens to the power a, normalised.  At a = 1
the shares stay as they are, at 0 all are equal; a is bisected to the flattest
mix in which no source repeats more often than a limit, or to the steepest that
reaches a target entropy.  Without a budget the mix is as long as it takes for
the source with the fewest passes to pass once, so that no document is lost.

A source's documents are dealt to blocks of bounded size by a hash.  Each pass
over it takes its blocks in another order, and each block its documents, until
the source's budget is used.  A document's place in its source's run, divided by
the budget, is its place in the mix, so every stretch of the mix has the target
weights.  Windows run over single blocks, or over ranges of a bounded number of
blocks and the table of these ranges.

All choices go by hashes of doc_id, text, source and a row's place in its file,
not by the file's name: the same rows in the same layout give the same mix.

Edge cases: null and empty sources are one source.  A text counts its words and
one for its end, so null and empty texts count 1.  Rows that repeat are mixed
each by themselves, and a null doc_id like any other.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import bounded_join, materialise, with_row

BLOCK_TOKENS = 1 << 18
MIX_BLOCK_TOKENS = 1 << 20
#: Blocks, about, whose order is found together; tokens of an output partition, and most partitions.
RANGE_BLOCKS, PART_TOKENS, MOST_PARTS = 4096, 1 << 22, 200_000
LEVELS, JOBS = 4, 9


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def solve(totals: DataFrame, repetition: float | None, entropy: float | None) -> float:
    """The exponent, bisected to 36 binary digits, four levels a job.

    Each job returns only the measures at the 15 exponents that four levels of
    bisection may ask for.
    """
    low, high = 0, 1 << (LEVELS * JOBS)
    scale = float(high)
    most = totals.agg(F.max("total")).first()[0] or 1
    shares = totals.select((F.col("total") / F.lit(most)).alias("x"))

    def measured(points: list[int]) -> dict[int, float]:
        columns = []
        for p in points:
            w = F.pow("x", F.lit(p / scale))
            if repetition is not None:
                columns.append(F.max(w / F.col("x")))
            else:
                columns.append(F.log(F.sum(w)) - F.sum(w * F.log(w)) / F.sum(w))
        row = shares.agg(*columns).first()
        return dict(zip(points, row))

    while high - low > 1:
        step = (high - low) >> LEVELS or 1
        points = list(range(low + step, high, step))
        found = measured(points)
        while high - low > step:
            mid = (low + high) // 2
            value = found[mid]
            flat_enough = value is None or (value > repetition if repetition is not None else value >= entropy)
            if flat_enough:
                low = mid
            else:
                high = mid
    # Repetition falls and entropy falls as the exponent grows: stay on the allowed side.
    return (high if repetition is not None else low) / scale


def budgets(rows: DataFrame, repetition: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """source, total, weight, budget of each source, from rows of (source, tokens)."""
    if (repetition is None) == (entropy is None):
        raise ValueError("either a repetition limit or a target entropy is needed")
    totals = materialise(rows.groupBy("source").agg(F.sum("tokens").cast("long").alias("total")), "totals")
    a = solve(totals, repetition, entropy)
    most = totals.agg(F.max("total")).first()[0] or 1
    flat = totals.withColumn("w", F.pow(F.col("total") / F.lit(most), F.lit(a)))
    whole = flat.agg(F.sum("w")).first()[0] or 1.0
    flat = flat.withColumn("weight", F.col("w") / F.lit(whole))
    if budget is None:
        own = F.greatest(F.col("total"), F.floor(F.lit(most) * F.col("w") + 1e-6))
    else:
        own = F.floor(F.lit(budget) * F.col("weight"))
    return materialise(flat.select("source", "total", "weight", own.cast("long").alias("budget")), "budgets")


def _mix(docs: DataFrame, repetition: float | None, entropy: float | None, budget: int | None, seed: int) -> tuple[DataFrame, int]:
    """The rows of mix() with their content's hash, and the tokens of all budgets."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = with_row(docs).select(doc_id.alias("doc_id"), "__f", "__r", source.alias("source"), n_tokens(text).cast("long").alias("tokens"), F.xxhash64(doc_id, text, source).alias("own"))
    rows = materialise(rows, "counted")
    sources = budgets(rows, repetition, entropy, budget)
    most, whole = sources.agg(F.max("total"), F.sum("budget")).first()
    dealt = bounded_join(rows, sources, ["source"], "inner", 64)
    n_blocks = F.ceil(F.col("total") / F.lit(BLOCK_TOKENS))
    dealt = dealt.withColumn("dealt", F.pmod(F.xxhash64(F.lit(seed), "own", "__r"), n_blocks))
    dealt = materialise(dealt.select("doc_id", "__f", "__r", "own", "source", "tokens", "dealt"), "dealt")

    blocks = dealt.groupBy("source", "dealt").agg(F.sum("tokens").alias("held")).join(sources, "source")
    passes = F.greatest(F.ceil(F.col("budget") / F.col("total")), F.lit(1))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    # A pass takes its blocks by hash: by range of it, then within the range.
    at = F.xxhash64(F.lit(seed), "epoch", "source", "dealt")
    ranges = max(0, ((most or 0) // (BLOCK_TOKENS * RANGE_BLOCKS)).bit_length())
    blocks = materialise(blocks.withColumn("at", at).withColumn("range", F.shiftright(F.shiftright("at", 32), 31 - ranges) if ranges else F.lit(0).cast("long")), "blocks")
    earlier = Window.unboundedPreceding, -1
    spans = blocks.groupBy("source", "epoch", "range").agg(F.sum("held").alias("span"))
    spans = spans.withColumn("base", F.coalesce(F.sum("span").over(Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(*earlier)), F.lit(0)))
    within = Window.partitionBy("source", "epoch", "range").orderBy("at", "dealt").rowsBetween(*earlier)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("held").over(within), F.lit(0))).join(spans.drop("span"), ["source", "epoch", "range"])
    blocks = blocks.withColumn("from", F.col("epoch") * F.col("total") + F.col("base") + F.col("before")).where(F.col("from") < F.col("budget"))

    used = dealt.join(blocks.drop("at", "range", "held", "base", "before"), ["source", "dealt"])
    inside = Window.partitionBy("source", "dealt", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "own", "__r"), "own", "__r", "__f")
    ahead = F.coalesce(F.sum("tokens").over(inside.rowsBetween(*earlier)), F.lit(0))
    used = used.withColumn("position", F.col("from") + ahead).where(F.col("position") < F.col("budget"))
    used = used.withColumn("place", F.col("position") / F.col("budget"))
    block = F.floor(F.col("place") * -(-(whole or 0) // MIX_BLOCK_TOKENS))
    return used.select("doc_id", "__f", "__r", "own", "source", "weight", F.col("tokens").alias("n_tokens"), "epoch", "position", block.alias("block"), "place"), whole or 0


def mix(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 17) -> DataFrame:
    """One row for each time a document is used.

    doc_id, __f, __r, source, weight, n_tokens, epoch (pass over the source),
    position (tokens of its source before it), block of the mix, place (0 to 1).
    """
    return _mix(docs, repetition, entropy, budget, seed)[0].drop("own")


def mixed(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 17) -> DataFrame:
    """The rows of docs as often as the mix uses them, in the mix's order, with all their columns.

    Columns whose names begin with two underscores are for this module's own use and may not occur in docs.
    """
    columns = docs.columns
    docs = with_row(docs)
    used, whole = _mix(docs, repetition, entropy, budget, seed)
    used = materialise(used.groupBy("__f", "__r").agg(F.collect_list("place").alias("__places"), F.first("own").alias("__own")), "used")
    out = bounded_join(docs, used, ["__f", "__r"], "inner", 64)
    out = out.withColumn("__place", F.explode("__places"))
    parts = max(1, min(MOST_PARTS, -(-whole // PART_TOKENS)))
    # Dealt by the place itself, so that the same rows lie together in every run.
    out = out.repartitionById(parts, F.floor(F.col("__place") * parts).cast("int"))
    return out.sortWithinPartitions("__place", "__own", "__r", "__f").select(columns)
