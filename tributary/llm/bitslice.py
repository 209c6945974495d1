"""Exact inner-product search over a bit-sliced index.

Vector components are quantised to integers.  A block of rows keeps, for each
component, one bitmap for each binary digit of its offset from the block's
minimum.  A query adds the slices that its own digits select with carry-save
adders on whole bitmaps, which gives each row's score as slices again.  From the
most significant slice downwards rows are taken or put aside until the top ones
are left, and rows that tie at the boundary are resolved by smaller vec_id.
Blocks' tops are merged.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part.  Vectors are compared with those of their own length.  A vec_id
that repeats is a candidate once for each row, and never for a query with the
same vec_id; repeated query rows give repeated results.  A null vec_id takes no
part.  Empty tables give empty results.  Scores are 64-bit integers: components
so large that one might not fit raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import bounded_join, materialise

#: Most rows of an index block, and numbers in one: a block of longer vectors has fewer rows.
BLOCK_ROWS, BLOCK_CELLS = 65_536, 1 << 22
#: Queries handled together.
CHUNK = 64
#: Tasks for each core that chunks and blocks are spread over, if need be by copies of a block.
TASKS_PER_CORE = 4
#: Scores stay below two to this power.
SCORE_BITS = 61


def usable(vector: Column) -> Column:
    """Neither null nor empty, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def quantise(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def largest(vector: Column, scale: int) -> Column:
    """The largest size among a vector's scaled components, as a double."""
    return F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double") * scale) + 1))


def checked(squares: float | None) -> None:
    """Refuse vectors whose inner products may not fit in 64 bits; squares: dims times the largest size squared."""
    if squares is not None and squares >= 2.0**SCORE_BITS:
        raise ValueError(f"scores of vectors with such large components may pass 2 ** {SCORE_BITS}")


def pack_bits(flags: np.ndarray, width: int) -> np.ndarray:
    """Rows of booleans to little-endian 64-bit words."""
    out = np.zeros((*flags.shape[:-1], width * 64), dtype=bool)
    out[..., : flags.shape[-1]] = flags
    return np.packbits(out, axis=-1, bitorder="little").view(np.uint64)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    values = np.array(rows["v"].tolist(), dtype=np.int64)
    low = values.min(axis=0)
    digits = max(1, int((values.max(axis=0) - low).max()).bit_length())
    width = -(-len(values) // 64)
    slices = np.stack([pack_bits((((values - low).T >> b) & 1).astype(bool), width) for b in range(digits)], axis=1)
    return pd.DataFrame(
        {
            "block": [int(rows["block"].iloc[0])],
            "dims": [values.shape[1]],
            "digits": [digits],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
            "low": [low.tobytes()],
            "slices": [slices.tobytes()],
        }
    )


INDEX = "block long, dims int, digits int, ids binary, low binary, slices binary"


def build_index(vectors: DataFrame, scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of bitmap slices over all usable vectors."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    good = good.where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    size = F.pow(largest(F.col("e"), scale), F.lit(2)) * F.size("e")
    good = materialise(good.select("vec_id", F.size("e").alias("dims"), quantise(F.col("e"), scale).alias("v"), size.alias("size")), "quantised")
    n, size = good.agg(F.count(F.lit(1)), F.max("size")).first()
    checked(size)
    # Rows are dealt by a hash of the whole row, so that no block gets far more than its share.
    rows = F.greatest(F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_CELLS) / F.col("dims"))), F.lit(64))
    own = F.pmod(F.xxhash64("vec_id", "v"), F.greatest(F.ceil(F.lit(n * 9 / 8) / rows), F.lit(1)))
    good = good.drop("size")
    return materialise(good.withColumn("block", own).groupBy("block", "dims").applyInPandas(_index, INDEX), "index")


def add(bitmaps: dict[int, list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Sum of weighted bitmaps; keys are powers of two.  Slices from the least digit up."""
    out, level = [], 0
    while bitmaps:
        here = bitmaps.pop(level, [])
        stack = np.stack(here) if here else np.zeros((0, width), np.uint64)
        carried = []
        while len(stack) > 1:
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
                break
            k = len(stack) // 3
            a, b, c, rest = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k], stack[3 * k :]
            t = a ^ b
            carried.append((a & b) | (t & c))
            t ^= c
            stack = np.concatenate([t, rest]) if len(rest) else t
        out.append(stack[0] if len(stack) else np.zeros(width, np.uint64))
        if carried:
            bitmaps.setdefault(level + 1, []).extend(x for c in carried for x in c)
        level += 1
    return out


def top(slices: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums, ties by row, from the most significant slice down."""
    count = lambda x: int(np.bitwise_count(x).sum())
    sure, open_ = np.zeros_like(valid), valid
    have = 0
    for s in reversed(slices):
        high = open_ & s
        n = count(high)
        if have + n > k:
            open_ = high
        else:
            sure |= high
            have += n
            open_ = open_ & ~s
        if have == k:
            break
    rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(open_)[: k - have] if have < k else np.zeros(0, np.int64)])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                dims, digits = get("dims"), get("digits")
                ids = np.frombuffer(get("ids"), np.int64)
                low = np.frombuffer(get("low"), np.int64)
                width = -(-len(ids) // 64)
                if loaded is None or loaded[0] != (get("block"), dims):
                    plain = np.frombuffer(get("slices"), np.uint64).reshape(dims, digits, width)
                    loaded = ((get("block"), dims), np.stack([plain, ~plain]))
                both = loaded[1]
                full = pack_bits(np.ones((1, len(ids)), bool), width)[0]
                queries, vectors, numbers = get("query_ids"), get("queries"), get("numbers")
                out: list[tuple] = []
                for query, vector, number in zip(queries, vectors, numbers):
                    q = np.array(vector, dtype=np.int64)
                    # A negative factor takes the complement: q * v = |q| * (top - v) + q * top.
                    side = (q < 0).astype(int)
                    base = int((q * (low + np.where(q < 0, (1 << digits) - 1, 0))).sum())
                    bitmaps: dict[int, list] = {}
                    size = np.abs(q)
                    for j in range(int(size.max()).bit_length() if len(size) else 0):
                        for d in np.flatnonzero(size >> j & 1):
                            for b in range(digits):
                                bitmaps.setdefault(j + b, []).append(both[side[d], d, b])
                    sums = add(bitmaps, width) if bitmaps else [np.zeros(width, np.uint64)]
                    a, b = np.searchsorted(ids, [query, query + 1]) if query < 2**63 - 1 else np.searchsorted(ids, [query, query], "left")
                    valid = full.copy()
                    for own in range(int(a), int(b)):
                        valid[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                    rows = top(sums, valid, k)
                    totals = np.zeros(len(rows), dtype=np.int64)
                    for level, s in enumerate(sums):
                        totals += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << level
                    out += [(number, query, int(ids[r]), int(t) + base) for r, t in zip(rows, totals)]
                if out:
                    names = ["number", "query_id", "vec_id", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """The k best of all indexed vectors for each query row: query_id, rank, vec_id, score."""
    good = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("e"))
    good = good.where(F.col("query_id").isNotNull() & usable(F.col("e")))
    size = F.pow(largest(F.col("e"), scale), F.lit(2)) * F.size("e")
    good = good.select("query_id", F.size("e").alias("dims"), quantise(F.col("e"), scale).alias("q"), size.alias("size"))
    good = materialise(good.withColumn("number", F.monotonically_increasing_id()), "queries")
    n, size = good.agg(F.count(F.lit(1)), F.max("size")).first()
    checked(size)
    chunks = max(1, -(-n // CHUNK))
    asked = good.groupBy("dims", F.pmod(F.xxhash64("number"), F.lit(chunks)).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("number", "query_id", "q"))).alias("of")
    )
    # Every chunk meets every block; where blocks are few, copies of a block share the chunks out.
    blocks = materialise(index.select("block", "dims"), "blocks")
    spread = max(1, min(chunks, TASKS_PER_CORE * index.sparkSession.sparkContext.defaultParallelism // max(1, blocks.count())))
    met = bounded_join(asked, blocks, ["dims"], "inner").withColumn("copy", F.pmod("chunk", F.lit(spread)))
    copies = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    units = met.hint("shuffle_hash").join(copies, ["block", "dims", "copy"]).select(
        "block", "dims", "digits", "ids", "low", "slices", F.col("of.number").alias("numbers"), F.col("of.query_id").alias("query_ids"), F.col("of.q").alias("queries")
    )
    found = units.mapInArrow(_search(k), "number long, query_id long, vec_id long, score long")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    ranked = materialise(found, "found").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
