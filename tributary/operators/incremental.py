"""What changed between snapshots and what to analyse again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.graph import expand_drift


def changed(now: DataFrame, before: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """Paths that are new, have another hash, or stand in the version control's diff."""
    old = before.select("path", F.col("hash").alias("old"))
    rows = now.join(old, "path", "left")
    out = rows.where(~F.col("hash").eqNullSafe(F.col("old"))).select("path")
    if diff is not None:
        out = out.union(now.join(diff, "path", "left_semi").select("path")).distinct()
    return out


def reanalyse(now: DataFrame, before: DataFrame, edges: DataFrame, missing: DataFrame, dependents: bool = True) -> DataFrame:
    """Changed paths, the neighbours of those whose signature changed, and paths with fields missing."""
    again = changed(now, before)
    drifted = again.withColumnRenamed("path", "identity")
    near = expand_drift(edges, drifted, dependents).withColumnRenamed("identity", "path")
    return again.union(near).union(missing.select("path")).distinct()


def upsert(index: DataFrame, fresh: DataFrame, key: str = "identity", version: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """The index with fresh rows in place of old ones, and the rows that had to be made anew.

    Rows whose version the index has already are left alone.
    """
    new = fresh.join(index.select(key, version), [key, version], "left_anti")
    return index.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True), new
