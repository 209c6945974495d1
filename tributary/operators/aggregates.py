"""Churn, dashboard, domain and identity aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.cut import cut

VELOCITY_DAYS = 30.0


def churn(commits: DataFrame) -> DataFrame:
    """path, commits, authors, velocity (commits over 30 days)."""
    return commits.groupBy("path").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.countDistinct("author").alias("unique_authors"),
        (F.count(F.lit(1)) / VELOCITY_DAYS).alias("velocity"),
    )


def since_last(commits: DataFrame, days: int = 30) -> DataFrame:
    """Commits of the last days before the newest one."""
    newest = commits.agg(F.max("ts").alias("newest"))
    return commits.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS")).drop("newest")


def logic_velocity(commits: DataFrame, threshold: int = 3) -> DataFrame:
    """Churn by commits that change at least ``threshold`` lines and no binary."""
    real = commits.where("added is not null and deleted is not null").where(F.col("added") + F.col("deleted") >= threshold)
    return real.groupBy("path").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.countDistinct("author").alias("unique_authors"),
        F.max("ts").alias("last_modified"),
        F.max_by("author", F.struct("ts", "sha")).alias("last_author"),
    )


def high_velocity(churned: DataFrame, threshold: int = 5) -> DataFrame:
    return churned.where(F.col("commit_count") > threshold).orderBy(F.desc("commit_count"), "path")


def with_metrics(files: DataFrame, churned: DataFrame) -> DataFrame:
    """Files with their churn, zero where there is none."""
    return files.join(churned, "path", "left").fillna(0, ["commit_count", "unique_authors"]).fillna(0.0, ["velocity"])


def module_complexity(functions: DataFrame) -> DataFrame:
    return functions.groupBy("path").agg(F.sum("complexity").alias("complexity_score"), F.bool_or(F.col("complexity") > 10).alias("is_high_complexity"))


def dashboard(modules: DataFrame, module_edges: DataFrame, data: DataFrame, lineage_edges: DataFrame) -> DataFrame:
    m = modules.agg(F.count(F.lit(1)).alias("modules"), F.count_if("is_architectural_hub").alias("hubs"), F.count_if("is_dead_code_candidate").alias("dead"))
    out = m
    for df, name in ((module_edges, "edges"), (data, "data_nodes"), (lineage_edges, "lineage_edges")):
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))
    return out


def domain_counts(modules: DataFrame, domain: str = "domain") -> DataFrame:
    return modules.groupBy(F.coalesce(domain, F.lit("General")).alias("domain")).agg(F.count(F.lit(1)).alias("modules"))


def domain_index(modules: DataFrame, domain: str = "domain", member: str = "path") -> DataFrame:
    """Members of each domain in order; one row each, so that a large domain is no single row."""
    rows = modules.select(F.coalesce(domain, F.lit("General")).alias("domain"), F.col(member).alias("member"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("member")))


def majority_domain(produced: DataFrame) -> DataFrame:
    """The commonest domain among each dataset's producers; ties by name, 'Unknown' without any."""
    counted = produced.where("domain is not null").groupBy("dataset", "domain").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("dataset").agg(F.min(F.struct(-F.col("n"), F.col("domain").alias("domain"))).alias("b"))
    out = produced.select("dataset").distinct().join(best, "dataset", "left")
    return out.select("dataset", F.coalesce("b.domain", F.lit("Unknown")).alias("domain"))


def identity_registry(names: DataFrame) -> DataFrame:
    """canonical_name with its namespaces and raw names."""
    return names.groupBy("canonical_name").agg(F.sort_array(F.collect_set("namespace")).alias("namespaces"), F.sort_array(F.collect_set("raw_name")).alias("aliases"))


def merge_column_lineage(lineage: DataFrame) -> DataFrame:
    """Union of sources for each target column, in order."""
    return lineage.groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def inferred_columns(lineage: DataFrame) -> DataFrame:
    """Columns of base tables, as other tables' columns ask for them."""
    parts = F.split("source", r"\.")
    rows = lineage.select(parts[0].alias("dataset"), F.lower(F.try_element_at(parts, F.lit(2))).alias("column")).where("column is not null and column <> '*'")
    return rows.distinct()


def complete_schema(data: DataFrame, columns: DataFrame) -> DataFrame:
    """Inferred columns by exact identity (0.7), else by the last part of it (0.6)."""
    exact = data.select("identity").join(columns.withColumnRenamed("dataset", "identity"), "identity").withColumn("confidence", F.lit(0.7))
    rest = data.select("identity").join(exact.select("identity").distinct(), "identity", "left_anti").withColumn("dataset", F.regexp_extract("identity", r"([^:]*)$", 1))
    loose = rest.join(columns, "dataset").select("identity", "column").withColumn("confidence", F.lit(0.6))
    return exact.select("identity", "column", "confidence").unionByName(loose)


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before each, by ``order``.

    Ranges of the order are summed by themselves and their totals, one for each
    range, ahead of them, so no task has to see all rows.
    """
    ranged = cut(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__total"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", F.coalesce(F.sum("__total").over(ahead), F.lit(0.0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(totals, "__range")
    return out.withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))).drop("__range", "__before")


def budget_gate(calls: DataFrame, most: float = 1.0) -> DataFrame:
    """Which of the ordered calls (seq, cost) a budget still allows: those begun below it."""
    return running_total(calls, "seq", "cost", "spent").withColumn("allowed", F.col("spent") < most)


def apply_overrides(modules: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules with purpose, layer and domain replaced, and overrides whose module is gone."""
    o = overrides.select(F.col("module").alias("path"), *[F.col(c).alias(f"__{c}") for c in ("purpose", "layer", "domain")])
    out = modules.join(o, "path", "left")
    for c in ("purpose", "layer", "domain"):
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out, overrides.join(modules.select(F.col("path").alias("module")), "module", "left_anti")


def merge_previous(now: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Fill what is missing now from the previous snapshot, by identity."""
    old = before.select("identity", *[F.col(c).alias(f"__{c}") for c in columns])
    out = now.join(old, "identity", "left")
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in now.columns])
