"""Report sections and exports, each a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Version of what an analysis computes.
ANALYSIS = "2"


def header(spark, sha: str, count: int) -> DataFrame:
    return spark.createDataFrame([(sha, count)], "git_commit string, modules int").withColumn("generated", F.current_timestamp())


def catalogue(spark, sha: str, folder: str, artifacts: list[str]) -> DataFrame:
    """One row for each artifact: its name and path, commit, schema and analysis version, and time."""
    rows = spark.createDataFrame([(a, f"{folder}/{a}", sha) for a in artifacts], "artifact string, path string, git_commit string")
    return rows.withColumn("schema_version", F.lit("1")).withColumn("analysis_version", F.lit(ANALYSIS)).withColumn("generated", F.current_timestamp())


def sources_and_sinks(data: DataFrame, k: int = 10) -> DataFrame:
    columns = ["role", "name", "system", "environment", "namespace"]
    first = data.where("role = 'SOURCE'").orderBy("name").limit(k)
    return first.select(columns).unionByName(data.where("role = 'TERMINAL'").orderBy("name").limit(k).select(columns))


@F.udf(StringType())
def _three_places(x):
    """As printf('%.3f') has it: from the exact binary value, with the sign of -0.0, nan and inf; null of null."""
    return None if x is None else f"{x:.3f}"


def inventory(modules: DataFrame, unknown: str | None = "Unknown") -> DataFrame:
    """One row for each module; unknown stands for a domain that is null."""
    mark = F.when(F.col("documentation_drift"), "⚠").when(~F.col("documentation_drift"), "✅").otherwise("—")
    domain = F.coalesce("domain", F.lit(unknown))
    return modules.select(domain.alias("domain"), "path", _three_places(F.col("pagerank_score").cast("double")).alias("pagerank"), mark.alias("drift"), "purpose").orderBy("domain", "path")


def debt(modules: DataFrame) -> DataFrame:
    """One row for each flag a module carries."""
    flag = lambda column, kind, level: F.when(F.col(column), F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("severity")))
    found = F.array_compact(F.array(flag("is_high_complexity", "high_complexity", "Medium"), flag("is_dead_code_candidate", "dead_code", "Low"), flag("is_architectural_hub", "hub", "High")))
    return modules.select("path", F.explode(found).alias("f")).select("path", "f.kind", "f.severity")


def top(modules: DataFrame, column: str, k: int, key: str = "identity") -> DataFrame:
    return modules.orderBy(F.desc(column), key).limit(k)


def module_graph_json(nodes: DataFrame, edges: DataFrame, groups: DataFrame, sha: str = "") -> DataFrame:
    """One JSON line for each node, edge, hub and component group, in a stable order.

    Columns: section, seq within it, json.  Lines, not one document, so that the
    export is written by all executors.
    """
    line = lambda df, section, order: df.select(F.lit(section).alias("section"), F.concat_ws("\x01", *order).alias("key"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))
    hubs = nodes.orderBy(F.desc("pagerank_score"), "identity").limit(10).select("identity", "pagerank_score")
    parts = [line(nodes, "nodes", ["identity"]), line(edges, "edges", ["source", "target"]), line(hubs, "hubs", ["identity"]), line(groups, "groups", ["component", "identity"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("git_commit", F.lit(sha)).withColumn("schema_version", F.lit("1")).orderBy("section", "key").drop("key")


def lineage_json(data: DataFrame, transformations: DataFrame, edges: DataFrame, columns: DataFrame, sha: str = "") -> DataFrame:
    """The lineage graph as JSON lines in a stable order; columns' sources merged for each target."""
    from tributary.operators.aggregates import merge_column_lineage

    merged = merge_column_lineage(columns.select(F.concat_ws(".", "path", "target").alias("target"), "source"))
    parts = (("data", data, ["identity"]), ("transformations", transformations, ["identity"]), ("edges", edges, ["source", "target"]), ("columns", merged, ["target"]))
    out = None
    for name, df, order in parts:
        lines = df.select(F.lit(name).alias("section"), F.concat_ws("\x01", *order).alias("key"), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("json"))
        out = lines if out is None else out.unionByName(lines)
    return out.withColumn("git_commit", F.lit(sha)).withColumn("schema_version", F.lit("1")).orderBy("section", "key").drop("key")


def module_summaries(files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, constants: DataFrame, docstrings: DataFrame) -> DataFrame:
    """One row for each file with its docstring, what it defines and imports, in order, and its lines."""
    gather = lambda df, name: df.groupBy("path").agg(F.sort_array(F.collect_set("name")).alias(name))
    out = files.select("path", "language", F.struct(F.lit(1).alias("start"), (F.regexp_count("content", F.lit("\n")) + 1).alias("end")).alias("line_range"))
    out = out.join(docstrings.groupBy("path").agg(F.min("docstring").alias("docstring")), "path", "left")
    for df, name in ((functions, "functions"), (classes, "classes"), (imports, "imports"), (constants, "constants")):
        out = out.join(gather(df, name), "path", "left")
    return out


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a flowchart: nodes by role, dashed edges below confidence 0.5."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    n = nodes.select(F.concat(F.lit("0"), F.coalesce("role", F.lit("TRANSFORMATION"))).alias("part"), F.concat(F.lit("    "), safe(F.col("identity")), F.lit('["'), F.col("identity"), F.lit('"]')).alias("line"))
    arrow = F.when(F.col("confidence_score") < 0.5, " -.-> ").otherwise(" --> ")
    e = edges.select(F.lit("1").alias("part"), F.concat(F.lit("    "), safe(F.col("source")), arrow, safe(F.col("target"))).alias("line"))
    return n.unionByName(e)


def mermaid_text(nodes: DataFrame, edges: DataFrame) -> str:
    """The whole flowchart; for graphs small enough to draw."""
    rows = mermaid(nodes, edges).orderBy("part", "line").collect()
    return "\n".join(["flowchart LR", *[r["line"] for r in rows]])


def write_mermaid(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The flowchart of a graph of any size as text files, in order: nodes, then edges."""
    first = nodes.sparkSession.createDataFrame([("", "flowchart LR")], "part string, line string")
    first.unionByName(mermaid(nodes, edges)).orderBy("part", "line").select("line").write.mode("overwrite").text(folder)


def trace_tail(events: DataFrame, k: int = 100, order: str = "seq") -> DataFrame:
    return events.orderBy(F.desc(order)).limit(k)


def trace_filter(events: DataFrame, text: str, columns: list[str]) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return events.where(hit)


def overview_lines(sections: dict[str, DataFrame], title: str = "Technical overview") -> Iterator[str]:
    """Markdown of the sections, every row in the order of its table; the driver holds one partition at a time."""
    yield f"# {title}"
    for name, df in sections.items():
        yield from ("", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns))
        for r in df.toLocalIterator():
            yield "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |"


def overview(sections: dict[str, DataFrame], title: str = "Technical overview") -> str:
    """The whole of overview_lines as one text."""
    return "\n".join(overview_lines(sections, title)) + "\n"
