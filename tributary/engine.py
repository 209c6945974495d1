"""The whole analysis of a repository, and questions to its result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators import aggregates, extract, graph, incremental, reports, semantic, sql_lineage
from tributary.operators.cut import cut
from tributary.sources import files as sources

#: Files whose edges only declare a dataset.
CONFIG = r"\.ya?ml$"

@dataclass
class Analysis:
    """Tables of one run."""

    sha: str
    modules: DataFrame
    module_edges: DataFrame
    functions: DataFrame
    data_nodes: DataFrame
    transformations: DataFrame
    lineage_edges: DataFrame
    columns: DataFrame
    warnings: DataFrame
    hashes: DataFrame
    extra: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if isinstance(v, DataFrame)}

    def write(self, folder: str) -> None:
        """Every table as Parquet, the two graphs as JSON lines, the overview and a flowchart as text, and a catalogue of all these."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        groups = graph.strong_components(self.module_edges)
        lines = reports.module_graph_json(self.modules.select("identity", "pagerank_score", "layer"), self.module_edges.select("source", "target", "type"), groups, self.sha)
        lines.write.mode("overwrite").json(f"{folder}/module_graph_json")
        lines = reports.lineage_json(self.data_nodes, self.transformations, self.lineage_edges, self.columns, self.sha)
        lines.write.mode("overwrite").json(f"{folder}/lineage_graph_json")
        text = self.modules.sparkSession.createDataFrame([(self.overview(),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{folder}/overview")
        brief = self.modules.sparkSession.createDataFrame([(self.brief_text(),)], "value string")
        brief.coalesce(1).write.mode("overwrite").text(f"{folder}/brief")
        reports.write_mermaid(self.data_nodes, self.lineage_edges, f"{folder}/lineage_chart")
        written = [*self.tables(), "module_graph_json", "lineage_graph_json", "overview", "brief", "lineage_chart"]
        reports.catalogue(self.modules.sparkSession, self.sha, folder, written).coalesce(1).write.mode("overwrite").json(f"{folder}/catalogue")

    def sections(self) -> dict[str, DataFrame]:
        """The overview's tables, each in its order."""
        m = self.modules.withColumn("path", F.col("identity"))
        return {
            "Critical path": graph.critical_path(self.module_edges).orderBy("place"),
            "Sources and sinks": reports.sources_and_sinks(self.data_nodes).orderBy("role", "name"),
            "High velocity files": aggregates.high_velocity(m.select("path", "commit_count")),
            "Inventory": reports.inventory(m),
            "Debt": reports.debt(m).orderBy("path", "kind"),
            "Purposes by domain": aggregates.domain_index(m, "domain", "path").orderBy("domain", "place"),
        }

    def overview(self) -> str:
        return reports.overview(self.sections())

    def brief_text(self) -> str:
        """The day-one brief as a document, with evidence cited by file and line."""
        counts = {"modules": self.modules.count(), "module_edges": self.module_edges.count(), "datasets": self.data_nodes.count(), "transformations": self.transformations.count(), "lineage_edges": self.lineage_edges.count()}
        return semantic.brief_text(semantic.packets(self.modules, self.functions), counts)

    def brief(self, k: int = 5) -> DataFrame:
        counts = {"modules": self.modules.count(), "module_edges": self.module_edges.count(), "datasets": self.data_nodes.count()}
        return semantic.day_one(self.modules, counts, k)


class Engine:
    """Analyses repositories and answers questions about them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def analyze(self, root: str, previous: Analysis | None = None, overrides: DataFrame | None = None, days: int = 30) -> Analysis:
        spark = self.spark
        sha = sources.head(root)
        files = cut(sources.scan(spark, root))
        python = files.where("language = 'py'")
        functions = cut(extract.apply_udtf(python, extract.PythonFunctions))
        hashes = cut(extract.apply_udtf(python, extract.PythonHashes).unionByName(files.where("language <> 'py'").select("path", F.sha2("content", 256).alias("ast_hash"), F.sha2("content", 256).alias("signature_hash"))))

        # Module graph: what is imported or referred to leads to who does so.
        order = sources.in_reading_order(files.select("identity", "path"))
        nodes = order.select("identity", "seq")
        asked = extract.apply_udtf(python, extract.PythonImports).select(F.col("path").alias("importer"), "name", "type", F.lit(0).alias("seq"))
        refs = extract.jinja_refs(files.where("language in ('sql', 'yml', 'yaml')")).where("type in ('dbt_ref', 'dbt_source')")
        refs = refs.select(F.col("path").alias("importer"), F.regexp_extract("name", r"([^.]*)$", 1).alias("name"), "type", F.lit(1).alias("seq"))
        edges = cut(graph.last_wins(graph.resolve_imports(asked.unionByName(refs), nodes)).select("source", "target", "type"))

        complexity = aggregates.module_complexity(functions)
        sql_own = files.where("language = 'sql'").select("path", extract.sql_complexity(F.col("content")).alias("complexity_score"), F.lit(False).alias("is_high_complexity"))
        complexity = complexity.select("path", F.col("complexity_score").cast("double"), "is_high_complexity").unionByName(sql_own)
        churned = aggregates.churn(sources.git_log(spark, root, days))
        modules = files.drop("content").join(complexity, "path", "left").fillna(0.0, ["complexity_score"]).fillna(False, ["is_high_complexity"])
        modules = cut(aggregates.with_metrics(modules, churned))
        ranks = cut(graph.pagerank(*graph.executable(modules, edges)))
        modules = modules.join(graph.flags(modules.select("identity", "is_informational", "layer"), edges, ranks), "identity")
        docs = python.select("path", F.regexp_extract("content", r'^\s*"""([^"]*)"""', 1).alias("docstring"))
        named = functions.groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("functions"))
        imported = asked.groupBy(F.col("importer").alias("path")).agg(F.sort_array(F.collect_set("name")).alias("imports"))
        described = files.select("path").join(docs, "path", "left").join(named, "path", "left").join(imported, "path", "left")
        none = F.array().cast("array<string>")
        described = described.select("path", F.expr("nullif(docstring, '')").alias("docstring"), F.coalesce("functions", none).alias("functions"), F.coalesce("imports", none).alias("imports"))
        purpose = semantic.purposes(described).withColumnsRenamed({"purpose": "purpose", "confidence": "purpose_confidence"})
        modules = modules.join(purpose, "path", "left")
        vectors = cut(modules.select("identity", "purpose_confidence", semantic.hashed_embedding(F.col("purpose")).alias("embedding")))
        modules = modules.join(semantic.cluster(vectors), "identity", "left").join(vectors.select("identity", "embedding"), "identity")
        said = described.where("docstring is not null").select("path", semantic.hashed_embedding(F.col("docstring")).alias("docstring_embedding"))
        modules = semantic.drift(modules.join(said, "path", "left").withColumn("purpose_embedding", F.col("embedding"))).drop("docstring_embedding", "purpose_embedding")
        stale = None
        if overrides is not None:
            modules, stale = aggregates.apply_overrides(modules, overrides)
        if previous is not None:
            modules = aggregates.merge_previous(modules, previous.modules, ["purpose", "domain"])
        modules = cut(modules)

        # Data lineage.  Only SQL passes the driver: Spark's parser lives there.
        ordered = order.join(files.select("path", "content"), "path").where("path like '%.sql'").orderBy("seq").select("path", "content")
        found = sql_lineage.analyse(spark, [(r["path"], r["content"]) for r in ordered.toLocalIterator()])
        constants = extract.apply_udtf(python, extract.PythonConstants).join(order.select("path", "seq"), "path").select("name", "value", "seq")
        raw = found["edges"].select("source", "target", "type", "confidence_score", F.lit(None).cast("string").alias("source_module"))
        raw = raw.unionByName(extract.python_edges(python, constants).select(raw.columns)).unionByName(extract.config_edges(files).select(raw.columns))
        data, transformations, lineage = self._lineage(cut(raw), sources.seeds(files), found["columns"])
        known = aggregates.complete_schema(data, aggregates.inferred_columns(found["columns"].select("target", "source")))
        by_config = F.col("source").rlike(CONFIG)
        warnings = graph.integrity(data, transformations, lineage.where(~by_config), declared=lineage.where(by_config))
        return Analysis(sha, modules, edges, functions, data, transformations, lineage, found["columns"], cut(warnings), hashes, {"stale_overrides": stale, "operations": found["operations"], "dataset_columns": known})

    def _lineage(self, raw: DataFrame, seeds: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Resolve datasets, drop self-loops, and type the nodes."""
        ends = raw.select(F.col("source").alias("raw"), "confidence_score").union(raw.select("target", "confidence_score"))
        sets = ends.where(names.is_dataset(F.col("raw"))).groupBy("raw").agg(F.min("confidence_score").alias("least"))
        uri = F.col("raw").contains("://")
        ns = F.when(F.col("raw").contains(":"), F.substring_index("raw", ":", 1)).otherwise("unknown")
        ns = F.when(ns == "table", "unknown").otherwise(ns)
        bare = F.when(F.col("raw").contains(":") & ~uri, F.regexp_replace("raw", r"^[^:]*:", "")).otherwise(F.col("raw"))
        sets = sets.withColumn("namespace", ns).withColumn("name", bare).withColumn("canon", names.short_name(bare))
        # raw_x stands for x where only raw_x is known otherwise.
        known = sets.select(F.col("canon").alias("raw_canon")).where("raw_canon like 'raw\\_%'").distinct()
        sets = cut(sets.join(known, F.concat(F.lit("raw_"), "canon") == F.col("raw_canon"), "left").withColumn("canon", F.when(F.col("namespace").isin("unknown", "dbt"), F.coalesce("raw_canon", "canon")).otherwise(F.col("canon"))).drop("raw_canon"))
        to = sets.select("raw", "canon")
        resolved = raw.join(to.withColumnsRenamed({"raw": "source", "canon": "s"}), "source", "left").join(to.withColumnsRenamed({"raw": "target", "canon": "t"}), "target", "left")
        resolved = resolved.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "type", "confidence_score", "source_module").where("source <> target")
        sure = names.edge_confidence(F.col("confidence_score"), F.col("source_module"), F.col("source"), F.col("target"))
        edges = cut(graph.last_wins(resolved.withColumn("confidence_score", sure), "confidence_score"))
        flow = edges.where(~F.col("source").rlike(CONFIG))

        stems = columns.select(names.table_name(F.col("path")).alias("canon")).distinct().withColumn("discovered", F.lit(True))
        data = sets.groupBy(F.col("canon").alias("identity")).agg(F.min_by(F.struct("name", "namespace", "least"), "raw").alias("x")).select("identity", "x.*")
        data = data.join(stems.withColumnRenamed("canon", "identity"), "identity", "left").join(seeds.select(F.col("dataset").alias("identity"), F.col("system").alias("mapped")), "identity", "left")
        found = F.coalesce("discovered", F.lit(False))
        kind = names.system(F.col("name"), F.col("namespace"), F.col("mapped"), found)
        dynamic = names.is_dynamic(F.col("name"), F.col("least"))
        data = data.select(
            "identity", "name", F.when(F.col("namespace") == "unknown", kind).otherwise(F.col("namespace")).alias("namespace"), kind.alias("system"),
            names.environment(F.col("name")).alias("environment"), names.dataset_type(kind).alias("type"), names.table_name(F.col("name")).alias("table"),
            dynamic.alias("is_dynamic_reference"), names.dataset_confidence(found.cast("int"), F.lit(False), dynamic).alias("dataset_type_confidence"),
        )
        data = graph.roles(data, flow)
        data = cut(data.join(graph.distance_importance(data, flow), "identity"))
        code = edges.select(F.col("source").alias("identity")).union(edges.select("target")).distinct().join(data, "identity", "left_anti")
        script = F.col("identity").endswith(".py")
        code = code.select("identity", names.basename(F.col("identity")).alias("name"), F.when(F.col("identity").startswith("cte:"), "CTE_SCOPE").when(script, "PYTHON_SCRIPT").otherwise("DBT_MODEL").alias("type"), F.when(script, "python").otherwise("dbt").alias("namespace"))
        return data, cut(code), edges

    def changed(self, now: Analysis, before: Analysis) -> DataFrame:
        """Paths to analyse again: changed ones, neighbours of changed signatures, and ones without a purpose."""
        a = now.hashes.select("path", F.col("ast_hash").alias("hash"))
        b = before.hashes.select("path", F.col("ast_hash").alias("hash"))
        missing = now.modules.where("purpose is null").select(F.col("identity").alias("path"))
        return incremental.reanalyse(a, b, now.module_edges, missing)

    def query(self, found: Analysis, question: str) -> DataFrame:
        """Send a question to the tool that its words ask for."""
        tool = semantic.route(question)
        word = next((w for w in reversed(question.replace("?", " ").split()) if "." in w or "_" in w), question.split()[-1].strip("?"))
        if tool == "trace_lineage":
            ids = found.data_nodes.select("identity").union(found.transformations.select("identity"))
            start = graph.find_start(ids, word).first()
            up = "upstream" in question.lower() or "feeds" in question.lower()
            return graph.trace(found.lineage_edges, start[0] if start else word, upstream=up).orderBy("distance", "node")
        if tool == "blast_radius":
            start = graph.find_start(found.modules.select("identity"), word).first()
            return graph.weighted_impact(found.module_edges, found.modules, start[0] if start else word).orderBy("distance", "node")
        if tool == "explain_module":
            return self.explain(found, word)
        asked = self.spark.range(1).select(semantic.hashed_embedding(F.lit(question)).alias("v")).first()["v"]
        near = semantic.vector_search(found.modules, asked).where("similarity > 0").select("identity", F.col("similarity").alias("score"))
        if not near.isEmpty():
            return near
        parts = [(F.col("purpose"), 3), (F.col("path"), 2), (F.col("identity"), 1)]
        return semantic.keyword_search(found.modules, question, parts)

    def lineage(self, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The data lineage of a repository by itself: datasets, transformations, edges."""
        found = self.analyze(root)
        return found.data_nodes, found.transformations, found.lineage_edges

    def explain(self, found: Analysis, module: str) -> DataFrame:
        """Static summary: ten fields, the first ten functions."""
        own = found.functions.groupBy("path").agg(F.slice(F.sort_array(F.collect_set("signature")), 1, 10).alias("functions"))
        rows = found.modules.where(F.lower("identity").contains(module.lower())).orderBy("identity").limit(1)
        cited = names.citation(F.col("path"), F.lit("static_analysis"), F.lit(1.0), F.lit(1)).alias("citation")
        return rows.join(own, "path", "left").select(cited, "identity", "language", "layer", "purpose", "complexity_score", "pagerank_score", "importance_score", "is_architectural_hub", "commit_count", "functions")


def analyze(spark: SparkSession, root: str, **options) -> Analysis:
    return Engine(spark).analyze(root, **options)
