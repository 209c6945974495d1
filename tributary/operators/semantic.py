"""Search, clustering and drift over module descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators.aggregates import budget_gate

DRIFT = 0.65


def vector_search(rows: DataFrame, query: list[float], k: int = 5, key: str = "identity") -> DataFrame:
    """The k rows most like a query vector, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(key, F.round(names.cosine(F.col("embedding"), q), 3).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def keyword_search(rows: DataFrame, question: str, weighted: list[tuple[Column, int]], k: int = 5, key: str = "identity") -> DataFrame:
    """The k rows with the highest keyword score above zero, ties by key."""
    score = names.keyword_score(names.terms(F.lit(question)), weighted)
    return rows.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def drift(modules: DataFrame) -> DataFrame:
    """documentation_drift: whether docstring and purpose part; null without a docstring."""
    apart = names.cosine(F.col("docstring_embedding"), F.col("purpose_embedding")) < DRIFT
    return modules.withColumn("documentation_drift", F.when(F.col("docstring_embedding").isNotNull(), apart))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic vector: words counted by hash.  Stands in where no model is at hand."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def cluster(rows: DataFrame, threshold: float = 0.0, key: str = "identity", k: int | None = None) -> DataFrame:
    """Domain of every module by K-means on vectors divided by each dimension's deviation.

    Modules below the confidence threshold are 'Unclassified'; below four
    eligible modules all are 'Unclustered'.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    eligible = rows.where(F.coalesce("purpose_confidence", F.lit(0.0)) >= threshold)
    n = eligible.count()
    other = rows.join(eligible.select(key), key, "left_anti").select(key, F.lit("Unclassified").alias("domain"))
    if n < 4:
        return eligible.select(key, F.lit("Unclustered").alias("domain")).unionByName(other)
    vectors = eligible.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withStd=True, withMean=False).fit(vectors).transform(vectors)
    model = KMeans(k=k or names.cluster_count(n), seed=42, maxIter=20, featuresCol="features", predictionCol="c").fit(scaled)
    found = model.transform(scaled).select(key, F.concat(F.lit("Cluster_"), F.col("c").cast("string")).alias("domain"))
    return found.unionByName(other)


def cluster_samples(rows: DataFrame, most: int = 10, key: str = "identity") -> DataFrame:
    """Up to ten members of each domain, in order of key, to name it by."""
    place = Window.partitionBy("domain").orderBy(key)
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)


def purposes(modules: DataFrame, describe: Callable | None = None, batch: int = 10, budget: float | None = None) -> DataFrame:
    """Purpose and confidence of every module, from ``describe`` or by rule.

    With a budget, ``describe`` sees modules in order of path as long as the cost
    of those before, estimated by their texts, stays below it.

    ``describe`` maps a pandas frame of at most ``batch`` rows (path, docstring,
    functions, imports) to one of path, purpose, confidence; what it leaves out
    or null is filled by rule.
    """
    rule = names.heuristic_purpose(F.col("path"), F.col("docstring"), F.col("functions"), F.col("imports"))
    plain = modules.select("path", "docstring", "functions", "imports", rule.alias("r"))
    if describe is None:
        return plain.select("path", F.col("r.purpose").alias("purpose"), F.col("r.confidence").alias("confidence"))

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                yield describe(frame.iloc[at : at + batch])

    asked = modules.select("path", "docstring", "functions", "imports")
    if budget is not None:
        text = F.concat_ws(" ", "path", "docstring", F.array_join("functions", " "), F.array_join("imports", " "))
        costs = modules.select(F.col("path").alias("seq"), names.token_cost(names.token_estimate(text)).alias("cost"))
        asked = asked.join(budget_gate(costs, budget).where("allowed").select(F.col("seq").alias("path")), "path", "left_semi")
    said = asked.mapInPandas(run, "path string, purpose string, confidence double")
    said = said.withColumnsRenamed({"purpose": "p", "confidence": "c"})
    out = plain.join(said, "path", "left")
    return out.select("path", F.coalesce("p", "r.purpose").alias("purpose"), F.when(F.col("p").isNull(), F.col("r.confidence")).otherwise(F.coalesce("c", F.lit(0.5))).alias("confidence"))


def packets(modules: DataFrame, functions: DataFrame, most: int = 20, each: int = 3) -> DataFrame:
    """Evidence for a brief: the first modules by rank that have a purpose, with the first lines of up to three functions.

    functions: path, name, line.
    """
    top = modules.where("purpose is not null").orderBy(F.desc("pagerank_score"), "identity").limit(most).select("identity", "path", "purpose", "pagerank_score")
    nth = Window.partitionBy("path").orderBy("line", "name")
    first = functions.join(F.broadcast(top.select("path")), "path", "left_semi").withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= each)
    cited = first.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("lines"))
    lines = F.coalesce("lines", F.array(F.lit(1)))
    return top.join(cited, "path", "left").select("identity", "purpose", "pagerank_score", F.transform(lines, lambda n: F.concat(F.lit("["), F.col("path"), F.lit(":"), n.cast("string"), F.lit("]"))).alias("evidence")).orderBy(F.desc("pagerank_score"), "identity")


def brief_text(found: DataFrame, counts: dict[str, int]) -> str:
    """The brief as a document; found: packets(), at most as many rows as these allow."""
    lines = ["# Day-one brief", "", "## What was analysed", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in counts.items()], "", "## Modules by rank", ""]
    lines += [f"- **{r['identity']}**: {r['purpose']} {' '.join(r['evidence'])}" for r in found.collect()]
    return "\n".join(lines) + "\n"


def day_one(modules: DataFrame, counts: dict[str, int], k: int = 5) -> DataFrame:
    """The brief without a language model: the first k modules by rank, with the graph's counts."""
    rows = modules.orderBy(F.desc("pagerank_score"), "identity").limit(k)
    return rows.select("identity", "purpose", *[F.lit(v).alias(c) for c, v in counts.items()])


# Words that send a question to a tool.
ROUTES = (("blast_radius", r"impact|break|blast|affect|depend"), ("trace_lineage", r"lineage|upstream|downstream|trace|feeds|source of"), ("explain_module", r"explain|what does|describe"))


def route(question: str) -> str:
    """The tool for a question, by its words; searching when none is telling."""
    import re

    return next((tool for tool, words in ROUTES if re.search(words, question.lower())), "find_implementation")
