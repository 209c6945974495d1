"""Streams: trace logs, file snapshots, and churn over a rolling window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.incremental import upsert

TRACE = "timestamp timestamp, agent string, event_type string, target_file string, duration_ms long"


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended to a folder of JSON-lines files."""
    return spark.readStream.schema(TRACE).json(folder)


def trace_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events and their mean duration by window, agent and type; late ones within the watermark count."""
    windowed = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "agent", "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("events"), F.avg("duration_ms").alias("mean_ms")).select(F.col("window.start").alias("start"), "agent", "event_type", "events", "mean_ms")


# The kinds of events; others are marked, not refused.
EVENTS = (
    "GRAPH_NODE_CREATED", "GRAPH_EDGE_CREATED", "FILE_PARSED", "SEMANTIC_ENRICHMENT", "LINEAGE_EXTRACTED",
    "LINEAGE_CONFLICT", "DEAD_CODE_DETECTED", "ARTIFACT_GENERATED", "ERROR",
)
#: Events of a file, some 50 MB, after which the next is begun.
FILE_EVENTS = 200_000


def with_known(events: DataFrame) -> DataFrame:
    """Events with known_event, whether their kind is one of EVENTS."""
    return events.withColumn("known_event", F.coalesce(F.col("event_type").isin(*EVENTS), F.lit(False)))


def append_trace(events: DataFrame, folder: str, checkpoint: str):
    """Append a stream of events as JSON lines; files rotate by batch and by number of events."""
    return with_known(events).writeStream.format("json").option("maxRecordsPerFile", FILE_EVENTS).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def incremental_index(files: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str):
    """Keep an index up to date from a stream of (identity, content): only changed rows are made anew."""

    def step(batch: DataFrame, _: int) -> None:
        fresh = batch.groupBy("identity").agg(F.max_by("content", F.length("content")).alias("content"))
        index, _new = upsert(read(), fresh.withColumn("content_hash", F.sha2("content", 256)))
        write(index)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
