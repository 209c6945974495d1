"""Exact deduplication by a stateful stream.

Every row is reduced to a digest of its normalised text, its length and its
locator (file and row).  A streaming aggregation keyed by digest, whose state has
no expiry and lies in an embedded disk store, retains how many rows had the digest
and the identifier and locator of the one to keep.  Rows whose digest was met more
than once are hits: the full normalised texts at their locators are compared, and
where one digest stands for several texts, the groups are formed by text.

A Store keeps digests, state and locators in a folder that the caller names.  Each
batch of documents meets those of all batches before, also in a later session.
deduplicate() is a store of one batch.

Edge cases: null counts as empty.  Texts are equal when identical after
deleting every character of [\\x20\\x09-\\x0D].  The longest original text
stays, then the smallest doc_id (a null doc_id after all others), then one of
the rows that are alike in both.  An empty table gives an empty result.  Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tributary.llm.common import bounded_join, materialise, new_folder, with_row

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Files of digests in a micro-batch.
FILES = 10_000
#: Settings of the stream: state on disk, bounded memory, no space reserved ahead, no empty last batch.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STORE,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    """The text without blanks and the control characters 9 to 13."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\v\f\r", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def best(points: Column, doc_id: Column, locator: Column) -> Column:
    """What max() picks is the row to keep; ~x falls as x grows and never overflows."""
    return F.struct(points.alias("points"), F.bitwise_not(doc_id).alias("behind"), locator.alias("at"))


def deduplicate_stream(rows: DataFrame) -> DataFrame:
    """Streaming aggregation of (digest, points, doc_id, at): rows met and the one to keep."""
    keep = F.max(best(F.col("points"), F.col("doc_id"), F.col("at")))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), keep.alias("keep"))


def reduced(docs: DataFrame, digest) -> DataFrame:
    """doc_id, text, __f, __r to digest, points, doc_id, at."""
    plain = docs.select("doc_id", "__f", "__r", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("plain"))
    return plain.select(digest(F.col("plain")).alias("digest"), "points", "doc_id", F.struct("__f", "__r").alias("at"))


def _run(spark: SparkSession, folder: str, schema: StructType, files: int) -> DataFrame:
    """Feed what is new below a folder's digests to its stream, some files at a time, and read the state."""
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    try:
        for k, v in STREAM_CONF.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{folder}/digests")
        query = (
            deduplicate_stream(stream)
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(f"{folder}/state")
        value = [f"value.{f}" for f in (x.name for x in state.schema["value"].dataType)]
        return materialise(state.select(F.col("key").getField(state.schema["key"].dataType[0].name).alias("digest"), F.col(value[0]).alias("n"), F.col(value[1]).alias("keep")), "groups")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _judged(rows: DataFrame, groups: DataFrame, met: DataFrame, texts, digest) -> DataFrame:
    """Rows with their group; met: the __f and __r of all rows whose digest some of them share with others; texts: their documents."""
    hits = bounded_join(texts, met, ["__f", "__r"], "left_semi", 24)
    hits = hits.select("doc_id", "__f", "__r", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("plain"))
    hits = hits.withColumn("digest", digest(F.col("plain")))
    kinds = hits.groupBy("digest", "plain").agg(F.count(F.lit(1)).alias("n"))
    shared = materialise(kinds.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "shared")
    out = rows.join(groups, "digest").select("doc_id", "digest", "at", "n", "keep")
    if not shared.isEmpty():
        clash = hits.join(shared, "digest", "left_semi").withColumn("at", F.struct("__f", "__r"))
        true = clash.groupBy("digest", "plain").agg(F.count(F.lit(1)).alias("n"), F.max(best(F.col("points"), F.col("doc_id"), F.col("at"))).alias("keep"))
        parts = clash.select("digest", "plain", "at").join(rows.select("doc_id", "digest", "at"), ["digest", "at"]).join(true, ["digest", "plain"]).select("doc_id", "digest", "at", "n", "keep")
        out = out.join(shared, "digest", "left_anti").unionByName(parts)
    return out.select(
        "doc_id",
        F.col("at.__f").alias("__f"),
        F.col("at.__r").alias("__r"),
        F.bitwise_not("keep.behind").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("keep.at")).alias("kept"),
        "digest",
    )


def _typed(docs: DataFrame) -> DataFrame:
    return with_row(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__f", "__r")


def deduplicate(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, __f, __r, keep_id, group_size, kept, digest.

    ``digest`` maps the normalised text to what keys the state.  A weak one
    costs time, not correctness.
    """
    spark = docs.sparkSession
    docs = _typed(docs)
    rows = reduced(docs, digest)
    folder = new_folder(spark, "store")
    rows.write.parquet(f"{folder}/digests/batch")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/digests/batch")
    if rows.isEmpty():
        groups = materialise(deduplicate_stream(rows), "groups")
    else:
        groups = _run(spark, folder, rows.schema, FILES)
    met = materialise(rows.join(groups, "digest").where("n > 1").select("at.__f", "at.__r"), "hits")
    return _judged(rows, groups, met, docs, digest)


class Store:
    """Digests of all batches so far, in a folder that driver and executors share.

    Documents that were read from Parquet files are found again there, so these
    files must stay; of others a copy is kept in the folder.
    """

    def __init__(self, spark: SparkSession, folder: str, digest=sha256, files: int = 1000):
        self.spark, self.folder, self.digest, self.files = spark, folder.rstrip("/"), digest, files

    def _done(self, path: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def _once(self, df: DataFrame, path: str) -> None:
        if not self._done(path):
            df.write.mode("overwrite").parquet(path)

    def add(self, docs: DataFrame, batch: str) -> DataFrame:
        """The rows of a batch, judged with all batches before: the columns of deduplicate().

        group_size and keep_id are as of now.  A batch of a known name is not
        counted again, so a call that was cut short can be repeated.
        """
        spark, folder = self.spark, self.folder
        plan = docs._jdf.queryExecution().analyzed().toString().strip().splitlines()
        if len(plan) > 1 or not docs.inputFiles():
            self._once(docs.select("doc_id", "text"), f"{folder}/rows/{batch}")
            docs = spark.read.parquet(f"{folder}/rows/{batch}")
        docs = _typed(docs)
        rows = reduced(docs, self.digest)
        own = f"{folder}/digests/{batch}"
        self._once(docs.select("__f", F.col("_metadata.file_path").alias("path")).distinct(), f"{folder}/files/{batch}")
        self._once(rows, own)
        groups = _run(spark, folder, rows.schema, self.files)
        rows, all_rows = (spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(x) for x in (own, f"{folder}/digests"))
        digests = materialise(rows.join(groups.where("n > 1"), "digest").select("digest").distinct(), "met")
        met = materialise(bounded_join(all_rows, digests, ["digest"], "left_semi", 64).select("at.__f", "at.__r"), "hits")
        # Only files with hits are read; their names are as many as Spark lists for such a read.
        files = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/files").join(met.select("__f").distinct(), "__f")
        paths = sorted(r["path"] for r in files.select("path").distinct().collect())
        texts = _typed(spark.read.parquet(*paths).select("doc_id", "text")) if paths else docs.limit(0)
        return _judged(rows, groups, met, texts, self.digest)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    columns = docs.columns
    docs = with_row(docs)
    dropped = materialise(deduplicate(docs).where(~F.col("kept")).select("__f", "__r"), "dropped")
    return bounded_join(docs, dropped, ["__f", "__r"], "left_anti", 24).select(columns)
