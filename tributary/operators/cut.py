"""Cutting lineage in iterative operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list = []
_own_folder: str | None = None


def _folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without it a temporary one, where driver and executors are one process."""
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="tributary-")
        _written.append((spark, _own_folder))
    return _own_folder


@atexit.register
def _clear() -> None:
    """Delete what was written, as far as Spark's process is still there."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    What reads it knows its size, so that small tables are broadcast and only
    the columns in use are read.  Tables are deleted when the program ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/tributary-cut/{uuid.uuid4().hex}"
    _written.append((spark, path))
    df = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
