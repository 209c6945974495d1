"""Shared plumbing: working tables, row identity and size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that is sent whole to every executor.
BROADCAST_LIMIT = 32 << 20
#: White space of the word rules: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that the Python operators hold as arrays at a time.
SLICE_BYTES = 1 << 19

#: How rows reach Python functions: few of them and few bytes at a time, as texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

_working: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)
_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without it a temporary one, where driver and executors are one process."""
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_folder is None:
        place = tempfile.mkdtemp(prefix="tributary-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        _own_folder = "file://" + place
    return _own_folder


class Tables:
    """The working tables made inside its block; delete() them when what came from them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        self._token = _scope.set(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _scope.reset(self._token)

    def delete(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())


def _made() -> list[str]:
    return _working if _scope.get() is None else _scope.get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, one of the working tables of the block around it."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    path = f"{shared_folder(spark)}/tributary/{name}-{uuid.uuid4().hex}"
    _made().append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs at most the tasks that read it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(df: DataFrame) -> None:
    """Delete a working table that nothing will read any more."""
    made = _made()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        for path in [path for path in made if folder.endswith(path.rpartition("/tributary/")[2])]:
            delete(df.sparkSession, path)
            made.remove(path)


def settle(spark: SparkSession) -> None:
    """Have the driver forget finished steps, so that their shuffle files are deleted."""
    gc.collect()
    spark._jvm.System.gc()


def with_row(docs: DataFrame) -> DataFrame:
    """Add __f and __r, two longs that identify a row even where doc_id repeats.

    They are the hash of the file's path and the row's index in it.  A table
    that does not come straight from files is written first.
    """
    plan = docs._jdf.queryExecution().analyzed().toString().splitlines()
    straight = all(line.strip(" :+-").startswith(("Relation", "Project", "Filter")) for line in plan)
    if not straight or sum("Relation" in line for line in plan) != 1 or not docs.inputFiles():
        docs = materialise(docs, "rows")
    return docs.withColumns({"__f": F.xxhash64("_metadata.file_path"), "__r": F.col("_metadata.row_index")})


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a materialised table consists of."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def bounded_join(left: DataFrame, right: DataFrame, on: list[str], how: str, width: int = 16) -> DataFrame:
    """Join with a materialised table.

    It is broadcast only when its rows, at ``width`` bytes and twice its stored
    size, stay within BROADCAST_LIMIT; otherwise both sides are shuffled.
    """
    if stored_bytes(right) * 2 <= BROADCAST_LIMIT and right.count() * width <= BROADCAST_LIMIT:
        return left.join(F.broadcast(right), on, how)
    return left.hint("merge").join(right, on, how)


def tidy() -> None:
    """Give memory that is free back, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def texts(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, rows: int = 1000):
    """Yield (slice of the batch, byte array, offsets), texts as UTF-8, null as empty."""
    for begin in range(0, len(batch), rows):
        part = batch.slice(begin, rows)
        whole = pc.fill_null(part.column(column), "").cast(pa.large_string())
        ends = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = whole.buffers()[2]
        at = 0
        while at < len(whole):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            first, last = int(ends[at]), int(ends[upto])
            buffer = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
            yield part.slice(at, upto - at), buffer, ends[at : upto + 1] - first
            at = upto
    tidy()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array from values laid end to end and each row's count."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
