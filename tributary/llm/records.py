"""Length-delimited binary records of token ids with a separate offset index.

A shard is a run of frames.  A frame is the payload's length (8 bytes), the
masked CRC-32 of those 8 bytes (4), the payload, and the payload's masked
CRC-32 (4), all little-endian.  The mask turns a checksum by 15 bits and adds a
constant, so that data holding checksums stay safe.  A payload is one byte that
tells whether there is a document id, the id (8 bytes), one byte with the width
of a token id, and the token ids.

The shards follow each other in ascending order of doc_id, null first.  Each
attempt of a task writes a file of its own and only the files that the index
names count, so lost executors and repeated tasks do no harm.

Edge cases: a null or empty text has only its end id.  Rows with the same
doc_id lie side by side.  An empty table gives an index without rows.  Columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import bounded_join, materialise, texts, with_row
from tributary.llm.tokens import BatchEncoder, encoder

MASK_DELTA = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
LEAD = struct.Struct("<BqB")
INDEX = "shard string, part long, doc_id long, at long, bytes long, n_tokens long, before long"
WRITE_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; ValueError if a checksum or length is wrong."""
    length, check = HEAD.unpack_from(data)
    if masked(data[:8]) != check:
        raise ValueError("the checksum of a record's length is wrong")
    payload = data[HEAD.size : HEAD.size + length]
    if len(data) != HEAD.size + length + TAIL.size or masked(payload) != TAIL.unpack_from(data, HEAD.size + length)[0]:
        raise ValueError("the checksum of a record's content is wrong")
    return payload


def serialise(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return LEAD.pack(doc_id is not None, doc_id or 0, width) + ids


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = LEAD.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=LEAD.size)


def _ids(batch: pa.RecordBatch, tokens: BatchEncoder) -> Iterator[tuple]:
    for docs, buffer, offsets in texts(batch):
        ids, counts = tokens.encode(buffer, offsets)
        at = 0
        for doc_id, count in zip(docs.column("doc_id").to_pylist(), counts.tolist()):
            yield doc_id, ids[at : at + count]
            at += count


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"shard-{part:07d}-{uuid.uuid4().hex}.rec"
        tokens = encoder(path)
        end = np.array([end_id], dtype=tokens.kind).tobytes()
        at = before = 0
        with store.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                rows, pending, held = [], [], 0
                for doc_id, ids in _ids(batch, tokens):
                    ids = ids.tobytes() + end
                    data = frame(serialise(doc_id, ids, tokens.kind.itemsize))
                    count = len(ids) // tokens.kind.itemsize
                    rows.append((f"{folder}/{name}", part, doc_id, at, len(data), count, before))
                    at, before = at + len(data), before + count
                    pending.append(data)
                    held += len(data)
                    if held > WRITE_BYTES:
                        out.write(b"".join(pending))
                        pending, held = [], 0
                out.write(b"".join(pending))
                if rows:
                    kinds = [pa.string()] + [pa.int64()] * 6
                    names = ["shard", "part", "doc_id", "at", "bytes", "n_tokens", "before"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents to shards under ``folder``, a URI, and return their index.

    The index has shard, doc_id, at (the frame's first byte), bytes, n_tokens
    and start (ids of all documents before).
    """
    rows = with_row(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__f", "__r")
    # By the row as well, so that many rows of one doc_id, or of none, are spread.
    order = ["doc_id", "__f", "__r"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    index = materialise(ordered.mapInArrow(_write(folder, tokenizer, end_id), INDEX), "index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base")), "bases")
    joined = bounded_join(index, bases, ["part"], "inner")
    return joined.select("shard", "doc_id", "at", "bytes", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, source = None, None
    for batch in batches:
        names, ats, sizes = (batch.column(c).to_pylist() for c in ("shard", "at", "bytes"))
        extra = [batch.column(c).to_pylist() for c in ("start",)][0]
        rows, held = [], 0
        for shard, at, size, start in zip(names, ats, sizes, extra):
            if shard != opened:
                if source is not None:
                    source.close()
                store, place = pyarrow.fs.FileSystem.from_uri(shard)
                opened, source = shard, store.open_input_file(place)
            doc_id, ids = parse(unframe(source.read_at(size, at)))
            rows.append((doc_id, start, ids.astype("<u4").tobytes()))
            held += len(ids) * 4
            if held > WRITE_BYTES:
                yield _made(rows)
                rows, held = [], 0
        if rows:
            yield _made(rows)
    if source is not None:
        source.close()


def _made(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.binary()])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])


def read_records(index: DataFrame) -> DataFrame:
    """Read the frames that an index, in any order or part, points to.

    Gives doc_id, start and ids (little-endian unsigned 32-bit).  Every
    checksum is tested.
    """
    return index.select("shard", "at", "bytes", "start").mapInArrow(_read, "doc_id long, start long, ids binary")
