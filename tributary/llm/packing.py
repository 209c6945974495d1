"""Packing token sequences with a bounded number of open windows.

Each partition keeps at most ``open_windows`` windows open.  A document's whole
windows go out at once; its rest goes to the open window that it leaves the
least room in.  When none has room, the fullest is topped up with the head of
the rest and emitted.  At the end a partition joins what is left to whole
windows and one partial one, and groups of such partial windows are merged.

Edge cases: a null or empty text has only its end id.  A null doc_id is packed
like any other.  Repeated rows are packed each by themselves.  An empty table
gives an empty result.  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import bounded_join, materialise, texts
from tributary.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, window long, offset long, whole boolean"
#: Shorter gaps are left as padding: a document isn't cut for them.
LEAST_CUT = 8
#: Partial windows that one task merges.
MERGED_TOGETHER = 1024
FLUSH_BYTES = 4 << 20


class Packer:
    """Places pieces of (document, ids) and calls emit(piece, window, offset, whole)."""

    def __init__(self, size: int, open_windows: int, emit):
        self.size, self.most, self.emit = size, open_windows, emit
        self.open: list[list] = []  # of [room, [(doc, start, ids), ...]]
        self.made = 0

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= self.size:
            self._close([0, [(doc, at, ids[at : at + self.size])]])
            at += self.size
        if at == len(ids):
            return
        rest = len(ids) - at
        fitting = min((w for w in self.open if w[0] >= rest), key=lambda w: w[0], default=None)
        if fitting is None and len(self.open) >= self.most:
            fullest = min(self.open, key=lambda w: w[0])
            if fullest[0] >= LEAST_CUT:
                cut = fullest[0]
                fullest[1].append((doc, at, ids[at : at + cut]))
                fullest[0] = 0
                at += cut
                rest -= cut
            self.open = [w for w in self.open if w is not fullest]
            self._close(fullest)
        if fitting is None:
            fitting = [self.size, []]
            self.open.append(fitting)
        fitting[1].append((doc, at, ids[at:]))
        fitting[0] -= rest
        if not fitting[0]:
            self.open = [w for w in self.open if w is not fitting]
            self._close(fitting)

    def _close(self, window: list, whole: bool = True) -> None:
        offset = 0
        for doc, start, ids in window[1]:
            self.emit(doc, start, ids, self.made, offset, whole)
            offset += len(ids)
        self.made += 1

    def finish(self) -> None:
        """Join the open windows' pieces end to end, cutting where one is full."""
        last = [self.size, []]
        for _, pieces in sorted(self.open, key=lambda w: w[0]):
            for doc, start, ids in pieces:
                while len(ids):
                    part = ids[: last[0]]
                    last[1].append((doc, start, part))
                    last[0] -= len(part)
                    start, ids = start + len(part), ids[len(part) :]
                    if not last[0]:
                        self._close(last)
                        last = [self.size, []]
        self.open = []
        if last[1]:
            self._close(last, False)


def _packed(path: str, end_id: int, size: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens = encoder(path)
        end = np.array([end_id], dtype=tokens.kind)
        rows: list[tuple] = []
        held = 0

        def emit(doc, start, ids, window, offset, whole):
            nonlocal held
            rows.append((doc[0], start, len(ids), doc[1], ids.tobytes(), part, window, offset, whole))
            held += len(ids) * ids.itemsize

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3 + [pa.bool_()]
            names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "window", "offset", "whole"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            rows.clear()
            held = 0
            return out

        packer = Packer(size, open_windows, emit)
        for batch in batches:
            for docs, buffer, offsets in texts(batch):
                all_ids, counts = tokens.encode(buffer, offsets)
                at = 0
                for doc_id, count in zip(docs.column("doc_id").to_pylist(), counts.tolist()):
                    ids = np.concatenate([all_ids[at : at + count], end])
                    at += count
                    packer.add((doc_id, len(ids)), ids)
                    if held > FLUSH_BYTES:
                        yield flush()
        packer.finish()
        if rows:
            yield flush()

    return run


def _merge(size: int):
    def run(windows: pd.DataFrame) -> pd.DataFrame:
        """Best fit of whole partial windows, the longest first."""
        made: list[list] = []  # of [room, sequence, used]
        out = []
        for w in windows.sort_values(["filled", "part"], ascending=[False, True]).itertuples():
            fit = min((m for m in made if m[0] >= w.filled), key=lambda m: m[0], default=None)
            if fit is None:
                fit = [size, (int(w.part) << 32) + int(w.window), 0]
                made.append(fit)
            out.append((w.part, w.window, fit[1], fit[2]))
            fit[0] -= w.filled
            fit[2] += w.filled
        return pd.DataFrame(out, columns=["part", "window", "into", "moved"])

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths = batch.column("id_bytes").to_pylist()
        sums = [zlib.crc32(np.frombuffer(ids.as_buffer(), f"<u{w}").astype("<u4")) for ids, w in zip(batch.column("ids"), widths)]
        names = [n for n in batch.schema.names if n not in ("ids", "id_bytes")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sums, pa.int64())], [*names, "ids_crc32"])


def checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids as 32-bit numbers, ids_crc32, in place of the ids."""
    kept = [f"{c} long" for c in pieces.columns if c not in ("ids", "id_bytes")]
    return pieces.mapInArrow(_checked, ", ".join([*kept, "ids_crc32 long"]))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, open_windows: int = 64) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids, id_bytes, sequence_id, offset.

    ``ids`` holds the piece's ids, little-endian, ``id_bytes`` bytes each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(_packed(tokenizer, end_id, size, open_windows), PIECES), "pieces")
    partial = pieces.where(~F.col("whole")).groupBy("part", "window").agg(F.sum("length").alias("filled"))
    groups = partial.groupBy(F.floor(F.col("part") / MERGED_TOGETHER))
    moves = materialise(groups.applyInPandas(_merge(size), "part long, window long, into long, moved long"), "moves")
    joined = bounded_join(pieces, moves, ["part", "window"], "left", 32)
    own = F.shiftleft(F.col("part"), 32) + F.col("window")
    return joined.select(
        "doc_id",
        "start",
        "length",
        "doc_tokens",
        "ids",
        F.when(F.col("length") > 0, F.octet_length("ids") / F.col("length")).cast("int").alias("id_bytes"),
        F.coalesce("into", own).alias("sequence_id"),
        (F.col("offset") + F.coalesce("moved", F.lit(0))).alias("offset"),
    )
