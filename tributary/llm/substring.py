"""Removal of word windows that occur more than once.

Every window of ``width`` consecutive words has a Rabin-Karp hash, and repeated
windows are those whose hash is counted more than once.  Not every hash has to be
formed for that: a window can only repeat if its minimiser does, the least hash among the shorter word
runs inside it.  So three counts are made in Spark, each over what the one
before leaves open:

1. Minimisers, one for about fourteen windows.  Windows whose minimiser occurs
   once are single.
2. Stretches: neighbouring windows with the same minimiser, by the hash of all
   their words.  All windows of a stretch that occurs again are repeated, and
   copies need no more than this.
3. Where stretches of one minimiser differ, the windows of each different
   stretch, weighted by how often the stretch occurs.

The repeated windows of a document merge into maximal intervals of words to
remove.  A stretch's key has 128 bits; a window's is its hash and half of its
minimiser's, 96 bits.

Edge cases: a null or empty text has no words and its kept text is empty.  Texts
shorter than a window are never touched.  Repeated rows count as often as they
occur, with or without a doc_id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import words
from tributary.llm.common import bounded_join, lists, materialise, texts, with_row

HALF = np.uint64(0xFFFFFFFF)
#: Most windows of a stretch, so that flags for them fit in a long.
STRETCH = 60


def inner_width(width: int) -> int:
    """Words of the runs that minimisers are taken from."""
    return max(1, width // 4)


def _windows(buffer: np.ndarray, offsets: np.ndarray, width: int):
    """Each text's words and windows: word spans, counts, window positions, their owners and minimisers."""
    starts, ends, counts = words.find(buffer, offsets)
    word = words.hashes(buffer, starts, ends)
    inner = inner_width(width)
    grams = words.rolling(word, inner)
    if len(word) < width:
        empty = np.zeros(0, dtype=np.int64)
        return starts, ends, counts, word, grams, empty, empty, np.zeros(0, np.uint64)
    least = words.sliding(grams, width - inner + 1, np.minimum)
    owner = words.owners(counts)
    inside = np.flatnonzero(owner[: len(least)] == owner[width - 1 :])
    return starts, ends, counts, word, grams, inside, owner[inside], least[inside]


def _minimisers(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, offsets in texts(batch):
                *_, grams, inside, owner, least = _windows(buffer, offsets, width)
                if not len(inside):
                    continue
                # A run of words is a minimiser where a window that holds it has its hash as the least.
                span = width - inner_width(width) + 1
                top = np.zeros(len(grams) + span - 1, dtype=np.uint64)
                top[inside + span - 1] = least
                most = words.sliding(top, span, np.maximum)[: len(grams)]
                at = np.flatnonzero((most == grams) & (most > 0))
                _, _, counts = words.find(buffer, offsets)
                # A text reports each once, with how often it holds it.
                which, value = words.owners(counts)[at], grams[at]
                order = np.lexsort((value, which))
                which, value = which[order], value[order]
                new = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (value[1:] != value[:-1])))
                times = np.diff(np.append(new, len(which)))
                who = pa.array(which[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[new].view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int8)), rows.column("__f").take(who), rows.column("__r").take(who)],
                    ["least", "times", "__f", "__r"],
                )

    return run


def _stretches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, offsets in texts(batch):
                _, _, counts, word, _, inside, owner, least = _windows(buffer, offsets, width)
                again = rows.column("again")
                sizes = np.diff(np.frombuffer(again.buffers()[1], np.int32)[again.offset : again.offset + len(again) + 1])
                listed = np.asarray(again.flatten()).view(np.uint64)
                listed = listed[np.lexsort((listed, words.owners(sizes)))]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                hit = np.zeros(len(inside), dtype=bool)
                at = np.searchsorted(owner, np.arange(len(rows) + 1))
                for k in range(len(rows)):
                    a, b = at[k], at[k + 1]
                    mine = listed[bounds[k] : bounds[k + 1]]
                    if b > a and len(mine):
                        found = np.minimum(np.searchsorted(mine, least[a:b]), len(mine) - 1)
                        hit[a:b] = mine[found] == least[a:b]
                place, who, value = inside[hit], owner[hit], least[hit]
                if not len(place):
                    continue
                new = np.ones(len(place), dtype=bool)
                new[1:] = (place[1:] != place[:-1] + 1) | (who[1:] != who[:-1]) | (value[1:] != value[:-1])
                begin = np.flatnonzero(new)
                since = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
                begin = np.flatnonzero(since % STRETCH == 0)
                long = np.diff(np.append(begin, len(place)))
                start = place[begin]
                first = np.concatenate([[0], np.cumsum(counts)])[who[begin]]
                whole = words.spans(word, start, start + long + width - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("number").take(pa.array(who[begin])),
                        pa.array((start - first).astype(np.int32)),
                        pa.array(long.astype(np.int32)),
                        pa.array(value[begin].view(np.int64)),
                        pa.array(whole.view(np.int64)),
                    ],
                    ["number", "start", "windows", "least", "whole"],
                )

    return run


def _open_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, offsets in texts(batch):
                starts, ends, counts = words.find(buffer, offsets)
                word = words.hashes(buffer, starts, ends)
                first = np.concatenate([[0], np.cumsum(counts)])
                asked = rows.column("asked")
                owner = words.owners(np.diff(np.frombuffer(asked.buffers()[1], np.int32)[asked.offset : asked.offset + len(asked) + 1]))
                flat = asked.flatten()
                group, start, long, least, weight = (np.asarray(flat.field(c)) for c in ("group", "start", "windows", "least", "n"))
                inner = words.owners(long)
                step = np.arange(len(inner)) - np.repeat(np.cumsum(long) - long, long)
                whole = words.rolling(word, width)[(first[owner] + start)[inner] + step]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(whole.view(np.int64)),
                        pa.array((least.view(np.uint64) & HALF).astype(np.uint32).view(np.int32)[inner]),
                        pa.array(group[inner]),
                        pa.array(step.astype(np.int32)),
                        pa.array(weight[inner]),
                    ],
                    ["hash", "half", "group", "step", "n"],
                )

    return run


def _removed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, offsets in texts(batch):
                starts, ends, counts = words.find(buffer, offsets)
                data = buffer.tobytes()
                first = np.concatenate([[0], np.cumsum(counts)])
                kept, removed, froms, tos, many = [], [], [], [], []
                for k, repeated in enumerate(rows.column("starts")):
                    n, base = int(counts[k]), int(first[k])
                    begin, end = starts[base : base + n], ends[base : base + n]
                    if not repeated.is_valid or not len(repeated.values):
                        kept.append(b" ".join(data[offsets[k] : offsets[k + 1]].split()).decode())
                        removed.append(0)
                        many.append(0)
                        continue
                    delta = np.zeros(n + 1, dtype=np.int64)
                    at, flags = (np.asarray(repeated.values.field(c)) for c in ("start", "flags"))
                    set_, bit = np.nonzero((flags[:, None] >> np.arange(STRETCH)) & 1)
                    where = at[set_] + bit
                    np.add.at(delta, where, 1)
                    np.add.at(delta, where + width, -1)
                    covered = np.cumsum(delta)[:n] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    froms.append(edge[0::2])
                    tos.append(edge[1::2])
                    many.append(len(edge) // 2)
                    removed.append(int(covered.sum()))
                    kept.append(b" ".join(data[a:b] for a, b in zip(begin[~covered].tolist(), end[~covered].tolist())).decode())
                none = [np.zeros(0, np.int64)]
                spans = pa.StructArray.from_arrays([pa.array(np.concatenate(froms or none)), pa.array(np.concatenate(tos or none))], ["from", "to"])
                at = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum(many, out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(counts.astype(np.int64)),
                        pa.array(removed, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at), spans),
                        pa.array(kept, pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
                )

    return run


RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<from:long,to:long>>, kept_text string"


def remove_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, removed (word intervals), kept_text."""
    docs = with_row(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__f", "__r")
    row = ["__f", "__r"]
    found = docs.select("text", *row).mapInArrow(_minimisers(width), "least long, times tinyint, __f long, __r long")
    found = materialise(found, "minimisers")
    again = found.groupBy("least").agg(F.sum("times").alias("n")).where("n > 1").select("least")
    # Written, so that the join deals both sides itself and can split a hot key.
    again = materialise(again, "again")
    hits = found.join(again, "least").groupBy(row).agg(F.collect_list("least").alias("again"))
    hits = materialise(hits.withColumn("number", F.monotonically_increasing_id()), "hits")
    near = bounded_join(docs.select("text", *row), materialise(hits.select(row), "near"), row, "left_semi")
    near = materialise(near.join(hits, row).select("number", "text", "again"), "texts")

    stretches = materialise(near.mapInArrow(_stretches(width), "number long, start int, windows int, least long, whole long"), "stretches")
    key = ["least", "whole", "windows"]
    groups = stretches.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("number", "start")).alias("at"))
    groups = materialise(groups.withColumn("group", F.monotonically_increasing_id()), "groups")
    mixed = groups.groupBy("least").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most = 1").select("least")
    open_ = bounded_join(groups, materialise(mixed, "mixed"), ["least"], "left_semi")
    asked = open_.groupBy("at.number").agg(F.collect_list(F.struct("group", "at.start", "windows", "least", "n")).alias("asked"))
    windows = near.select("number", "text").join(asked, "number")
    windows = windows.mapInArrow(_open_windows(width), "hash long, half int, group long, step int, n long")
    windows = materialise(windows, "windows")
    repeated = windows.groupBy("hash", "half").agg(F.sum("n").alias("n")).where("n > 1").select("hash", "half")
    # Only single stretches ask; the windows of others are repeated as they are.
    single = windows.where("n = 1").join(materialise(repeated, "repeated"), ["hash", "half"])
    marks = single.groupBy("group").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("flags"))
    every = F.expr("shiftleft(1L, windows) - 1L")
    flagged = groups.join(marks, "group", "left").withColumn("flags", F.when(F.col("n") > 1, every).otherwise(F.col("flags")))
    flagged = flagged.where("flags is not null").select(*key, "flags")
    starts = stretches.join(flagged, key).groupBy("number").agg(F.collect_list(F.struct("start", "flags")).alias("starts"))
    starts = materialise(starts.join(hits.select("number", *row), "number").drop("number"), "starts")

    ids = materialise(starts.select(row), "marked")
    marked = bounded_join(docs, ids, row, "left_semi").join(starts, row).select("doc_id", "text", "starts")
    plain = bounded_join(docs, ids, row, "left_anti").select("doc_id", "text", F.lit(None).cast(starts.schema["starts"].dataType).alias("starts"))
    return marked.unionByName(plain).mapInArrow(_removed(width), RESULT)
