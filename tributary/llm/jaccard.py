"""Exact Jaccard join of word shingle sets, size-aware, and its components.

Documents with the same set form one class and the join works on classes.  A
least size splits them in light and heavy sets:

* Two light sets link exactly if they share a subset of the least overlap that
  their sizes ask for, so light sets enumerate those subsets.  A subset's key has
  128 bits.
* Heavy sets scan inverted lists.  A set is listed under its prefix, the first
  few of its elements in one order for all sets, one of which every partner
  shares.  The order is by the number of sets that hold an element, the rarest
  first, so that what very many documents hold makes no long lists.

For that order, the elements of all sets are dealt to ranges of their hashes, as
blobs of one chunk of documents and one range each, and counted range by range.
What more than one set holds goes back to its chunk, where prefixes are formed.
The number of ranges follows the number of elements, so a range fits in memory.
An element that very many documents of one chunk hold is sent as its number of
documents alone, so a hot element adds little to its range.

The boundary is the one of least cost: subsets enumerated below it, list entries
scanned above it, both counted from the data.

A list's sets are not paired with each other outright.  First each is compared
with the most like of a few pivots of its lists, again as long as this leaves much
fewer pairs, and what links becomes one component.  A list whose sets are all in one
component is left out from then on.  What is left are pairs across components: sets
outside a list's largest component against the others.  A pair is formed only
where the shared element can be the first that both hold: both then have as many
elements from there on as the overlap needs.  That, sizes and bitmaps of the sets
(a bound on the overlap that never errs downwards) rule pairs out before their full
sets are compared.  No link between components is lost.

Edge cases: a null or empty text, or one without words, has an empty set and
links with nothing.  With fewer words than a shingle's, the whole sequence is
the one element.  Repeated rows fall in one class; a null doc_id takes part but
never names a component unless all its members' are null.  An empty table gives
an empty result.

Elements are 64-bit fingerprints of the shingles.  Lists go by their leading bits,
32 and those of the range; what is listed together by chance is told apart later.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import words
from tributary.llm.common import bounded_join, drop, lists, materialise, settle, texts, tidy, with_row
from tributary.llm.graph import components

#: Largest set that may count as light, and most subsets that one may enumerate.
MOST_LIGHT, MOST_SUBSETS = 40, 100_000
#: Elements of a range and of a chunk, about; documents of a chunk.
RANGE, CHUNK, CHUNK_DOCS = 1 << 19, 1 << 20, 60_000
#: Documents of a chunk from which an element's are sent as a number.
OFTEN = 32
#: Pivots are taken while lists would make more pairs than so many times their entries, and a round leaves at most three in four of them.
PAIRS_PER_ENTRY = 2
#: Pivots of a list in a round.
PIVOTS = 8
BITS = [f"b{i}" for i in range(4)]
SHORT, CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(buffer: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct elements of every text, end to end, and each text's owner index."""
    buffer = words.lower(buffer)
    starts, ends, counts = words.find(buffer, offsets)
    word = words.hashes(buffer, starts, ends)
    owner = words.owners(counts)
    if len(word) >= size:
        inside = np.flatnonzero(owner[: len(word) - size + 1] == owner[size - 1 :])
        found, who = words.rolling(word, size)[inside], owner[inside]
    else:
        found, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        whole = [words.rolling(word[first[k] : first[k + 1]], int(counts[k]))[0] for k in short]
        found = np.concatenate([found, words.mix(np.array(whole, dtype=np.uint64) ^ SHORT)])
        who = np.concatenate([who, short])
    # Signed, as SQL compares them later.
    found = found.view(np.int64)
    order = np.argsort(found)
    order = order[np.argsort(who[order].astype(np.uint16) if len(counts) <= 1 << 16 else who[order], kind="stable")]
    found, who = found[order], who[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (who[1:] != who[:-1])
    return found[new], who[new]


def prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements of a set of n of which any partner shares at least one."""
    return np.where(n > 0, n - -(-num * n // den) + 1, 0)


def wide_maps(found: np.ndarray, who: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of at least n / 2 bits, a power of two from 256, and their sizes in longs.

    The first half XOR the second is the map of half the size.
    """
    bits = 2 ** np.ceil(np.log2(np.maximum(n, 512) / 2)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    odd = np.bincount(base[who] + (found & (bits[who] - 1)), minlength=base[-1]) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), bits // 64


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, offsets in texts(batch):
                found, who = shingles(buffer, offsets, size)
                n = np.bincount(who, minlength=len(rows))
                first = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for salt in (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(found.view(np.uint64) ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                bits = np.bincount(who * 256 + (found & 255), minlength=256 * len(rows)) & 1
                maps = np.packbits(bits.astype(np.uint8).reshape(-1, 256), axis=1).view(np.int64)
                wide, sizes = wide_maps(found, who, n)
                small = n[who] <= MOST_LIGHT
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("__f"), rows.column("__r"), pa.array(n.astype(np.int32)), pa.array(sums[0]), pa.array(sums[1])]
                    + [pa.array(maps[:, i].copy()) for i in range(4)]
                    + [lists(found[small], np.where(n <= MOST_LIGHT, n, 0), pa.int64()), lists(wide, sizes, pa.int64())],
                    ["doc_id", "__f", "__r", "n", "s1", "s2", *BITS, "small", "wide"],
                )

    return run


# Kinds of rows on the way to the order: elements with their documents, elements with their
# numbers of documents, documents of the latter, and the documents of a chunk with their sizes.
OF_DOCS, COUNTED, DOCS_OF_COUNTED, DOCS = range(4)
DEALT = "range long, chunk long, kind int, tok binary, who binary"
RANKED = DEALT + ", level binary"


def range_bits(total: int) -> int:
    """Leading bits of an element that tell its range."""
    return max(4, (max(total, 1) // RANGE).bit_length())


def _dealt(size: int, bits: int):
    """Rows for the ranges, and under negative ranges what only passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        found_, who_, cids, sizes, docs, held = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, docs, held
            chunk = (part << 32) + seq
            tok = np.concatenate(found_).view(np.uint64) >> np.uint64(32 - bits)
            who = np.concatenate(who_).astype(np.uint16)
            order = np.argsort(tok)
            tok, who = tok[order], who[order]
            begin = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])) if len(tok) else np.zeros(0, np.int64)
            times = np.diff(np.append(begin, len(tok)))
            often = np.repeat(times >= OFTEN, times)
            rows = [(-1 - chunk, DOCS, np.concatenate(cids).astype("<i8"), np.concatenate(sizes).astype("<i4"))]
            if often.any():
                rows.append((-1 - chunk, DOCS_OF_COUNTED, tok[often].astype("<u8"), who[often].astype("<u2")))
            hot = begin[times >= OFTEN]
            for kind, keys, values in ((OF_DOCS, tok[~often], who[~often].astype("<u2")), (COUNTED, tok[hot], times[times >= OFTEN].astype("<u4"))):
                at = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
                keys = keys.astype("<u4")
                rows += [(k, kind, keys[at[k] : at[k + 1]], values[at[k] : at[k + 1]]) for k in np.flatnonzero(np.diff(at)).tolist()]
            for kept in (found_, who_, cids, sizes):
                kept.clear()
            seq, docs, held = seq + 1, 0, 0
            made = list(zip(*rows))
            columns = [pa.array(made[0], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array(made[1], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([x.tobytes() for x in made[i]], pa.binary()) for i in (2, 3)]], ["range", "chunk", "kind", "tok", "who"])

        for batch in batches:
            for rows, buffer, offsets in texts(batch):
                found, who = shingles(buffer, offsets, size)
                if docs and (docs + len(rows) > CHUNK_DOCS or held + len(found) > CHUNK):
                    yield flush()
                found_.append(found)
                who_.append(who + docs)
                cids.append(np.asarray(rows.column("cid")))
                sizes.append(np.bincount(who, minlength=len(rows)))
                docs, held = docs + len(rows), held + len(found)
        if docs:
            yield flush()
        tidy()

    return run


def _numbers(cells, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in cells]


def _ranked(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range, the elements that more than one set holds, with twice the logarithm of how many."""
    rows = rows.assign(level=b"")
    if rows["range"].iloc[0] < 0:
        return rows
    tok = _numbers(rows["tok"], "<u4")
    who = [np.frombuffer(x, "<u2" if kind == OF_DOCS else "<u4") for x, kind in zip(rows["who"], rows["kind"])]
    weights = np.concatenate([np.ones(len(w)) if kind == OF_DOCS else w for w, kind in zip(who, rows["kind"])])
    _, which = np.unique(np.concatenate(tok), return_inverse=True)
    n = np.bincount(which, weights)[which]
    levels = np.minimum(2 * np.log2(n), 255).astype(np.uint8)
    shared = np.split(n > 1, np.cumsum([len(t) for t in tok])[:-1])
    levels = np.split(levels, np.cumsum([len(t) for t in tok])[:-1])
    out = rows.assign(
        tok=[t[s].tobytes() for t, s in zip(tok, shared)],
        who=[w[s].tobytes() for w, s in zip(who, shared)],
        level=[x[s].tobytes() for x, s in zip(levels, shared)],
    )
    return out[out["tok"].str.len() > 0]


def _prefixes(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of one chunk, the elements in prefixes that other sets hold too, and their places there."""
        of = {kind: part for kind, part in rows.groupby("kind")}
        cids, n = np.frombuffer(of[DOCS]["tok"].iloc[0], "<i8"), np.frombuffer(of[DOCS]["who"].iloc[0], "<i4")

        def numbers(kind: int, who: str) -> tuple:
            part = of.get(kind)
            if part is None:
                return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
            keys = [np.frombuffer(t, "<u4").astype(np.int64) + (r << 32) for t, r in zip(part["tok"], part["range"])]
            return np.concatenate(keys), np.concatenate(_numbers(part["who"], who)).astype(np.int64), np.concatenate(_numbers(part["level"], "u1"))

        tok, who, level = numbers(OF_DOCS, "<u2")
        hot, _, hot_level = numbers(COUNTED, "<u4")
        if len(hot):
            order = np.argsort(hot)
            also = of[DOCS_OF_COUNTED].iloc[0]
            more = np.frombuffer(also["tok"], "<u8").astype(np.int64)
            tok = np.concatenate([tok, more])
            who = np.concatenate([who, np.frombuffer(also["who"], "<u2").astype(np.int64)])
            level = np.concatenate([level, hot_level[order][np.searchsorted(hot[order], more)]])
        order = np.lexsort((tok, level, who))
        tok, who = tok[order], who[order]
        shared = np.bincount(who, minlength=len(n))
        # Elements that no other set holds come before all these.
        pos = (n - np.cumsum(shared))[who] + np.arange(len(who))
        listed = pos < prefix(n, num, den)[who]
        tok, who, pos = tok[listed], who[listed], pos[listed]
        return pd.DataFrame({"cid": cids[who], "n": n[who], "pos": pos.astype(np.int32), "tok": tok})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, offsets in texts(batch):
                found, who = shingles(buffer, offsets, size)
                n = np.bincount(who, minlength=len(rows))
                yield pa.RecordBatch.from_arrays([rows.column("cid"), lists(found, n, pa.int64())], ["cid", "elements"])

    return run


def overlap(n: int, m: int, num: int, den: int) -> int:
    """Least common elements of linked sets of n and m."""
    return -(-num * (n + m) // (num + den))


def subset_plans(n: int, most: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, elements left out) of the subsets a light set of n enumerates."""
    out = []
    for m in range(1, most + 1):
        lo, hi = min(n, m), max(n, m)
        c = overlap(lo, hi, num, den)
        if c <= lo and not (n == m and c == n):
            out.append((lo, hi, n - c))
    return out


def _subsets(most: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list] = {}
        for batch in batches:
            keys, checks, los, his, big, ids = [], [], [], [], [], []
            for cid, n, small in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "small"))):
                # A subset's key is two sums of its elements, mixed in two ways.
                values = np.array(small, dtype=np.int64).view(np.uint64)
                values = np.stack([words.mix(values ^ SHORT), words.mix(values ^ CHECK)])
                total = values.sum(axis=1, dtype=np.uint64)
                for lo, hi, out in plans.setdefault(n, subset_plans(n, most, num, den)):
                    picks = np.fromiter(chain.from_iterable(combinations(range(n), out)), np.int64, comb(n, out) * out).reshape(comb(n, out), out)
                    made = total[:, None] - values[:, picks].sum(axis=2, dtype=np.uint64)
                    keys.append(made[0].view(np.int64))
                    checks.append(made[1].view(np.int64))
                    for to, x in ((los, lo), (his, hi), (big, n == hi), (ids, cid)):
                        to.append(np.full(made.shape[1], x))
            if keys:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
                columns = [pa.array(np.concatenate(c), k) for c, k in zip((keys, checks, los, his, big, ids), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "check", "lo", "hi", "larger", "cid"])

    return run


def boundary(sizes: dict[int, tuple[int, int]], num: int, den: int) -> int:
    """The largest light size of least cost.  sizes: by size, sets and list entries they scan."""
    enumerated = {n: sets * sum(comb(n, out) for _, _, out in subset_plans(n, n, num, den)) for n, (sets, _) in sizes.items()}
    most = next((n - 1 for n in range(1, MOST_LIGHT + 1) if max([0, *(comb(n, out) for *_, out in subset_plans(n, n, num, den))]) > MOST_SUBSETS), MOST_LIGHT)
    costs = {s: sum(enumerated[n] if n <= s else sizes[n][1] for n in sizes) for s in range(most + 1)}
    return min(costs, key=lambda s: (costs[s], s))


def _allowed(a: str, b: str, num: int, den: int) -> Column:
    """What sizes and bitmaps leave possible; sides by their prefixes."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in BITS), F.lit(0))
    sizes = (n * den >= m * num) & (m * den >= n * num)
    return sizes & ((n + m - apart) * (num + den) >= (n + m) * (2 * num))


def _reachable(a: str, b: str, num: int, den: int) -> Column:
    """Whether the overlap can suffice if the shared element is the first that both sets hold."""
    n, m, i, j = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    return F.least(n - i, m - j) * (num + den) >= (n + m) * num


def _renamed(df: DataFrame, mark: str, but: tuple = ("tok", "band")) -> DataFrame:
    return df.select([F.col(c) if c in but else F.col(c).alias(mark + c) for c in df.columns])


class Join:
    """Links between classes, found step by step; see the module's text."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.docs = with_row(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__f", "__r")
        schema = "doc_id long, __f long, __r long, n int, s1 long, s2 long, " + ", ".join(f"{b} long" for b in BITS) + ", small array<long>, wide array<long>"
        self.sketches = materialise(self.docs.mapInArrow(_sketches(size), schema), "sketches")
        same = self.sketches.where("n > 0").groupBy("n", "s1", "s2")
        classes = same.agg(F.min("doc_id").alias("first"), F.min(F.struct("__f", "__r")).alias("at"))
        self.classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        # What is kept of a class's set is that of one of its rows.
        rows = self.sketches.select("__f", "__r", "n", *BITS, "small", "wide")
        self.of = materialise(self.classes.select("cid", "at.__f", "at.__r"), "of")
        self.kept = bounded_join(rows, self.of, ["__f", "__r"], "inner", 32)
        self.maps = materialise(self.kept.select("cid", "n", *BITS, "wide"), "maps")
        self.links = self.seen = None

    def entries(self) -> DataFrame:
        """cid, n, pos, tok, df: prefix entries of elements that more than one set lists."""
        total = self.maps.agg(F.sum("n")).first()[0]
        near = bounded_join(self.docs.select("text", "__f", "__r"), self.of, ["__f", "__r"], "inner", 32)
        dealt = near.select("cid", "text").mapInArrow(_dealt(self.size, range_bits(total or 0)), DEALT)
        ranked = dealt.groupBy("range").applyInPandas(_ranked, RANKED)
        listed = ranked.groupBy("chunk").applyInPandas(_prefixes(self.num, self.den), "cid long, n int, pos int, tok long")
        listed = materialise(listed, "listed")
        settle(self.docs.sparkSession)
        shared = listed.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        # Written, so that the join deals both sides itself and can split a hot key.
        found = materialise(listed.join(materialise(shared, "shared"), "tok"), "entries")
        drop(listed)
        return found

    def split(self, entries: DataFrame) -> int:
        """The boundary; only sizes up to MOST_LIGHT are looked at, so a few rows reach the driver."""
        sets = self.classes.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("sets"))
        scanned = entries.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.sum("df").alias("scanned"))
        rows = sets.join(scanned, "n", "left").collect()
        own = {r["n"]: r["sets"] * int(prefix(np.array(r["n"]), self.num, self.den)) for r in rows}
        return boundary({r["n"]: (r["sets"], (r["scanned"] or 0) + own[r["n"]]) for r in rows}, self.num, self.den)

    def light(self, most: int) -> DataFrame:
        """Links between light sets: all that enumerate the same subset, tied to the least."""
        subsets = self.kept.where(F.col("n") <= most).select("cid", "n", "small")
        keys = subsets.mapInArrow(_subsets(most, self.num, self.den), "key long, check long, lo int, hi int, larger boolean, cid long")
        keys = materialise(keys, "subsets")
        on = ["key", "check", "lo", "hi"]
        met = keys.groupBy(on).agg(F.min("cid").alias("v"), F.max("cid").alias("last"), F.max("larger").alias("x"), F.min("larger").alias("y"))
        met = materialise(met.where("v <> last and (lo = hi or x <> y)").select(*on, "v"), "met")
        return keys.join(met, on).where("cid <> v").select(F.col("cid").alias("u"), "v").distinct()

    def heavy(self, entries: DataFrame, most: int) -> None:
        num, den = self.num, self.den
        partners = entries.where(F.col("n") * den >= num * (most + 1)).drop("df")
        # Sets in the same or the next band of sizes can link.
        band = F.floor(F.log("n") / F.log(F.lit(den / num))).cast("int")
        self.listed = materialise(partners.withColumn("size_band", band), "partners")
        drop(entries)
        enough, before, k = PAIRS_PER_ENTRY * self.listed.count(), None, 0
        rows = self.rooted(self.listed)
        left = self.pairs_left(rows)
        while left > enough and (before is None or 4 * left <= 3 * before) and self.verify(self.pivots(rows, k, most)):
            settle(self.docs.sparkSession)
            rows, k = self.rooted(rows), k + 1
            before, left = left, self.pairs_left(rows)
        self.verify(self.across(rows, most))

    def rooted(self, rows: DataFrame) -> DataFrame:
        """Entries of the lists that still hold several components, with the component found so far.

        The rows given, those of the round before, are deleted.  Components only grow,
        so a list that holds one has nothing left to find in any later round.
        """
        if self.links is None:
            return rows.withColumn("root", F.col("cid"))
        roots = materialise(components(self.links), "roots")
        named = rows.drop("root").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        named = materialise(named, "named")
        drop(rows)
        several = named.groupBy("tok").agg(F.min("root").alias("least"), F.max("root").alias("last")).where("least <> last").select("tok")
        # Written, so that the join deals both sides itself and can split a hot key.
        open_ = materialise(named.join(materialise(several, "several"), "tok"), "rooted")
        drop(named)
        return open_

    def pairs_left(self, rows: DataFrame) -> int:
        """Pairs that across() would look at, but for what sizes, places and bitmaps rule out."""
        sized = rows.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("members"))
        lists_ = sized.groupBy("tok").agg(F.sum("members").alias("all"), F.max("members").alias("main"))
        return lists_.agg(F.sum((F.col("all") - F.col("main")) * F.col("all"))).first()[0] or 0

    def pivots(self, rows: DataFrame, k: int, most: int) -> DataFrame:
        """Each set with the pivot most like it among its lists' pivots, from other components."""
        num, den = self.num, self.den
        on = ["tok", "size_band"]
        picks = [F.min(F.struct(F.xxhash64("cid", F.lit(k * PIVOTS + i)).alias("h"), "cid", "n", "pos", "root")).alias(f"p{i}") for i in range(PIVOTS)]
        picked = rows.groupBy(on).agg(F.min("root").alias("least"), F.max("root").alias("last"), *picks).where("least <> last")
        told = [F.struct(*[F.col(f"p{i}.{c}").alias(c) for c in ("cid", "n", "pos", "root")]) for i in range(PIVOTS)]
        flat = picked.select(*on, F.explode(F.array_distinct(F.array(*told))).alias("p"))
        flat = materialise(flat.select(*on, *[F.col(f"p.{c}").alias(f"p{c}") for c in ("cid", "n", "pos", "root")]), "picked")
        own = _renamed(rows, "o", tuple(on))
        fits = (F.col("oroot") != F.col("proot")) & (F.greatest("on", "pn") > most) & _reachable("o", "p", num, den)
        met = own.join(flat, on).where(fits).select("ocid", "pcid").distinct()
        side = lambda x: self.maps.select(*[F.col(c).alias(x + c) for c in ("cid", "n", *BITS)])
        both = met.join(side("o"), "ocid").join(side("p"), "pcid").where(_allowed("o", "p", num, den))
        apart = sum((F.bit_count(F.col(f"o{x}").bitwiseXOR(F.col(f"p{x}"))) for x in BITS), F.lit(0))
        nearest = both.groupBy("ocid").agg(F.min(F.struct(apart.alias("d"), F.col("pcid").alias("c"))).alias("best"))
        return nearest.select(F.least("ocid", "best.c").alias("a"), F.greatest("ocid", "best.c").alias("b")).distinct()

    def across(self, rows: DataFrame, most: int) -> DataFrame:
        """All pairs that share an element, lie in different components and can't be ruled out."""
        sized = rows.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("members"))
        large = sized.groupBy("tok").agg(F.max(F.struct("members", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        large = materialise(large.select("tok", F.col("top.root").alias("main")), "large")
        open_ = rows.join(large, "tok").join(self.maps.select("cid", *BITS), "cid")
        open_ = materialise(open_, "open")
        minor = open_.where("root <> main").withColumn("band", F.explode(F.array(F.col("size_band") - 1, "size_band", F.col("size_band") + 1)))
        x, y = _renamed(minor, "x"), _renamed(open_.withColumn("band", F.col("size_band")), "y")
        once = (F.col("yroot") == F.col("ymain")) | (F.col("xcid") < F.col("ycid"))
        fits = _allowed("x", "y", self.num, self.den) & _reachable("x", "y", self.num, self.den)
        apart = (F.col("xroot") != F.col("yroot")) & once & (F.greatest("xn", "yn") > most)
        pairs = x.join(y, (x["tok"] == y["tok"]) & (x["band"] == y["band"]) & apart & fits)
        return pairs.select(F.least("xcid", "ycid").alias("a"), F.greatest("xcid", "ycid").alias("b")).distinct()

    def verify(self, pairs: DataFrame) -> bool:
        """Compare new pairs, first by their wide bitmaps, then by their full sets; whether any linked."""
        num, den = self.num, self.den
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        side = lambda x: self.maps.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        size = F.least(F.size("wide_a"), F.size("wide_b"))
        xor = lambda x, y: x.bitwiseXOR(y)
        fold = lambda m: F.when(F.size(m) > size, F.zip_with(F.slice(m, 1, size), F.slice(m, size + 1, size), xor)).otherwise(F.col(m))
        apart = F.aggregate(F.zip_with(fold("wide_a"), fold("wide_b"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, v: s + v)
        fits = (F.col("n_a") + F.col("n_b") - apart) * (num + den) >= (F.col("n_a") + F.col("n_b")) * (2 * num)
        near = materialise(both.where(fits).select("a", "b", "n_a", "n_b"), "near")
        if near.isEmpty():
            return False
        need = near.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(self.classes.select("cid", "at"), "cid")
        need = materialise(need.select("cid", "at.__f", "at.__r"), "need")
        found = bounded_join(self.docs.select("text", "__f", "__r"), need, ["__f", "__r"], "inner", 32)
        sets = materialise(found.select("cid", "text").mapInArrow(_sets(self.size), "cid long, elements array<long>"), "sets")
        a = sets.select(F.col("cid").alias("a"), F.col("elements").alias("of_a"))
        b = sets.select(F.col("cid").alias("b"), F.col("elements").alias("of_b"))
        shared = F.size(F.array_intersect("of_a", "of_b"))
        linked = near.join(a, "a").join(b, "b").where(shared * (num + den) >= (F.col("n_a") + F.col("n_b")) * num)
        linked = materialise(linked.select(F.col("a").alias("u"), F.col("b").alias("v")), "linked")
        if linked.isEmpty():
            return False
        self.links = linked if self.links is None else self.links.unionByName(linked)
        return True

    def result(self) -> DataFrame:
        spark = self.docs.sparkSession
        entries = self.entries()
        settle(spark)
        most = self.split(entries)
        light = materialise(self.light(most), "light")
        if not light.isEmpty():
            self.links = light
        # Of the sketches, only what names each row's class is needed from here on.
        plain = materialise(self.sketches.select("doc_id", "__f", "__r", "n", "s1", "s2"), "plain")
        drop(self.sketches)
        self.heavy(entries, most)
        settle(spark)
        named = self.classes.select("cid", "first", "n", "s1", "s2")
        if self.links is None:
            named = named.withColumn("root", F.col("cid")).withColumn("component_id", F.col("first"))
        else:
            roots = materialise(components(self.links), "roots").withColumnRenamed("node", "cid")
            named = named.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
            least = named.groupBy("root").agg(F.min("first").alias("component_id"))
            named = named.join(least, "root")
        named = named.select("n", "s1", "s2", "root", "component_id")
        out = plain.join(named, ["n", "s1", "s2"], "left")
        own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "__f", "__r", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), "root")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, __f, __r, n_shingles, component_id of every row; sets link from num / den similarity."""
    return Join(docs, size, num, den).result().drop("root")


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of every component, that of the least doc_id (nulls last), with all its columns.

    Components are told apart by their least class, as unlike rows may share a doc_id or have none.
    Rows with an empty set stay.
    """
    columns = docs.columns
    docs = with_row(docs)
    rows = materialise(Join(docs, size, num, den).result(), "components")
    rows = rows.where("n_shingles > 0")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__f", "__r")).alias("k"))
    lost = rows.join(best.select("k.__f", "k.__r"), ["__f", "__r"], "left_anti").select("__f", "__r")
    return bounded_join(docs, materialise(lost, "lost"), ["__f", "__r"], "left_anti", 24).select(columns)
