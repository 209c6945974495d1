"""Toxic spans by a linear-chain conditional random field, and document scores.

Words are tagged 0 or 1.  A word's features are itself, its first three to six
letters and its last three.  Labels are of documents, so token labels are
derived from them: in a toxic document, words are toxic whose features are much
commoner among toxic documents than among others.  The field is trained on these
by its exact gradient, from forward and backward sums, on a bounded sample.  A
document's marginals (the largest, their sum, their share) go through a logistic
function to its score, and words with a marginal of at least one half are its
offending spans.

The sample has at most SAMPLE documents of each class, those of least hash among
the labelled ones of at most SAMPLE_CHARS characters, and in that order as many of
them as have SAMPLE_TOTAL characters together; everything else covers all rows.

Edge cases: a null or empty text scores like any text without words.  Without
labels of both classes, every score is the share of toxic labels (one half
without any).  Null labels are not used; of several labels of one doc_id, toxic
wins.  Repeated rows get the same score.  Only doc_id and text are looked at.
"""

from __future__ import annotations

import gc
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import tidy

#: Most labelled documents of each class that the field is trained on.
SAMPLE = 1000
#: Most characters of one such document, and of those of one class together.
SAMPLE_CHARS, SAMPLE_TOTAL = 100_000, 8_000_000
ROUNDS = 30
#: Log odds from which a feature marks a toxic word, and documents it must be in.
MARKED, LEAST_DOCS = 3.0, 3
REMEMBERED = 300_000
CELLS = 300_000
word_of = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    """Lower-case words.  They are cut in the text itself, so that their places are those of its characters."""
    lower = text.lower()
    return word_of(lower) if len(lower) == len(text) else [w.lower() for w in word_of(text)]


def features(word: str) -> list[str]:
    out = ["=" + word]
    out += [f"^{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k]
    if len(word) > 3:
        out.append("$" + word[-3:])
    return out


def chain(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1 against 0, by step and row.

    emission: steps x rows, potentials of state 1 (1 beyond a row's end); moves:
    2 x 2 potentials from state to state.
    """
    steps, rows = emission.shape
    (t00, t01), (t10, t11) = moves
    ahead, behind = np.empty((steps, rows)), np.ones((steps, rows))
    odds = np.ones(rows)
    for t in range(steps):
        odds = emission[t] * (t01 + odds * t11) / (t00 + odds * t10) if t else emission[0]
        ahead[t] = odds
    odds = np.ones(rows)
    for t in range(steps - 1, 0, -1):
        next_ = emission[t] * odds
        # Beyond a row's end nothing flows back.
        odds = np.where(t < lengths, (t10 + t11 * next_) / (t00 + t01 * next_), 1.0)
        behind[t - 1] = odds
    return ahead, behind


def marginals(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Each row's probability of state 1 at every step; scores are log potentials."""
    out: list = [None] * len(scores)
    order = np.argsort([len(s) for s in scores], kind="stable")
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and len(scores[order[upto]]) * (upto + 1 - at) <= CELLS:
            upto += 1
        rows = order[at:upto]
        lengths = np.array([len(scores[k]) for k in rows])
        padded = np.ones((lengths.max() if len(lengths) else 0, len(rows)))
        for c, k in enumerate(rows):
            padded[: lengths[c], c] = np.exp(scores[k])
        if padded.size:
            ahead, behind = chain(padded, lengths, moves)
            odds = ahead * behind
            chance = odds / (1 + odds)
        for c, k in enumerate(rows):
            out[k] = chance[: lengths[c], c] if lengths[c] else np.zeros(0)
        at = upto
    return out


def summary(p: np.ndarray) -> tuple[float, float, float]:
    """What a document's score is made of."""
    return (float(p.max()), float(np.log1p(p.sum())), float(np.sqrt(p.mean()))) if len(p) else (0.0, 0.0, 0.0)


@dataclass
class Field:
    """Weights of the features, transition potentials and the document's logistic function."""

    weights: dict = field(default_factory=dict)
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(4))
    seen: dict = field(default_factory=dict, repr=False)

    def emit(self, word: str) -> float:
        value = self.seen.get(word)
        if value is None:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            value = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
            self.seen[word] = value = min(30.0, max(-30.0, value))
        return value

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        emit, seen = self.emit, self.seen
        scores = []
        for text in texts:
            found = words_of(text)
            have = list(map(seen.get, found))
            if None in have:
                have = [emit(w) if e is None else e for w, e in zip(found, have)]
            scores.append(np.array(have, dtype=np.float64))
        return marginals(scores, self.moves)

    def score(self, tags: list[np.ndarray]) -> np.ndarray:
        x = np.array([summary(p) for p in tags]).reshape(-1, 3)
        return 1 / (1 + np.exp(-(x @ self.logistic[:3] + self.logistic[3])))


def _adam(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def train(docs: list[str], toxic: np.ndarray) -> Field:
    """Fit the field and the score to labelled documents."""
    base = (float(toxic.sum()) + 1) / (len(toxic) + 2)
    if not len(toxic) or toxic.min() == toxic.max():
        return Field(logistic=np.array([0, 0, 0, np.log(base / (1 - base))]))
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(d)], dtype=np.int64) for d in docs]
    of_word = [features(w) for w in vocabulary]
    df = [Counter(), Counter()]
    for codes, y in zip(coded, toxic):
        df[int(y)].update({f for c in np.unique(codes) for f in of_word[c]})
    totals = [int((toxic == 0).sum()), int((toxic == 1).sum())]
    kept = sorted(f for f in df[0].keys() | df[1].keys() if df[0][f] + df[1][f] >= LEAST_DOCS)
    number = {f: k for k, f in enumerate(kept)}
    odds = np.array([np.log((df[1][f] + 0.5) / (totals[1] + 1)) - np.log((df[0][f] + 0.5) / (totals[0] + 1)) for f in kept])
    held = np.array([df[1][f] for f in kept])
    strong = (odds >= MARKED) & (held >= LEAST_DOCS)
    pairs = [(w, number[f]) for w, fs in enumerate(of_word) for f in fs if f in number]
    words, feats = (np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    marked = np.zeros(len(vocabulary), dtype=bool)
    marked[words[strong[feats]]] = True
    truth = [marked[c].astype(float) if y else np.zeros(len(c)) for c, y in zip(coded, toxic)]

    order = np.argsort([len(c) for c in coded], kind="stable")
    groups, at = [], 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and len(coded[order[upto]]) * (upto + 1 - at) <= CELLS:
            upto += 1
        rows = [k for k in order[at:upto] if len(coded[k])]
        if rows:
            lengths = np.array([len(coded[k]) for k in rows])
            codes, labels = np.zeros((lengths.max(), len(rows)), np.int64), np.zeros((lengths.max(), len(rows)))
            for c, k in enumerate(rows):
                codes[: lengths[c], c], labels[: lengths[c], c] = coded[k], truth[k]
            groups.append((codes, labels, lengths, np.arange(lengths.max())[:, None] < lengths))
        at = upto
    tokens = sum(int(g[2].sum()) for g in groups) or 1
    n = len(kept)

    def gradient(x: np.ndarray) -> np.ndarray:
        word_score = np.clip(x[n] - 4.0 + np.bincount(words, x[:n][feats], minlength=len(vocabulary)), -30, 30)
        moves = np.exp(np.array([[0.0, x[n + 1]], [x[n + 2], x[n + 3]]]))
        miss, flow = np.zeros(len(vocabulary)), np.zeros((2, 2))
        for codes, labels, lengths, live in groups:
            emission = np.where(live, np.exp(word_score[codes]), 1.0)
            ahead, behind = chain(emission, lengths, moves)
            chance = ahead * behind
            chance = np.where(live, chance / (1 + chance), 0)
            miss += np.bincount(codes[live], (labels - chance)[live], minlength=len(vocabulary))
            # Expected and true moves between neighbours.
            to = emission[1:] * behind[1:]
            joint = [[np.full_like(to, moves[0, 0]), moves[0, 1] * to], [ahead[:-1] * moves[1, 0], ahead[:-1] * moves[1, 1] * to]]
            whole = sum(joint[i][j] for i in (0, 1) for j in (0, 1))
            for i in (0, 1):
                for j in (0, 1):
                    real = (labels[:-1] == i) & (labels[1:] == j)
                    flow[i, j] += ((real - joint[i][j] / whole) * live[1:]).sum()
        scale = 1000.0 / tokens
        g = np.concatenate([np.bincount(feats, miss[words], minlength=n), [miss.sum(), flow[0, 1], flow[1, 0], flow[1, 1]]])
        return scale * g - 0.01 * np.concatenate([x[:n], np.zeros(4)])

    x = _adam(gradient, n + 4, ROUNDS, 0.3)
    out = Field(
        weights={f: float(w) for f, w in zip(kept, x[:n]) if abs(w) > 0.01},
        bias=float(x[n]) - 4.0,
        moves=np.exp(np.array([[0.0, x[n + 1]], [x[n + 2], x[n + 3]]])),
    )
    table = np.array([summary(p) for p in out.tag(docs)])
    spread = table.std(axis=0) + 1e-6
    mean = table.mean(axis=0)
    z = np.column_stack([(table - mean) / spread, np.ones(len(table))])

    def slope(w: np.ndarray) -> np.ndarray:
        return z.T @ (toxic - 1 / (1 + np.exp(-z @ w))) / len(z) - 0.001 * w

    w = _adam(slope, 4, 400, 0.1)
    out.logistic = np.concatenate([w[:3] / spread, [w[3] - (w[:3] * mean / spread).sum()]])
    out.seen.clear()
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(r["doc_id"], r["text"], r["toxic"]) for batch in batches for at in range(0, len(batch), 64) for r in batch.slice(at, 64).to_pylist()]
    rows.sort()
    model = train([t for _, t, _ in rows], np.array([y for *_, y in rows], dtype=float))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
    del rows, model
    gc.collect()
    tidy()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on a bounded sample of the labelled documents that aren't held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"))
    short = short.where(F.col("chars") <= SAMPLE_CHARS).groupBy("doc_id").agg(F.max("chars").alias("chars"))
    order = F.xxhash64("doc_id")
    chosen = [marks.join(short, "doc_id").where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    # At most 2 * sample rows: the window sees no more.
    ahead = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = chosen[0].unionByName(chosen[1]).withColumn("sum", F.sum("chars").over(ahead)).where(F.col("sum") <= SAMPLE_TOTAL).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
    # One text of each chosen doc_id, so that the sample stays bounded.
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("x"))
    # One task trains, on at most 2 * sample rows; only the model reaches the driver.
    made = texts.select("doc_id", "x.text", "x.toxic").repartition(1).mapInArrow(_trained, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], np.zeros(0))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = shared.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512)
                texts = ["" if t is None else t for t in rows.column("text").to_pylist()]
                tags = model.tag(texts)
                spans = []
                for text, p in zip(texts, tags):
                    bad = np.flatnonzero(p >= 0.5)
                    if not len(bad):
                        spans.append([])
                        continue
                    where = [m.span() for m in re.finditer(r"\w+", text)]
                    spans.append([{"from": where[k][0], "to": where[k][1], "chance": float(p[k])} for k in bad])
                kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("chance", pa.float64())]))
                arrays = [rows.column(c) for c in rows.schema.names if c != "text"]
                names = [c for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.score(tags)), pa.array(spans, kind)], [*names, "score", "spans"])
        model.seen.clear()
        tidy()

    return run


def score(docs: DataFrame, model: Field, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, score and spans (from, to in characters, chance) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{k} long" for k in keys) + ", score double, spans array<struct<from:long,to:long,chance:double>>"
    rows = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(shared), schema)
