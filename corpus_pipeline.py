"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  When a stage starts,
the working tables of the one before it are no longer needed and are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import exact, jaccard, mixing, packing, toxicity
from tributary.llm.common import Tables, bounded_join, delete, materialise, new_folder, settle, with_row
from tributary.llm.queries import tokenizer


_before: list[Tables] = []


def stage(f: Callable) -> Callable:
    """Run a stage with working tables of its own, those of the stage before it deleted."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _before:
            _before.pop().delete()
        settle(spark)
        with Tables(spark) as tables:
            _before.append(tables)
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; all of them where there are no labels of both classes to learn from."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights:
        return docs
    columns = docs.columns
    docs = with_row(docs)
    scored = toxicity.score(docs, model, ("__f", "__r"))
    rejected = materialise(scored.where("score >= 0.5").select("__f", "__r"), "rejected")
    return bounded_join(docs, rejected, ["__f", "__r"], "left_anti", 24).select(columns)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact.keep_one(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words, similarity 0.8 or more."""
    return jaccard.keep_one(docs, size=5, num=80, den=100)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, in the order of the mix."""
    return mixing.mixed(docs, repetition=2.0)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their ids and sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Scores of a trained model and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents.  What a stage returned is deleted when the next has read it."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    _before.clear()
    for name, function in STAGES:
        out = function(spark, docs, sf_dir)
        last = (name, function) == STAGES[-1]
        if not last:
            with Tables(spark):
                read, path_ = path, new_folder(spark, "stage")
            out.write.parquet(path_)
            docs, path = spark.read.parquet(path_), path_
        else:
            # The pieces are tables by now; they no longer need the documents.
            read = path
        if read is not None:
            delete(spark, read)
    # The result is yet to be read, so its tables stay.
    _before.clear()
    return out
