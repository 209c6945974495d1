"""Calls of outside models: retries, one provider after another, and what to do when none answers.

A provider is a function of a list of texts that gives as many results.  Nothing
here opens a connection; who has a model passes a function that asks it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list], list]
# Status codes worth another try.
TRANSIENT = (429, 500, 502, 503, 504)
RETRIES = 2


def transient(error: Exception) -> bool:
    """Whether a call may succeed later: by the error's status code, or as a lost connection."""
    code = getattr(error, "status_code", getattr(error, "code", None))
    return code in TRANSIENT or isinstance(error, (TimeoutError, ConnectionError))


def call(provider: Provider, texts: list, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> list | None:
    """The provider's results, after up to ``retries`` more tries 1, 2, 4 ... seconds apart; None if it fails."""
    for k in range(retries + 1):
        try:
            out = provider(texts)
            return out if len(out) == len(texts) else None
        except Exception as e:  # noqa: BLE001  providers raise what they like
            if k == retries or not transient(e):
                return None
            wait(2.0**k)
    return None


def cascade(providers: list[Provider], default: Callable | None = None, **options) -> Provider:
    """A provider that asks each in turn until one answers, then gives default(text) of every text, or None."""

    def ask(texts: list) -> list:
        for p in providers:
            out = call(p, texts, **options)
            if out is not None:
                return out
        return [default(t) if default else None for t in texts]

    return ask


def embed(rows: DataFrame, providers: list[Provider], size: int, text: str = "purpose", batch: int = 32) -> DataFrame:
    """rows with an embedding of a text column, zeros where no provider answers."""
    ask = cascade(providers, lambda _: [0.0] * size)
    kept = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield part.assign(embedding=[[float(x) for x in v] for v in ask(part[text].fillna("").tolist())])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", embedding array<double>"
    return rows.mapInPandas(run, schema).select(*kept, "embedding")


def name_domains(samples: DataFrame, provider: Provider | None = None) -> DataFrame:
    """(domain, name) from at most ten members of each (domain, place, path, purpose).

    ``provider`` gets one text for each domain, its members' lines; without it,
    or where it doesn't answer, the domain keeps its own name.
    """
    line = F.concat_ws(": ", "path", "purpose")
    few = samples.where("place <= 10").groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    few = few.select("domain", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    if provider is None:
        return few.select("domain", F.col("domain").alias("name"))
    ask = cascade([provider])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"domain": frame["domain"], "name": [n or d for n, d in zip(ask(frame["text"].tolist()), frame["domain"])]})

    return few.mapInPandas(run, "domain string, name string")
