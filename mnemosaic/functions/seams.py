"""Where a model may be put in: an embedder, a reranker and an extractor, as functions over batches, with stand-ins that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scoring

Embed = Callable[[list[str]], list[list[float] | None]]


def embedded(text: Column, embed: Embed | None = None, fallback: Embed | None = None, dims: int = 64) -> Column:
    """Vectors of texts: of the embedder, else of the fallback, else of the hash. From its first failure on, a task asks the fallback first."""
    if embed is None:
        return scoring.hash_embedding(text, dims)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        providers = [p for p in (embed, fallback) if p]
        for batch in batches:
            texts, found = batch.fillna("").tolist(), None
            for n, provider in enumerate(list(providers)):
                try:
                    found = provider(texts)
                except Exception:  # a provider that is down is passed over, like one that gives nothing
                    found = None
                if found and any(found):
                    providers = providers[n:] + providers[:n]
                    break
            yield pd.Series(found if found else [None] * len(texts))

    return F.coalesce(run(text), scoring.hash_embedding(text, dims))


def reranked(query: Column, content: Column, distance: Column, score: Callable[[list[str], list[str]], list[float]] | None = None) -> Column:
    """A model's score of each query and text; without a model, the words in common, the distance and the length."""
    if score is None:
        return scoring.fallback_rerank(distance, query, content)

    @F.pandas_udf("double")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(score(q.fillna("").tolist(), c.fillna("").tolist()), dtype="float64")

    return run(query, content)


def judged(text: Column, ask: Callable[[list[str]], list[str]] | None = None, schema: str = "array<struct<type:string,content:string>>") -> Column:
    """What a language model finds in texts, as JSON between other words; nothing without one, and nothing where its answer is no list."""
    if ask is None:
        return F.array().cast(schema)

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(ask(t.fillna("").tolist()))

    return json_list(run(text), schema)


def json_list(answer: Column, schema: str) -> Column:
    """The list that a text holds from its first bracket to its last; an empty one where it can't be read."""
    return F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), schema), F.array().cast(schema))
