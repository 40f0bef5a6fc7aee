"""A chain of embedding providers, tried in order for every text.

A provider is a name and a function without arguments that sets it up and returns its
``embed(texts) -> vectors``; a vector may be None, and the call may raise. Providers are set
up once per worker, when they are first needed. A text that one provider fails on goes to
the next one; a provider that cannot be set up fails on every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], Sequence]
RESULT = "embedding array<double>, provider string, failures array<string>"


def _one_by_one(embed: Embed, texts: list[str]) -> list:
    """Vectors of the texts; if the call for all of them fails, each is tried alone."""
    try:
        got = list(embed(texts))
        if len(got) == len(texts):
            return [(v, None) for v in got]
        why = f"{len(got)} vectors for {len(texts)} texts"
    except Exception as e:
        why = type(e).__name__
    if len(texts) == 1:
        return [(None, why)]
    return [_one_by_one(embed, [t])[0] for t in texts]


def provider_chain(providers: Sequence[tuple[str, Callable[[], Embed]]]) -> Callable[[Column], Column]:
    """A column function: text -> struct(embedding, provider that gave it, failures of those before it).

    A text that no provider embeds has a null embedding and provider; a null text is not
    given to any of them and has no failures."""

    @F.pandas_udf(RESULT)
    def chain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Embed | str] = {}
        for texts in batches:
            vectors = [None] * len(texts)
            by: list[str | None] = [None] * len(texts)
            failed: list[list[str]] = [[] for _ in range(len(texts))]
            left = [k for k, t in enumerate(texts) if t is not None and t == t]
            for name, set_up in providers:
                if not left:
                    break
                if name not in ready:
                    try:
                        ready[name] = set_up()
                    except Exception as e:
                        ready[name] = type(e).__name__
                embed = ready[name]
                got = [(None, embed)] * len(left) if isinstance(embed, str) else _one_by_one(embed, [texts.iloc[k] for k in left])
                rest = []
                for k, (v, why) in zip(left, got):
                    if v is None:
                        failed[k].append(f"{name}: {why or 'no vector'}")
                        rest.append(k)
                    else:
                        vectors[k], by[k] = [float(x) for x in v], name
                left = rest
            yield pd.DataFrame({"embedding": vectors, "provider": by, "failures": failed})

    return chain


def embed_files(files: DataFrame, providers, text_col: str = "content", key=("project", "path")) -> DataFrame:
    """(key, embedding, provider, failures) of every file."""
    got = files.select(*key, provider_chain(providers)(F.col(text_col)).alias("e"))
    return got.select(*key, "e.embedding", "e.provider", "e.failures")


def only_vectors(providers) -> Callable[[Column], Column]:
    """The chain as a plug-in for ``vectors.build_index``: the embedding, null where all providers failed."""
    chain = provider_chain(providers)
    return lambda text: chain(text)["embedding"]
