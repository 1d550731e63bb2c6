"""Vectors as column expressions, and embedding providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tarnsearch.functions.text import tokens, tokens_of

HASH_DIMENSION = 64


class EmbeddingType(Enum):
    """Known providers' dimensions. Two of them need a client that the caller supplies."""

    REMOTE_SMALL = 1536
    REMOTE_LARGE = 3072
    LOCAL = 384
    HASHED = HASH_DIMENSION


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside a lambda an expression would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return bound(v, lambda v: bound(norm(v), lambda n: scaled(v, n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def checked(v: Column, dimension: int) -> Column:
    """The vector, or an error if it hasn't the dimension."""
    wrong = F.concat(F.lit(f"expected dimension {dimension}, got "), F.size(v).cast("string"))
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(wrong))


def hashed(text: Column) -> Column:
    """A vector without a model: counts of tokens by hash bucket, scaled to length 1. No rows move."""
    buckets = F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(HASH_DIMENSION)))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(HASH_DIMENSION - 1)), lambda i: F.size(F.filter(own, lambda b: b == i)).cast("double"))
    return unit(bound(buckets, counts))


def hashed_of(text: str) -> list[float]:
    """hashed() of one string on the driver."""
    import hashlib

    v = np.zeros(HASH_DIMENSION)
    for t in tokens_of(text):
        v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % HASH_DIMENSION] += 1
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


@dataclass(frozen=True)
class Provider:
    """How texts become vectors: a column expression for tables, a function for one query. An empty list is a failure."""

    name: str
    dimension: int
    column: Callable[[Column], Column]
    one: Callable[[str], list[float]]


HASHED = Provider("hashed-64", HASH_DIMENSION, hashed, hashed_of)


def model_provider(name: str, dimension: int, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 256) -> Provider:
    """A provider over a model that each worker loads once and that takes batches of texts. One retry, then null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in texts:
            out: list = []
            for at in range(0, len(series), batch):
                part = series.iloc[at : at + batch].fillna("").tolist()
                for attempt in (0, 1):
                    try:
                        out += [np.asarray(v, np.float32) for v in model(part)]
                        break
                    except Exception:
                        if attempt:
                            out += [None] * len(part)
            yield pd.Series(out)

    return Provider(name, dimension, column, lambda text: list(map(float, load()([text])[0])))


def mean_pooled(token_vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of token vectors (text, token, dimension) where the mask (text, token) is 1; of none, zeros."""
    m = mask[..., None].astype(np.float64)
    return (token_vectors * m).sum(1) / np.maximum(m.sum(1), 1e-9)
