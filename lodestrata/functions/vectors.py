"""Vector expressions over ``array<float>``."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_embedding(c: Column) -> Column:
    return c.isNotNull() & (F.size(c) > 0)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision over the shorter of two vectors."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a token list by feature hashing: the embedder where no model is at hand.

    Like a model it is an Arrow-batched function; an empty list is the zero vector.
    """

    @F.pandas_udf("array<float>")
    def embed(lists: pd.Series) -> pd.Series:
        out = np.zeros((len(lists), dim))
        for row, items in enumerate(lists):
            for t in items if items is not None else ():
                h = zlib.crc32(t.encode("utf-8", "replace"))
                out[row, h % dim] += 1.0 if h & 0x80000000 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list((out / np.where(size > 0, size, 1.0)).astype(np.float32)))

    return embed(tokens)
