"""Vector functions on array columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths or a zero norm."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def query_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


@F.pandas_udf(T.BinaryType())
def packed_half(vectors: pd.Series) -> pd.Series:
    """Vectors as bytes, two (half precision, little-endian, ties to even) a component: half the room of floats. Null
    components are NaN, beyond 65504 they are infinite; a null vector stays null, an empty one has no bytes."""
    with np.errstate(over="ignore"):
        return vectors.map(lambda v: np.asarray(v, dtype="float64").astype("float32").astype("<f2").tobytes(), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked_half(packed: pd.Series) -> pd.Series:
    """Vectors of floats from packed_half."""
    return packed.map(lambda b: np.frombuffer(b, dtype="<f2").astype("float32"), na_action="ignore")
