"""Runs of like vectors, as of the sentences of a text: a new run begins where the coherence would drop too far.

Coherence is the mean cosine of all pairs of a run. With unit vectors, the pairs that a new vector makes add up to its
product with the sum of those before, so one running sum serves and no pair is ever formed: a step costs one
product, however long the run is. Sequences are sorted streams; a task holds the sums of one run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Run:
    """The vectors from one boundary to the next: number, sum of cosines of all pairs, sums of unit and raw vectors."""

    def __init__(self, first):
        self.first = self.last = first
        self.n, self.pairs = 0, 0.0
        self.units: dict[int, np.ndarray] = {}
        self.total: np.ndarray | None = None
        self.counted = 0

    @property
    def coherence(self) -> float:
        return self.pairs / (self.n * (self.n - 1) / 2) if self.n > 1 else 1.0

    def with_next(self, unit: np.ndarray | None) -> float:
        """The coherence with one vector more."""
        more = 0.0 if unit is None or len(unit) not in self.units else float(self.units[len(unit)] @ unit)
        return (self.pairs + more) / ((self.n + 1) * self.n / 2) if self.n else 1.0

    def add(self, place, vector: np.ndarray | None, unit: np.ndarray | None) -> None:
        if unit is not None:
            known = self.units.get(len(unit))
            self.pairs += 0.0 if known is None else float(known @ unit)
            self.units[len(unit)] = unit.copy() if known is None else known + unit
        if vector is not None and (self.total is None or len(self.total) == len(vector)):
            self.total = vector.copy() if self.total is None else self.total + vector
            self.counted += 1
        self.last, self.n = place, self.n + 1

    def centroid(self) -> list[float] | None:
        return None if self.total is None else (self.total / self.counted).tolist()


def _unit(vector: np.ndarray | None) -> np.ndarray | None:
    """Null, zero and non-finite vectors, and those with missing components, are like nothing."""
    if vector is None or not np.isfinite(vector).all():
        return None
    norm = np.sqrt(vector @ vector)
    return vector / norm if norm > 0 else None


def semantic_runs(rows: DataFrame, by: str, order: str, vector: str, threshold: float = 0.7) -> DataFrame:
    """One row per run: by, run (from 0 in its sequence), first, last (of order), n, coherence, centroid.

    A vector begins a run when it would lower the coherence by more than 1 - threshold. The coherence of one vector
    is 1, cosines with a zero or null vector or one of another length are 0. The centroid is the mean of the vectors
    as long as the first. Nulls of `by` are a sequence; order should tell the rows of a sequence apart.
    """
    kinds = dict(rows.dtypes)
    schema = f"`{by}` {kinds[by]}, run long, first {kinds[order]}, last {kinds[order]}, n long, coherence double, centroid array<double>"
    sorted_rows = rows.select(F.col(by).alias("by"), F.col(order).alias("place"), F.col(vector).cast("array<double>").alias("v"))
    sorted_rows = sorted_rows.repartition("by").sortWithinPartitions("by", "place")
    names = [by, "run", "first", "last", "n", "coherence", "centroid"]
    by_type, place_type = (sorted_rows.schema[c].dataType for c in ("by", "place"))

    def cut(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(by_type), pa.int64(), to_arrow_type(place_type), to_arrow_type(place_type), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        now, run, number, done = None, None, 0, []

        def close():
            done.append((now, number, run.first, run.last, run.n, run.coherence, run.centroid()))

        def taken():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            for key, place, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = None if values is None else np.array([np.nan if x is None else x for x in values], float)
                unit = _unit(v)
                if run is None or key != now:
                    if run is not None:
                        close()
                    now, run, number = key, Run(place), 0
                elif run.coherence - run.with_next(unit) > 1.0 - threshold:
                    close()
                    run, number = Run(place), number + 1
                run.add(place, v if unit is not None or (v is not None and np.isfinite(v).all()) else None, unit)
            if done:
                yield taken()
        if run is not None:
            close()
            yield taken()

    return sorted_rows.mapInArrow(cut, schema)
