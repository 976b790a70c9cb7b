"""What the operators on embeddings share: which vectors count, and vectors as NumPy matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    whole = F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def usual_size(df: DataFrame, vector: str) -> int:
    """The most frequent number of components over 0 (of equally frequent ones the largest); 0 without vectors."""
    sizes = df.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0")
    found = sizes.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()
    return found.d or 0


def scaled_floor(vector: Column, factor: int, most: int) -> Column:
    """floor(factor * c) of every component as a long; beyond ``most`` either way it counts as ``most``."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), c * factor))).cast("long"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column, all of whose rows have ``d`` numbers, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums_by_key(partials: DataFrame, tasks: int = 16) -> DataFrame:
    """(key, total) from (key int, part array<double>): every task gives a few parts, and equal keys are added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("key").to_pylist(), batch.column("part"), strict=True):
                row = part.values.to_numpy(zero_copy_only=False)
                total[k] = total[k] + row if k in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], names=["key", "total"])

    return partials.repartition(tasks, "key").mapInArrow(add, "key int, total array<double>")
