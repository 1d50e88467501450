"""Attaching one-row aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Add the columns of aggregates that have exactly one row, as scalar subqueries (no join)."""
    for i, part in enumerate(one_row):
        value = part.select(F.struct(*[F.col(c) for c in part.columns])).scalar()
        df = df.withColumn(f"_row{i}", value)
    added = [f"_row{i}.*" for i in range(len(one_row))]
    kept = [c for c in df.columns if c not in {f"_row{i}" for i in range(len(one_row))}]
    return df.select(*kept, *added)
