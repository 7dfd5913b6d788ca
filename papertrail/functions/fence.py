"""Keeping derived columns computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Same rows, with ``columns`` handed over by a one-element generator.

    A filter on a derived column is normally pushed below its projection with the whole expression
    substituted, so an expensive one is computed again for the filter (and a chain of them multiplies).
    Filters on fenced columns run on the computed values; other columns keep their pushdown.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.array(F.struct(*columns))
    return df.select(*kept, F.explode_outer(packed).alias("_fenced")) \
        .select(*[F.col(f"_fenced.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
