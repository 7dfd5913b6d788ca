"""Reuse of built expressions.

A Column is an immutable tree over column names, so one tree serves every DataFrame of the
session.  Building the larger ones costs thousands of driver round trips; this keeps them.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext


def memoized(build):
    """Cache by (hashable) arguments, per Spark context."""
    kept: dict = {}

    @wraps(build)
    def call(*args):
        key = (SparkContext._active_spark_context, args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]
    return call
