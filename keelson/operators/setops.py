"""Unions by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are NULL there."""
    if not frames:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def labelled(df: DataFrame, **labels: str) -> DataFrame:
    """``df`` with lower-cased literal columns, replacing those it has."""
    return df.withColumns({k: F.lit(v.lower()) for k, v in labels.items()})
