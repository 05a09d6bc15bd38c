"""Upsert of two DataFrames, for results that are not tables of the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], preserve: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """``target`` updated by ``source``: matched rows take the source's columns but ``preserve``,
    unmatched rows of both sides stay or come.  NULL keys never match.  ``label``: a
    column that says updated, inserted or kept."""
    t = target.select(F.lit(True).alias("__t"), *[F.col(c).alias(f"__t_{c}") for c in target.columns])
    s = source.select(F.lit(True).alias("__s"), *[F.col(c).alias(f"__s_{c}") for c in source.columns])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"__t_{k}") == F.col(f"__s_{k}"))
    joined = t.join(s, on, "full_outer")
    out = []
    for c in [*target.columns, *(c for c in source.columns if c not in target.columns)]:
        if c not in source.columns:
            out.append(F.col(f"__t_{c}").alias(c))
        elif c not in target.columns:
            out.append(F.col(f"__s_{c}").alias(c))
        elif c in preserve:
            out.append(F.when(F.col("__t"), F.col(f"__t_{c}")).otherwise(F.col(f"__s_{c}")).alias(c))
        else:
            out.append(F.when(F.col("__s"), F.col(f"__s_{c}")).otherwise(F.col(f"__t_{c}")).alias(c))
    if label:
        out.append(F.when(F.col("__t") & F.col("__s"), "updated").when(F.col("__s"), "inserted").otherwise("kept").alias(label))
    return joined.select(*out)
