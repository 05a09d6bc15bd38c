"""Keyed latest-wins deduplication with a MAIN / CONFLICTED split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANK = "__rank"


def newest_first(column: str, *tie_breaks: str) -> list[Column]:
    """A total order: newest first (NULL last), then the tie-breaks ascending."""
    return [F.col(column).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie_breaks)]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not among {df.columns}")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``__rank``: 1 for the survivor of each key. NULL keys form one group."""
    require_columns(df, keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(RANK, F.row_number().over(window))


def main_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The survivors.  ``rank = 1`` lets Spark plan a WindowGroupLimit, which drops
    all but one row of a key before the shuffle, so that hot keys stay small."""
    return ranked(df, keys, order).where(F.col(RANK) == 1).drop(RANK)


def conflicted_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows but the survivors."""
    return ranked(df, keys, order).where(F.col(RANK) > 1).drop(RANK)


def split_labelled(df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str = "bronze_type") -> DataFrame:
    """Every row, labelled MAIN or CONFLICTED in one ranked pass."""
    kind = F.when(F.col(RANK) == 1, F.lit("MAIN")).otherwise(F.lit("CONFLICTED"))
    return ranked(df, keys, order).withColumn(label, kind).drop(RANK)
