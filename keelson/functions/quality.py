"""Row quality predicates; rejects are kept, not lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted forms of e-mail addresses and telephone numbers.
EMAIL = r"^[^@]+@[^@]+\.[^@]+$"
PHONE = r"^[0-9+\- ]{7,20}$"


def present(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def valid_phone(c: Column) -> Column:
    return F.coalesce(c.rlike(PHONE), F.lit(False))


def split(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't); NULL doesn't pass."""
    good = F.coalesce(good, F.lit(False))
    return df.where(good), df.where(~good)
