"""String similarity by matching blocks (Ratcliff and Obershelp), as pandas UDFs.

Spark has no built-in equal to ``difflib``'s ratio.  Equal strings, the common
case among copies, are answered without it; each distinct pair of a batch is
computed once.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(value) -> str | None:
    """None, '' and 0 are missing."""
    return str(value) if value is not None and value == value and value else None


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def _ratios(a: pd.Series, b: pd.Series, fold: bool) -> list[float | None]:
    known: dict[tuple[str, str], float] = {}
    out: list[float | None] = []
    for x, y in zip(a, b, strict=True):
        x, y = _text(x), _text(y)
        if x is None or y is None:
            out.append(None)
            continue
        key = (x.lower(), y.lower()) if fold else (x, y)
        if key not in known:
            known[key] = ratio(*key)
        out.append(known[key])
    return out


def _folded(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_ratios(a, b, True), dtype="float64")


def _exact(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_ratios(a, b, False), dtype="float64")


def folded_ratio(a: Column, b: Column) -> Column:
    """0 to 1, ignoring case; NULL if a side is missing."""
    return F.pandas_udf(_folded, T.DoubleType())(a, b)


def exact_ratio(a: Column, b: Column) -> Column:
    """0 to 1; NULL if a side is missing."""
    return F.pandas_udf(_exact, T.DoubleType())(a, b)


def _as_text(c: Column, zero_is_missing: bool = True) -> Column:
    text = c.cast("string")
    return F.when(text.isin("", "0", "0.0"), F.lit(None)).otherwise(text) if zero_is_missing else text


def multi_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """0 to 100: the mean ratio of the pairs, ignoring case; a pair with a missing side counts 0.

    Equal pairs never reach Python."""
    if not pairs:
        return F.lit(0.0)
    parts = []
    for a, b in pairs:
        a, b = _as_text(a), _as_text(b)
        same = F.lower(a) == F.lower(b)
        x = F.when(same, F.lit(None)).otherwise(a)
        y = F.when(same, F.lit(None)).otherwise(b)
        parts.append(F.coalesce(F.when(same, F.lit(1.0)).otherwise(folded_ratio(x, y)), F.lit(0.0)))
    return sum(parts[1:], parts[0]) * F.lit(100.0 / len(parts))


def weighted_similarity(name: tuple[Column, Column], email: tuple[Column, Column], phone: tuple[Column, Column], ident: tuple[Column, Column]) -> Column:
    """0 to 100: 30 points each for name, e-mail and phone (case counts), 10 if the ids are equal."""
    ratios = [F.coalesce(exact_ratio(_as_text(a), _as_text(b)), F.lit(0.0)) for a, b in (name, email, phone)]
    a, b = (_as_text(x) for x in ident)
    same = F.coalesce((a == b).cast("double"), F.lit(0.0))
    return sum((r * 30.0 for r in ratios), F.lit(0.0)) + same * 10.0
