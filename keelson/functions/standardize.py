"""Header and value standardisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.schema import Schema, data_type

#: Header synonyms of the source systems.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "email": ("cust_email", "sf_email", "erp_email", "sap_email", "email"),
    "phone": ("cust_phone", "phone_number", "contact_phone", "phone"),
    "customer_id": ("id", "cust_id", "customerid", "customer_id"),
}
#: Priority of the source systems, first wins.
SOURCE_PRIORITY = ("Salesforce", "ERP", "CRM", "SAP")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise ValueError(f"columns collide after renaming: {twice}")
    return df.toDF(*names)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Names stripped and lower-cased; names that collide then are an error."""
    return _renamed(df, [c.strip().lower() for c in df.columns])


def rename_synonyms(df: DataFrame, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    """Known header variants, in any case, under their standard name."""
    to = {v.lower(): k for k, vs in synonyms.items() for v in vs}
    return _renamed(df, [to.get(c.lower(), c) for c in df.columns])


def trimmed(c: Column) -> Column:
    return F.trim(c.cast("string"))


def typed(c: Column, type_name: str) -> Column:
    """A trimmed value of the declared type; strings are lower-cased, what doesn't parse is NULL."""
    value = trimmed(c)
    kind = data_type(type_name)
    if isinstance(kind, T.StringType):
        return F.lower(value)
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(value)
    return value.try_cast(kind)


def standardize(df: DataFrame, schema: Schema) -> DataFrame:
    """Declared columns typed, others as they are, in one projection; declared columns that are absent are not added."""
    declared = {f.name: f.type for f in schema.fields}
    return df.select(*[typed(quoted(c), declared[c]).alias(c) if c in declared else quoted(c) for c in df.columns])


def repair_date(c: Column) -> Column:
    """A date from yyyy-MM-dd or dd-MM-yyyy text; NULL if it is neither."""
    text = trimmed(c)
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd-MM-yyyy"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def prefix(c: Column, n: int) -> Column:
    return c.substr(1, n)


def email_domain(c: Column) -> Column:
    return F.substring_index(c, "@", -1)


def source_rank(c: Column, order: Sequence[str] = SOURCE_PRIORITY, strict_compat: bool = False) -> Column:
    """1 for the system of highest priority, …; unknown and NULL last.  Names match in any
    case; ``strict_compat``: exactly, so that lower-cased names all rank last."""
    value = c if strict_compat else F.lower(c)
    out = F.when(F.lit(False), F.lit(0))
    for i, name in enumerate(order, 1):
        out = out.when(value == (name if strict_compat else name.lower()), F.lit(i))
    return out.otherwise(F.lit(len(order) + 1))


def created_date(df: DataFrame, column: str = "created_ts", fallback: str = "ingestion_ts") -> DataFrame:
    """``column`` as a date, or a copy of ``fallback`` if there is no such column."""
    if column in df.columns:
        kind = df.schema[column].dataType
        value = repair_date(F.col(column)) if isinstance(kind, T.StringType) else F.to_date(column)
        return df.withColumn(column, value)
    return df.withColumn(column, F.col(fallback))
