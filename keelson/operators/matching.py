"""Cross-source matching: block, pick survivors, compare the rest with them, promote what differs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.config import DEFAULT_THRESHOLD, Config
from keelson.functions import quality
from keelson.functions import similarity as sim
from keelson.functions.standardize import created_date
from keelson.operators.entities import DRAFT_CUSTOMER, RULES, EntityRule, survivorship_order
from keelson.operators.setops import union_by_name
from keelson.operators.survivors import SALTS, first_of_key, with_survivor
from keelson.session import importable

Score = Callable[[list[tuple[Column, Column]]], Column]


def threshold_of(config: Config | None, entity: str, source_system: Column) -> Column:
    """The similarity threshold of a row's own source; 80 where none is configured."""
    out = F.when(F.lit(False), F.lit(0.0))
    for s in config.sources if config else ():
        if s.entity.lower() == entity.lower():
            out = out.when(F.lower(source_system) == s.name.lower(), F.lit(float(s.similarity_threshold)))
    return out.otherwise(F.lit(DEFAULT_THRESHOLD))


def blocked(df: DataFrame, rule: EntityRule, leave_out: tuple[str, ...] = (), strict_compat: bool = False, salts: int = SALTS) -> DataFrame:
    """``df`` with its blocking columns, ``__survivor`` and ``__main``, the survivor's compared fields."""
    keyed = rule.with_blocks(df, leave_out)
    blocks = [b for b in rule.block_columns if b not in leave_out]
    carry = [c for c in rule.compared if c in keyed.columns]
    return with_survivor(keyed, blocks, survivorship_order(rule, keyed.columns, strict_compat), carry, salts)


def resolve(df: DataFrame, rule: EntityRule, config: Config | None = None, threshold: Column | float | None = None, leave_out: tuple[str, ...] = (), strict_compat: bool = False, score: Score | None = None, salts: int = SALTS) -> DataFrame:
    """Every row of ``df`` with ``similarity`` to its block's survivor and ``silver_type``:
    MAIN for survivors and for rows below their threshold, which are entities of their
    own; CONFLICTED for the rest.

    A row whose fields are all missing on one side scores 0 and is promoted.
    ``strict_compat`` gives such rows, and rows with a NULL blocking key, the type NULL:
    the outputs that would lose them can filter on it."""
    importable(df.sparkSession)
    found = blocked(df, rule, leave_out, strict_compat, salts)
    pairs = [(F.when(~F.col("__survivor"), F.col(c)), F.when(~F.col("__survivor"), F.col(f"__main.{c}"))) for c in rule.compared if c in df.columns]
    found = found.withColumn("similarity", F.when(F.col("__survivor"), F.lit(None).cast("double")).otherwise((score or sim.multi_similarity)(pairs)))
    limit = threshold_of(config, rule.name, F.col("source_system")) if threshold is None else threshold
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    kind = F.when(F.col("__survivor"), "MAIN").when(F.col("similarity") >= limit, "CONFLICTED").otherwise("MAIN")
    if strict_compat:
        blocks = [b for b in rule.block_columns if b not in leave_out]
        unmatched = F.lit(False)
        for b in blocks:
            unmatched = unmatched | F.col(b).isNull()
        lost = ~F.col("__survivor") & (unmatched | (F.col("similarity") == 0))
        kind = F.when(~lost, kind)
    return found.withColumn("silver_type", kind).drop("__survivor", "__main")


def draft_score(pairs: list[tuple[Column, Column]]) -> Column:
    """Weighted similarity of (name, e-mail, phone, id)."""
    return sim.weighted_similarity(*pairs)


def draft_silver(df: DataFrame, strict_compat: bool = False, salts: int = SALTS) -> DataFrame:
    """The draft rule for customers: rows with an id and well-formed e-mail and telephone,
    blocked by mail domain, telephone prefix and sound of the first name, compared by
    weights, threshold 80."""
    rule = DRAFT_CUSTOMER
    good, _ = quality.split(df, quality.present(rule.required) & quality.valid_email(F.col("email")) & quality.valid_phone(F.col("phone")))
    return resolve(created_date(good), rule, threshold=80.0, strict_compat=strict_compat, score=draft_score, salts=salts)


def silver(df: DataFrame, config: Config | None = None, strict_compat: bool = False, salts: int = SALTS) -> DataFrame:
    """All entities of a bronze union in one table, with silver_type; an unknown entity passes as MAIN."""
    df = created_date(df)
    parts = []
    for name in sorted(RULES):
        of = df.where(F.lower("entity") == name)
        rule = RULES[name]
        if all(c in df.columns for c in rule.identity):
            parts.append(resolve(_with_columns(of, rule), rule, config, strict_compat=strict_compat, salts=salts))
        else:
            parts.append(of.withColumn("silver_type", F.lit("MAIN")))
    other = df.where(F.col("entity").isNull() | ~F.lower("entity").isin(*RULES))
    return union_by_name(*parts, other.withColumn("silver_type", F.lit("MAIN")))


def _with_columns(df: DataFrame, rule: EntityRule) -> DataFrame:
    """``df`` with the columns its blocking needs, NULL where the sources have none."""
    missing = [c for c in rule.reads if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df


def golden(df: DataFrame, rule: EntityRule, strict_compat: bool = False) -> DataFrame:
    """One record for each identity, by source priority and recency, in the rule's gold columns."""
    best = first_of_key(df, list(rule.identity), survivorship_order(rule, df.columns, strict_compat))
    if rule.gold_columns is None:
        return best
    return best.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in rule.gold_columns])
