"""One survivor for each key, safe for hot keys.

A plain window sends all rows of a key to one task.  Here rows are ranked within
(key, salt) first, the best of each salt compete for the key, and the winner is
joined back; a key that holds a third of the table is spread over ``salts``
tasks, and the join is one that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.operators.dedupe import require_columns

SALTS = 16


def _null_safe(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}"))
    return on


def with_survivor(df: DataFrame, keys: Sequence[str], order: Sequence[Column], carry: Sequence[str] = (), salts: int = SALTS) -> DataFrame:
    """``df`` with ``__survivor`` (true for the first row of its key by ``order``) and
    ``__main``, a struct of the survivor's columns ``carry``.  NULL keys form one group.

    ``order`` should be total; rows that tie are repeated rows and either may win."""
    require_columns(df, [*keys, *carry])
    keyed = [F.col(k) for k in keys]
    main = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(1).alias("one"))
    if salts <= 1:
        w = Window.partitionBy(*keyed).orderBy(*order)
        # the survivor's columns come from the same sorted partition: no self-join
        return df.withColumns({"__survivor": F.row_number().over(w) == 1, "__main": F.first(main).over(w)})
    salt = F.pmod(F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(salts)).cast("int")
    salted = df.withColumn("__salt", salt)
    local = salted.withColumn("__local", F.row_number().over(Window.partitionBy(*keyed, "__salt").orderBy(*order)))
    best = local.where("__local = 1").withColumn("__best", F.row_number().over(Window.partitionBy(*keyed).orderBy(*order))).where("__best = 1")
    winners = best.select(*[k.alias(f"__w{i}") for i, k in enumerate(keyed)], F.col("__salt").alias("__winner"), main.alias("__main"))
    rows = local.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keyed)])
    joined = rows.join(winners, _null_safe(keys, "__k", "__w"))
    survivor = (F.col("__local") == 1) & (F.col("__salt") == F.col("__winner"))
    return joined.withColumn("__survivor", survivor).select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], "__survivor", "__main")


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Only the survivors; all but one row of a key and task are dropped before the shuffle."""
    require_columns(df, keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
