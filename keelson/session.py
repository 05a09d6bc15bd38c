"""Session factory."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: ANSI stays on: values that may not parse go through try_* functions, which give NULL.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver did.

    Enough in local mode and where executors see the same path; else ship the package
    with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def get_spark(app_name: str = "keelson", master: str | None = None, **conf: str) -> SparkSession:
    """A session with keelson's defaults; ``conf`` keys may use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
