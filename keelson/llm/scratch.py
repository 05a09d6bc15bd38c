"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back: committed files outlive lost executors, which cached blocks do not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keelson.session import importable
from keelson.sources.files import Folder

FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> Folder:
    """The folder ``spark.checkpoint.dir``.  Only a local master may leave it unset: there all
    tasks share the machine's folders."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that all executors share")
        base = FALLBACK_DIR
        spark.sparkContext.setCheckpointDir(base)
    return Folder(spark, base)


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared one; removed when the driver's JVM ends."""
    shared = shared_dir(spark)
    own = f"keelson-{uuid.uuid4().hex}"
    shared.fs.mkdirs(shared.path(own))
    shared.fs.deleteOnExit(shared.path(own))
    return f"{shared.uri}/{own}/{label}"


def drop_dir(spark: SparkSession, uri: str) -> None:
    Folder(spark, uri).delete()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back."""
    spark = df.sparkSession
    uri = new_dir(spark, label)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


ARROW_BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Prepare a session for Python on texts: workers can import this package, and Arrow
    batches are small.

    Lowers the session's Arrow batches to ARROW_BATCH_BYTES: every task holds a batch
    several times over (in the JVM, on the wire, as Python objects), and texts may be
    long.  A lower setting of the session stays."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > ARROW_BATCH_BYTES:
        spark.conf.set(key, f"{ARROW_BATCH_BYTES}b")
