"""Source readers by connection type: file, jdbc, api and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keelson.config import Config, Connection, SecretLookup, Source, env_secret

Reader = Callable[[SparkSession, Source, Connection, SecretLookup], DataFrame]


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", infer: bool = False) -> DataFrame:
    """CSV with a header; all strings unless types are inferred."""
    return spark.read.csv(path, header=True, sep=delimiter, inferSchema=infer)


def _file(spark: SparkSession, source: Source, c: Connection, secret: SecretLookup) -> DataFrame:
    options = {"header": "true", **c.options} if c.format == "csv" else c.options
    return spark.read.format(c.format).options(**options).load(source.path)


def _jdbc(spark: SparkSession, source: Source, c: Connection, secret: SecretLookup) -> DataFrame:
    """A table by JDBC.  Give partitionColumn, lowerBound, upperBound and numPartitions in
    the options to read a large one in parallel; filters and columns are pushed down."""
    options = {"url": c.url, "dbtable": c.options.get("dbtable", source.entity), "user": c.user, "password": secret(c.secret) if c.secret else None, "driver": c.driver, **{k: v for k, v in c.options.items() if k != "dbtable"}}
    return spark.read.format("jdbc").options(**{k: v for k, v in options.items() if v is not None}).load()


def _api(spark: SparkSession, source: Source, c: Connection, secret: SecretLookup) -> DataFrame:
    """A registered Python data source named by ``format``; there is no built-in one."""
    if c.format in ("", "csv", "api"):
        raise NotImplementedError(f"source {source.name}: register a Python data source and name it as the connection's format")
    return spark.read.format(c.format).options(**c.options).load()


def _stream(spark: SparkSession, source: Source, c: Connection, secret: SecretLookup) -> DataFrame:
    raise NotImplementedError(f"source {source.name}: streams are read by keelson.streaming, not by a batch job")


READERS: dict[str, Reader] = {"file": _file, "jdbc": _jdbc, "api": _api, "stream": _stream}


def register(kind: str, reader: Reader) -> None:
    READERS[kind] = reader


def read_source(spark: SparkSession, source: Source, config: Config, secret: SecretLookup = env_secret) -> DataFrame:
    """A source by its connection; without one, or with an unknown type, it is read as CSV."""
    connection = config.connections.get(source.name.lower())
    if connection is None or connection.type not in READERS:
        return read_csv(spark, source.path)
    return READERS[connection.type](spark, source, connection, secret)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)
