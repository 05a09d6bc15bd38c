"""Streaming deduplication: the first row of each key wins.

State is kept in RocksDB if the session is keelson's.  With ``bounded`` a key is
forgotten once the watermark has passed it; without, as long as the stream runs.
Micro-batches go into a store table under (stream, epoch), so an epoch that is
retried after a failure is there once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keelson.config import Config, Source
from keelson.sources.readers import read_stream
from keelson.sources.store import TXN, Table

WATERMARK = "10 minutes"


def first_arrivals(stream: DataFrame, keys: Sequence[str], event_time: str = "ingestion_ts", watermark: str = WATERMARK, bounded: bool = False) -> DataFrame:
    """The first row of each key; rows later than the watermark are dropped."""
    marked = stream.withWatermark(event_time, watermark)
    return marked.dropDuplicatesWithinWatermark(list(keys)) if bounded else marked.dropDuplicates(list(keys))


def write_to_store(stream: DataFrame, uri: str, checkpoint: str, name: str, partition_by: Sequence[str] = (), available_now: bool = False) -> StreamingQuery:
    """Append a stream to a store table, each epoch once."""
    spark = stream.sparkSession

    def commit(batch: DataFrame, epoch: int) -> None:
        Table(spark, uri).append(batch, list(partition_by), txn=(name, epoch))

    writer = stream.writeStream.outputMode("append").queryName(name).option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedupe_source(spark: SparkSession, config: Config, source: Source, path: str, schema, available_now: bool = False, bounded: bool = False, **options: str) -> StreamingQuery:
    """Deduplicate the files arriving at ``path`` into the source's streamed table."""
    rows = read_stream(spark, path, schema, **options)
    if "ingestion_date" not in rows.columns:
        rows = rows.withColumn("ingestion_date", F.to_date("ingestion_ts"))
    name = f"{source.name}_{source.entity}_main".lower()
    unique = first_arrivals(rows.drop(TXN), source.dedupe_keys, bounded=bounded)
    return write_to_store(unique, config.path("bronze_stream", source.name, source.entity), f"{config.path('checkpoints')}/{name}", name, ["ingestion_date"], available_now)


def dedupe_all(spark: SparkSession, config: Config, only: str | None = None, available_now: bool = False) -> list[StreamingQuery]:
    """A query for each source whose RAW table has data; they run side by side and see
    committed files alone."""
    queries = []
    for source in config.selected(only):
        raw = Table(spark, config.path("raw", source.name, source.entity))
        if not raw.exists():
            continue
        # RAW's data folders carry the transaction as a partition column; rows that an upsert
        # rewrote are suppressed by their keys
        schema = T.StructType([*raw.schema().fields, T.StructField(TXN, T.StringType())])
        queries.append(dedupe_source(spark, config, source, raw.publish(), schema, available_now))
    return queries


def wait(spark: SparkSession, queries: Sequence[StreamingQuery], available_now: bool = False) -> None:
    if available_now:
        for q in queries:
            q.awaitTermination()
    elif queries:
        spark.streams.awaitAnyTermination()
