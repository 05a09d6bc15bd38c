"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.scratch import drop_dir, materialize, new_dir

MAX_ROUNDS = 100
#: A node with more than so many-th of all edge ends is a hub.
HUB_SHARE = 256


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")


def _with_least(rows: DataFrame, least: Column) -> DataFrame:
    """``rows`` (src, …) with ``least`` of all rows of their src.

    A node with more than a HUB_SHAREth of all rows is a hub; there are fewer than
    HUB_SHARE of them, so theirs are broadcast and their rows stay where they are.
    Of the other nodes none makes a partition large."""
    known = materialize(rows.groupBy("src").agg(least.alias("least"), F.count("*").alias("degree")), "components-least")
    total = known.agg(F.sum("degree")).first()[0] or 0
    hub = F.col("degree") * HUB_SHARE > F.lit(total)
    hubs = F.broadcast(known.where(hub).select("src", F.col("least").alias("of_hub")))
    marked = rows.join(hubs, "src", "left")
    at_hubs = marked.where("of_hub is not null").withColumnRenamed("of_hub", "least")
    others = marked.where("of_hub is null").drop("of_hub").join(known.where(~hub).drop("degree"), "src")
    return at_hubs.unionByName(others)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    near = _with_least(_both_ways(edges), F.least(F.min("dst"), F.min("src")))
    return near.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    moved = _with_least(down, F.min("dst"))
    pairs = F.array(F.struct(F.col("dst").alias("src"), F.col("least").alias("dst")), F.struct(F.col("src").alias("src"), F.col("least").alias("dst")))
    return moved.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").where("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (src, dst): label is the least node of its component.

    Edges may be repeated and point either way; loops are ignored.  Each round is
    written to the shared folder, and only a count and a checksum reach the
    driver.  The number of rounds grows with the logarithm of the diameter.
    """
    spark = edges.sparkSession
    now, before, last = edges.where("src <> dst").select("src", "dst"), None, None
    for _ in range(MAX_ROUNDS):
        uri = new_dir(spark, "components-round")
        _small_star(materialize(_large_star(now), "components-large")).write.parquet(uri)
        now = spark.read.schema(edges.select("src", "dst").schema).parquet(uri)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())
        if before is not None:
            drop_dir(spark, before)
        before = uri
        if state == last:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("label"))).distinct()
        last = state
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
