"""Size-tiered shards of a corpus under a versioned manifest.

Arrivals are appended as small immutable Parquet files.  Compaction groups runs
of like size (one tier: sizes within a factor of ``FAN_IN``) and merges each
group into one larger file, tier by tier, up to the target size.  A merge reads
whole files in one task and writes one file, so it moves nothing between tasks.
Each version is a JSON manifest that appears at once and only if the version is
new; readers see a version whole or not at all.  Of two appends at once the later
commits again on top of the other; a compaction that another writer overtook
fails.  Files that no manifest names (of lost tasks or writers) are never read.
Files that a merge replaces stay, so that readers of older versions go on, until
``vacuum`` deletes those that only old versions name.

In DataFrame operations only; the driver holds a line of metadata for each file.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.scratch import drop_dir, new_dir
from keelson.sources.files import AlreadyThere, Folder

FAN_IN = 4
SMALL_BYTES = 4 << 20
TARGET_BYTES = 128 << 20
#: Merges planned in one job, and jobs that run side by side.
GROUPS_A_JOB = 256
JOBS_AT_ONCE = 4
APPEND_RETRIES = 20
#: Up to so many files their numbers are broadcast, some 200 bytes each.
BROADCAST_RUNS = 20_000


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    rows: int


def tier_of(size: int, small: int = SMALL_BYTES, fan_in: int = FAN_IN) -> int:
    """0 for runs below ``small``, then one more for each factor of ``fan_in``."""
    return 0 if size < small else 1 + int(math.log(size / small, fan_in) + 1e-9)


def plan_merges(runs: list[Run], fan_in: int = FAN_IN, small: int = SMALL_BYTES, target: int = TARGET_BYTES) -> list[list[Run]]:
    """Groups of like-sized runs to merge now, from the smallest up: a group is complete at
    ``fan_in`` runs of one tier or at three quarters of the target size, and never
    exceeds the target by more than a quarter.  Incomplete groups wait for more runs."""
    tiers: dict[int, list[Run]] = {}
    for r in runs:
        if r.bytes < target:
            tiers.setdefault(tier_of(r.bytes, small, fan_in), []).append(r)
    groups = []
    for _, members in sorted(tiers.items()):
        group: list[Run] = []
        for r in sorted(members, key=lambda r: (r.bytes, r.path)):
            if sum(x.bytes for x in group) + r.bytes > 1.25 * target:
                group = []
            group.append(r)
            if len(group) > 1 and (len(group) >= fan_in or sum(x.bytes for x in group) >= 0.75 * target):
                groups.append(group)
                group = []
    return groups


class ShardSet:
    """A folder of shards and manifests, at any URI that Spark can write."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.folder = spark, Folder(spark, uri)

    @property
    def uri(self) -> str:
        return self.folder.uri

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        return max((int(n[1:-5]) for n in self.folder.names("manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        return self.folder.read_json(f"manifests/v{version:012d}.json")

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**x) for x in self.manifest(version)["runs"]]

    def _commit(self, parent: int, operation: str, schema: str, runs: list[Run]) -> int:
        version = parent + 1
        body = {"version": version, "at": time.time(), "operation": operation, "schema": schema, "runs": [asdict(r) for r in sorted(runs, key=lambda r: r.path)]}
        self.folder.create_json(f"manifests/v{version:012d}.json", body)
        return version

    def _written(self, folder: str, schema) -> list[Run]:
        """The runs of a folder that Spark has just committed: rows by file, without reading texts."""
        rows = self.spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return [Run(r["path"], r["bytes"], r["rows"]) for r in rows.toLocalIterator()]

    def _new_folder(self) -> str:
        return f"{self.uri}/data/{uuid.uuid4().hex}"

    def append(self, docs: DataFrame) -> int:
        """Add ``docs`` as small shards, one for each of its partitions that has rows."""
        folder = self._new_folder()
        docs.write.parquet(folder)
        made = self._written(folder, docs.schema)
        for _ in range(APPEND_RETRIES):
            parent = self.manifest()
            try:
                return self._commit(parent["version"], "append", docs.schema.json(), [Run(**x) for x in parent["runs"]] + made)
            except AlreadyThere:
                continue
        raise AlreadyThere(f"{self.uri}: {APPEND_RETRIES} versions were taken by other writers")

    def compact(self, fan_in: int = FAN_IN, small: int = SMALL_BYTES, target: int = TARGET_BYTES, vacuum: bool = False) -> int:
        """Merge until no tier has a group to merge; one version for each pass.  Files that a
        pass replaces stay readable in older versions; ``vacuum`` deletes them after each
        pass, for sets that nobody else reads yet."""
        from pyspark.sql.types import StructType

        while True:
            parent = self.manifest()
            runs = [Run(**x) for x in parent["runs"]]
            groups = plan_merges(runs, fan_in, small, target)
            if not groups:
                return parent["version"]
            schema = StructType.fromJson(json.loads(parent["schema"]))
            jobs = [groups[i : i + GROUPS_A_JOB] for i in range(0, len(groups), GROUPS_A_JOB)]

            def merged(job: list[list[Run]], schema: StructType = schema) -> list[Run]:
                parts = [self.spark.read.schema(schema).parquet(*[r.path for r in g]).coalesce(1) for g in job]
                folder = self._new_folder()
                reduce(DataFrame.union, parts).write.parquet(folder)
                return self._written(folder, schema)

            with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
                made = [r for runs in pool.map(inheritable_thread_target(self.spark)(merged), jobs) for r in runs]
            gone = {r.path for g in groups for r in g}
            before = sum(r.rows for g in groups for r in g)
            if sum(r.rows for r in made) != before:
                raise RuntimeError("a merge lost or repeated rows; the manifest stays as it was")
            self._commit(parent["version"], "compact", parent["schema"], [r for r in runs if r.path not in gone] + made)
            if vacuum:
                self.vacuum()

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.folder.names("manifests") if n.startswith("v") and n.endswith(".json"))

    def vacuum(self, keep_versions: int = 1, least_age: float = 0.0) -> int:
        """Delete the files that only versions before the last ``keep_versions`` name, and
        these versions' manifests; versions committed in the last ``least_age`` seconds stay.
        Returns how many files went."""
        known = self.versions()
        manifests = {v: self.manifest(v) for v in known}
        kept = {v for v in known if v in known[-max(1, keep_versions) :] or manifests[v]["at"] > time.time() - least_age}
        # a version that stays keeps all later ones
        kept |= {v for v in known if kept and v > min(kept)}
        needed = {r["path"] for v in kept for r in manifests[v]["runs"]}
        gone = {r["path"] for v in known if v not in kept for r in manifests[v]["runs"]} - needed
        for path in sorted(gone):
            drop_dir(self.spark, path)
        for v in known:
            if v not in kept:
                self.folder.delete(f"manifests/v{v:012d}.json")
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with the columns ``__path`` and ``__bytes`` of their shard; None before the first commit."""
        from pyspark.sql.types import StructType

        manifest = self.manifest(version)
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [r["path"] for r in manifest["runs"]]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("__path", F.lit("")).withColumn("__bytes", F.lit(0).cast("long"))
        return self.spark.read.schema(schema).parquet(*paths).withColumns({"__path": F.col("_metadata.file_path"), "__bytes": F.col("_metadata.file_size")})


def shard(docs: DataFrame, id_col: str = "doc_id", uri: str | None = None, fan_in: int = FAN_IN, small: int = SMALL_BYTES, target: int = TARGET_BYTES) -> DataFrame:
    """Append ``docs`` to a shard set, compact it, and say where each document went:
    (id, shard, tier, shard_rows, version), a row for each row of the newest version.

    shard numbers the files of that version from 0 in the order of their first id
    (and size, and path).  NULL ids, repeated rows and NULL or long texts are
    stored as they are; columns may have any names; an empty table gives an empty
    result.  A set of its own (no ``uri``) keeps its newest version alone."""
    spark = docs.sparkSession
    store = ShardSet(spark, uri or new_dir(spark, "shards"))
    store.append(docs)
    version = store.compact(fan_in, small, target, vacuum=uri is None)
    rows = store.read(version).select(F.col(id_col).alias("id"), F.col("__path").alias("path"), F.col("__bytes").alias("bytes"))
    firsts = {r["path"]: (r["first"] is None, r["first"]) for r in rows.groupBy("path").agg(F.min("id").alias("first")).toLocalIterator()}
    order = sorted(store.runs(version), key=lambda r: (firsts[r.path], r.bytes, r.path))
    known = [(r.path, i, tier_of(r.bytes, small, fan_in), r.rows) for i, r in enumerate(order)]
    names = spark.createDataFrame(known, "path string, shard int, tier int, shard_rows long")
    names = F.broadcast(names) if len(known) <= BROADCAST_RUNS else names
    return rows.join(names, "path").select("id", "shard", "tier", "shard_rows", F.lit(version).cast("long").alias("version"))
