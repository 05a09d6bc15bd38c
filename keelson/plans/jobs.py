"""The four batch jobs: ingest, bronze, silver, gold.

Every job isolates its sources or entities: one that fails leaves an error row
and a FAILED audit row, and the others go on.  Counts come from the tables' logs,
so that nothing is computed twice to be counted.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson import schema as schemas
from keelson.config import Config, SecretLookup, Source, env_secret
from keelson.functions import quality
from keelson.functions.standardize import normalize_headers, rename_synonyms, standardize
from keelson.operators import dedupe, matching
from keelson.operators.entities import RULES
from keelson.operators.setops import labelled, union_by_name
from keelson.operators.survivors import SALTS, with_survivor
from keelson.plans.audit import Outcome, Run, now
from keelson.sources.readers import read_source
from keelson.sources.store import NoSuchTable, Table

# The load types of run records.
INITIALIZE, MERGE, DEDUP, NO_NEW = "INITIALIZE", "MERGE", "DEDUP", "NO_NEW"
SILVER_TYPE, GOLD_TYPE = "GLOBAL_SURVIVORSHIP+SIMILARITY", "GLOBAL_GOLD_SSOT"


#: Sources loaded side by side; Spark shares its executors among their jobs.
SOURCES_AT_ONCE = 4


def _each_source(run: Run, only: str | None, step: Callable[[Source], None]) -> None:
    def isolated(source: Source) -> None:
        start = now()
        try:
            step(source)
        except Exception as error:  # one source must not stop the others
            run.failed(source.name, source.key, error, start)

    sources = run.config.selected(only)
    with ThreadPoolExecutor(SOURCES_AT_ONCE) as pool:
        list(pool.map(inheritable_thread_target(run.spark)(isolated), sources))
    place = {s.key: i for i, s in enumerate(sources)}
    run.outcomes.sort(key=lambda o: place[o.target])


# ---------------------------------------------------------------- ingest


def prepared(df: DataFrame, source: Source, config: Config, run_id: str, at: datetime) -> DataFrame:
    """Source rows with standard headers and types and the technical columns of RAW."""
    df = rename_synonyms(normalize_headers(df))
    if source.key in config.schemas:
        df = standardize(df, schemas.from_config(source.key, {"schemas": config.schemas}))
    stamp = F.lit(at).cast("timestamp")
    return df.withColumns({"source_system": F.lit(source.name), "entity": F.lit(source.entity), "ingestion_ts": stamp, "ingestion_date": F.to_date(stamp), "run_id": F.lit(run_id), "updated_ts": stamp})


def natural_keys(source: Source, config: Config) -> list[str]:
    keys = schemas.from_config(source.key, {"schemas": config.schemas}).natural_keys if source.key in config.schemas else []
    if not keys:
        raise ValueError(f"{source.key} declares no natural key")
    return keys


def ingest(spark: SparkSession, config: Config, only: str | None = None, secret: SecretLookup = env_secret, at: datetime | None = None) -> Run:
    """Load every source into its RAW table: the first time as it is, then by upsert on the
    natural keys; ``ingestion_ts`` keeps the time a row first came, ``updated_ts`` moves."""
    run = Run(spark, config, "raw_ingestion")

    def step(source: Source) -> None:
        outcome = Outcome(source.key, INITIALIZE)
        stamp = at or now()
        keys = natural_keys(source, config)
        rows = prepared(read_source(spark, source, config, secret), source, config, run.run_id, stamp)
        raw = Table(spark, config.path("raw", source.name, source.entity))
        if config.reset_mode or not raw.exists():
            raw.overwrite(rows, ["ingestion_date"])
            outcome.incoming = outcome.inserted = raw.count()
        else:
            outcome.load_type = MERGE
            done = raw.metrics(raw.upsert(rows, keys, preserve=["ingestion_ts"]))
            outcome.incoming, outcome.inserted = done["rows_in_source"], done["rows_inserted"]
        run.done(source.name, source.path, raw.uri, outcome)

    _each_source(run, only, step)
    run.finish()
    return run


# ---------------------------------------------------------------- bronze


def last_checkpoint(spark: SparkSession, config: Config, source: Source) -> datetime | None:
    """The newest change that bronze has seen of a source; None if it has seen nothing."""
    table = Table(spark, config.path("system", "checkpoint"))
    if not table.exists():
        return None
    return table.read().where((F.col("source_system") == source.name) & (F.col("entity") == source.entity)).agg(F.max("last_ingestion_ts")).first()[0]


def changed_since(df: DataFrame, column: str, since: datetime | None, partition: str = "ingestion_date") -> DataFrame:
    """Rows with ``column`` after ``since``.  An ingestion time also bounds the partition date, so older folders aren't read."""
    if since is None:
        return df
    stamp = F.lit(since).cast("timestamp")
    newer = df.where(F.col(column) > stamp)
    if column == "ingestion_ts" and partition in df.columns:
        # an upsert moves a row to a later date and keeps its ingestion time, never the other way round
        newer = newer.where(F.col(partition) >= F.to_date(stamp))
    return newer


def split_bronze(df: DataFrame, source: Source, order_by: str = "updated_ts", salts: int = SALTS) -> DataFrame:
    """Every row with bronze_type: MAIN for the newest row of each key, else CONFLICTED."""
    if missing := [k for k in source.dedupe_keys if k not in df.columns]:
        raise ValueError(f"dedupe keys {missing} of {source.key} are not among its columns")
    tie = [c for c in ("customer_id", *df.columns) if c in df.columns and c not in (order_by, *source.dedupe_keys)]
    order = dedupe.newest_first(order_by, *dict.fromkeys(tie))
    marked = with_survivor(df, list(source.dedupe_keys), order, salts=salts)
    return marked.withColumn("bronze_type", F.when(F.col("__survivor"), "MAIN").otherwise("CONFLICTED")).drop("__survivor", "__main")


#: MAIN and CONFLICTED are partitions of one table: one ranked pass, one write and one commit
#: for both, and a reader of one side never opens the files of the other.
BRONZE_LAYOUT = ["bronze_type", "ingestion_date"]


def bronze_table(spark: SparkSession, config: Config, source: Source) -> Table:
    return Table(spark, config.path("bronze", source.name, source.entity))


def bronze_side(spark: SparkSession, config: Config, source: Source, side: str = "MAIN") -> DataFrame:
    """The MAIN or the CONFLICTED rows of a source."""
    return bronze_table(spark, config, source).read().where(F.col("bronze_type") == side)


def bronze_counts(table: Table) -> tuple[int, int]:
    """(MAIN, CONFLICTED) rows, from the log."""
    return table.count(partition="bronze_type=MAIN"), table.count(partition="bronze_type=CONFLICTED")


def bronze(spark: SparkSession, config: Config, only: str | None = None, change_column: str = "ingestion_ts", at: datetime | None = None) -> Run:
    """Split what is new in RAW into MAIN and CONFLICTED.

    ``change_column``: ``ingestion_ts`` sees each row once, when it first comes;
    ``updated_ts`` sees updates too.  A batch is ranked within itself and appended;
    :func:`global_latest` gives one row for each key over all batches."""
    run = Run(spark, config, "deduplication")

    def step(source: Source) -> None:
        outcome = Outcome(source.key, DEDUP)
        raw = Table(spark, config.path("raw", source.name, source.entity))
        if not raw.exists() or raw.count() == 0:
            raise NoSuchTable(f"RAW of {source.key} is empty")
        since = None if config.reset_mode else last_checkpoint(spark, config, source)
        fresh = changed_since(raw.read(), change_column, since)
        newest = fresh.agg(F.max(change_column)).first()[0]
        table = bronze_table(spark, config, source)
        if newest is None:
            outcome.load_type = NO_NEW
            run.outcomes.append(outcome)
            return
        stamp = F.lit(at or now()).cast("timestamp")
        rows = split_bronze(fresh, source).withColumns({"dedupe_run_id": F.lit(run.run_id), "dedupe_ts": stamp, "ingestion_date": F.to_date(stamp)})
        before = (0, 0) if config.reset_mode or not table.exists() else bronze_counts(table)
        if config.reset_mode:
            table.overwrite(rows, BRONZE_LAYOUT)
        else:
            table.append(rows, BRONZE_LAYOUT)
        outcome.inserted, outcome.conflicted = (x - y for x, y in zip(bronze_counts(table), before, strict=True))
        outcome.incoming = outcome.inserted + outcome.conflicted
        mark = [(source.name, source.entity, newest, run.run_id, now(), config.environment)]
        Table(spark, config.path("system", "checkpoint")).append(spark.createDataFrame(mark, schemas.SYSTEM["checkpoint"]).coalesce(1))
        run.done(source.name, raw.uri, table.uri, outcome)

    _each_source(run, only, step)
    run.finish()
    return run


def global_latest(main: DataFrame, source: Source, order_by: str = "updated_ts") -> DataFrame:
    """Bronze MAIN of all batches with one row, the newest, for each key."""
    return dedupe.main_rows(main, list(source.dedupe_keys), dedupe.newest_first(order_by, *[c for c in main.columns if c not in (order_by, *source.dedupe_keys)]))


def bronze_totals(spark: SparkSession, config: Config) -> dict[str, int]:
    """Rows of all sources' MAIN and CONFLICTED sides, from the tables' logs."""
    counts = [bronze_counts(t) for t in (bronze_table(spark, config, s) for s in config.sources) if t.exists()]
    return {"MAIN": sum(m for m, _ in counts), "CONFLICTED": sum(c for _, c in counts)}


def reset_checkpoints(spark: SparkSession, config: Config) -> bool:
    """Forget what bronze has seen, streams included; whether there was anything."""
    removed = Table(spark, config.path("system", "checkpoint")).folder.delete()
    streams = Table(spark, config.path("checkpoints")).folder.delete()
    return removed or streams


# ---------------------------------------------------------------- silver


def bronze_union(spark: SparkSession, config: Config, missing: str = "skip") -> DataFrame:
    """MAIN of all sources by name, with lower-cased entity and source_system.  ``missing``: skip or error."""
    parts = []
    for s in config.sources:
        if bronze_table(spark, config, s).exists():
            parts.append(labelled(bronze_side(spark, config, s), entity=s.entity, source_system=s.name))
        elif missing == "error":
            raise NoSuchTable(f"no bronze table of {s.key}")
    if not parts:
        raise NoSuchTable("no source has a bronze table")
    return union_by_name(*parts)


def silver_table(spark: SparkSession, config: Config) -> Table:
    """Main and conflicted records of all sources, partitioned by silver_type."""
    return Table(spark, config.path("silver", "global"))


def silver(spark: SparkSession, config: Config, check_quality: bool = True, strict_compat: bool = False, by_source: bool = False) -> Run:
    """Match all sources into main and conflicted records.  Rows without required fields go
    to silver_rejected.  ``by_source`` also partitions the table by source system."""
    run = Run(spark, config, "silver")
    outcome = Outcome("GLOBAL", SILVER_TYPE)
    start = now()
    try:
        rows = bronze_union(spark, config)
        good = F.lit(True)
        if check_quality:
            for name, rule in RULES.items():
                needed = [c for c in rule.required if c in rows.columns]
                good = good & ((F.lower("entity") != name) | quality.present(needed))
            kept, bad = quality.split(rows, good)
            rejected = Table(spark, config.path("silver_rejected"))
            rejected.overwrite(bad)
            run.rejected("GLOBAL", "ALL", "required fields", rejected.count())
            rows = kept
        table = silver_table(spark, config)
        table.overwrite(matching.silver(rows, config, strict_compat), ["silver_type", "source_system"] if by_source else ["silver_type"])  # similarity is computed once, for both sides
        outcome.incoming = table.count()
        outcome.inserted, outcome.conflicted = table.count(partition="silver_type=MAIN"), table.count(partition="silver_type=CONFLICTED")
        run.done("GLOBAL", config.path("bronze"), table.uri, outcome)
    except Exception as error:
        run.failed("GLOBAL", "GLOBAL", error, start)
    run.finish()
    return run


# ---------------------------------------------------------------- gold


def gold(spark: SparkSession, config: Config, strict_compat: bool = False, at: datetime | None = None) -> Run:
    """Golden records: main and conflicted of silver compete again; a table for each entity."""
    run = Run(spark, config, "gold")
    start = now()
    try:
        both = silver_table(spark, config).read().where(F.col("silver_type").isin("MAIN", "CONFLICTED"))
        counts = {r["entity"]: r["n"] for r in both.groupBy(F.lower("entity").alias("entity")).agg(F.count("*").alias("n")).collect()}
    except Exception as error:
        run.failed("GLOBAL", "GLOBAL", error, start)
        run.finish()
        return run
    for entity in sorted(e for e in counts if e is not None):
        start = now()
        try:
            of = both.where(F.lower("entity") == entity)
            rows = matching.golden(of, RULES[entity], strict_compat) if entity in RULES else of
            rows = rows.drop("silver_type", "similarity", "bronze_type")
            table = Table(spark, config.path("gold", entity))
            table.overwrite(rows.withColumn("ingestion_date", F.lit(f"{(at or now()):%Y-%m-%d}")), ["ingestion_date"])
            run.done("GLOBAL", silver_table(spark, config).uri, table.uri, Outcome(entity, GOLD_TYPE, counts[entity], table.count(), 0, start=start))
        except Exception as error:
            run.failed("GLOBAL", entity, error, start)
    run.finish()
    return run


def gold_summary(run: Run) -> DataFrame:
    """(entity, input_count, output_count) of a gold run."""
    return run.spark.createDataFrame([(o.target, o.incoming, o.inserted) for o in run.outcomes if o.load_type == GOLD_TYPE], "entity string, input_count long, output_count long")


def run_all(spark: SparkSession, config: Config, change_column: str = "ingestion_ts") -> list[Run]:
    """The four jobs in order."""
    return [ingest(spark, config), bronze(spark, config, change_column=change_column), silver(spark, config), gold(spark, config)]
