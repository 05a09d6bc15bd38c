import datetime
import random

import pytest
from pyspark.sql import functions as F

from keelson.config import config_from
from keelson.plans import catalog, jobs
from keelson.sources.store import NoSuchTable, Table

FIELDS = [{"name": "customer_id", "type": "string", "natural_key": True}, *({"name": c, "type": "string"} for c in ("first_name", "last_name", "email", "phone")), {"name": "created_ts", "type": "date"}]


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour, tzinfo=datetime.UTC)


def make(root, names=("CRM", "ERP"), **more):
    sources = [{"name": n, "path": f"{root}/{n}.csv", "entity": "customer", "dedupe_keys": ["email", "phone"], "similarity_threshold": 95} for n in names]
    return config_from({"root": f"{root}/lake", "sources": sources, "schemas": {f"{n}_customer".lower(): {"fields": FIELDS} for n in names}, **more})


def write_csv(root, name, rows, header="Cust_ID,first_name,last_name,Email,Phone,created_ts"):
    (root / f"{name}.csv").write_text("\n".join([header, *(",".join(r) for r in rows)]) + "\n")


BASE = [("c1", "Ann", "Lee", "a@x.com", "111", "2024-01-01"), ("c2", "Ann", "Lee", "a@x.com", "111", "2024-01-02"), ("c3", "Bob", "Roe", "b@x.com", "222", "2024-01-03")]


@pytest.fixture
def root(tmp_path):
    write_csv(tmp_path, "CRM", BASE)
    write_csv(tmp_path, "ERP", BASE[:1])
    return tmp_path


def test_first_load_then_upsert(spark, root):
    config = make(root)
    first = jobs.ingest(spark, config, at=at(1))
    assert [(o.target, o.load_type, o.incoming, o.inserted) for o in first.outcomes] == [("crm_customer", "INITIALIZE", 3, 3), ("erp_customer", "INITIALIZE", 1, 1)]
    write_csv(root, "CRM", [("c1", "Anna", "Lee", "a@x.com", "111", "2024-01-01"), ("c9", "Zoe", "Poe", "z@x.com", "999", "2024-01-09")])
    second = jobs.ingest(spark, config, "crm", at=at(2))
    assert [(o.target, o.load_type, o.incoming, o.inserted) for o in second.outcomes] == [("crm_customer", "MERGE", 2, 1)]
    got = {r["customer_id"]: r for r in Table(spark, config.path("raw", "CRM", "customer")).read().collect()}
    assert set(got) == {"c1", "c2", "c3", "c9"}
    assert got["c1"]["first_name"] == "anna"
    assert got["c1"]["ingestion_ts"].day == 1 and got["c1"]["updated_ts"].day == 2
    assert got["c1"]["ingestion_date"] == datetime.date(2024, 1, 2)
    assert got["c2"]["updated_ts"].day == 1


def test_a_failing_source_does_not_stop_the_others(spark, root):
    (root / "CRM.csv").unlink()
    run = jobs.ingest(spark, make(root))
    assert {o.target: o.status for o in run.outcomes} == {"crm_customer": "FAILED", "erp_customer": "SUCCESS"}
    config = make(root)
    audit = Table(spark, config.path("system", "audit")).read().collect()
    assert {r["target"]: r["status"] for r in audit}["JOB_SUMMARY"] == "FAILED"
    errors = Table(spark, config.path("system", "error")).read().collect()
    assert [e["source_system"] for e in errors] == ["CRM"]
    assert Table(spark, config.path("system", "lineage")).read().count() == 1


def test_no_natural_key_is_an_error(spark, root):
    config = make(root, schemas={})
    assert {o.status for o in jobs.ingest(spark, config).outcomes} == {"FAILED"}


def test_incremental_bronze(spark, root):
    config = make(root, ("CRM",))
    jobs.ingest(spark, config, at=at(1))
    run = jobs.bronze(spark, config, at=at(1, 1))
    assert [(o.load_type, o.incoming, o.inserted, o.conflicted) for o in run.outcomes] == [("DEDUP", 3, 2, 1)]
    assert [o.load_type for o in jobs.bronze(spark, config).outcomes] == ["NO_NEW"]
    write_csv(root, "CRM", [("c1", "Anna", "Lee", "a@x.com", "111", "2024-01-01"), ("c4", "Ann", "Lee", "a@x.com", "111", "2024-02-02"), ("c5", "Eve", "Roe", "e@x.com", "5", "2024-02-02")])
    jobs.ingest(spark, config, at=at(2))
    by_insert = jobs.bronze(spark, config, at=at(2, 1))
    assert [(o.incoming, o.inserted, o.conflicted) for o in by_insert.outcomes] == [(2, 2, 0)], "batches are ranked within themselves; the update of c1 keeps its old ingestion time"
    main = jobs.bronze_side(spark, config, config.sources[0])
    assert main.where("email = 'a@x.com'").count() == 2
    assert jobs.global_latest(main, config.sources[0]).where("email = 'a@x.com'").count() == 1
    assert jobs.bronze_totals(spark, config) == {"MAIN": 4, "CONFLICTED": 1}
    assert jobs.reset_checkpoints(spark, config)
    again = jobs.bronze(spark, make(root, ("CRM",), reset_mode=True), at=at(3))
    assert [(o.incoming, o.inserted, o.conflicted) for o in again.outcomes] == [(5, 3, 2)]
    assert jobs.bronze_totals(spark, config) == {"MAIN": 3, "CONFLICTED": 2}


def test_updates_are_seen_by_updated_ts(spark, root):
    config = make(root, ("CRM",))
    jobs.ingest(spark, config, at=at(1))
    jobs.bronze(spark, config, change_column="updated_ts")
    write_csv(root, "CRM", [("c1", "Anna", "Lee", "a@x.com", "111", "2024-01-01")])
    jobs.ingest(spark, config, at=at(2))
    assert [o.incoming for o in jobs.bronze(spark, config, change_column="updated_ts").outcomes] == [1]


def test_empty_raw_fails(spark, root):
    assert {o.status for o in jobs.bronze(spark, make(root)).outcomes} == {"FAILED"}


def test_silver_and_gold(spark, root):
    config = make(root)
    jobs.ingest(spark, config)
    jobs.bronze(spark, config)
    silver = jobs.silver(spark, config)
    assert silver.status == "SUCCESS"
    o = silver.outcomes[0]
    plan = jobs.bronze_side(spark, config, config.sources[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bronze_type" in plan
    assert (o.incoming, o.inserted + o.conflicted) == (3, 3)
    gold = jobs.gold(spark, config)
    assert [(r["entity"], r["input_count"], r["output_count"]) for r in jobs.gold_summary(gold).collect()] == [("customer", 3, 2)]
    table = Table(spark, config.path("gold", "customer")).read()
    assert dict(table.dtypes)["ingestion_date"] == "string"
    assert {(r["first_name"], r["source_system"]) for r in table.collect()} == {("ann", "erp"), ("bob", "crm")}


def test_silver_by_source_keeps_both_layouts_readable(spark, root):
    config = make(root)
    jobs.ingest(spark, config)
    jobs.bronze(spark, config)
    assert jobs.silver(spark, config, by_source=True).status == "SUCCESS"
    table = jobs.silver_table(spark, config)
    assert table.read().where("source_system = 'erp'").count() == 1
    assert table.count(partition="source_system=erp") == 1


def test_silver_without_bronze_is_a_recorded_failure(spark, root):
    config = make(root)
    assert jobs.silver(spark, config).status == "FAILED"
    assert jobs.gold(spark, config).status == "FAILED"
    with pytest.raises(NoSuchTable):
        jobs.bronze_union(spark, config, missing="error")


def test_quality_rejects_are_kept(spark, root):
    write_csv(root, "CRM", [*BASE, ("c8", "No", "Mail", "", "333", "2024-01-03")])
    config = make(root)
    jobs.ingest(spark, config)
    jobs.bronze(spark, config)
    jobs.silver(spark, config)
    assert Table(spark, config.path("silver_rejected")).count() == 1
    assert Table(spark, config.path("system", "dq")).read().count() == 1


def test_conservation_on_random_rows(spark):
    rng = random.Random(3)
    rows = [(str(i), rng.choice(["a", "b", None]), rng.choice(["1", "2"]), rng.randrange(4)) for i in range(200)]
    df = spark.createDataFrame(rows, "customer_id string, email string, phone string, updated_ts int")
    out = jobs.split_bronze(df, make("/x").sources[0])
    counts = {r["bronze_type"]: r["n"] for r in out.groupBy("bronze_type").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 200
    assert counts["MAIN"] == len({(e, p) for _, e, p, _ in rows})


def test_medallion_on_the_test_tables(spark, sf_dir, tmp_path):
    config = catalog.medallion_config(spark, sf_dir, str(tmp_path))
    runs = jobs.run_all(spark, config)
    assert [r.status for r in runs] == ["SUCCESS"] * 4
    rerun = jobs.run_all(spark, config)
    assert {o.load_type for o in rerun[1].outcomes} == {"NO_NEW"}
