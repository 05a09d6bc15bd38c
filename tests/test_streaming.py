import datetime

from pyspark.sql import functions as F

from keelson.config import config_from
from keelson.plans import jobs
from keelson.sources.readers import read_stream
from keelson.sources.store import Table
from keelson.streaming import dedupe as streaming


def rows(*items):
    return [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)) for k, m in items]


def run(spark, tmp_path, bounded=False):
    schema = "email string, ingestion_ts timestamp"
    src = read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    q = streaming.write_to_store(streaming.first_arrivals(src, ["email"], bounded=bounded), str(tmp_path / "out"), str(tmp_path / "cp"), "q", available_now=True)
    q.awaitTermination()
    return sorted(r["email"] for r in Table(spark, str(tmp_path / "out")).read().collect())


def add(spark, tmp_path, *items):
    spark.createDataFrame(rows(*items), "email string, ingestion_ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_first_arrival_wins_late_rows_drop_restart_continues(spark, tmp_path):
    add(spark, tmp_path, ("a", 0), ("a", 1), ("b", 60))
    assert run(spark, tmp_path) == ["a", "b"]
    add(spark, tmp_path, ("a", 61), ("c", 62), ("late", 1))
    assert run(spark, tmp_path) == ["a", "b", "c"], "known keys stay known after a restart; late rows are dropped"


def test_bounded_state_forgets_old_keys(spark, tmp_path):
    add(spark, tmp_path, ("a", 0), ("b", 300))
    assert run(spark, tmp_path, bounded=True) == ["a", "b"]
    add(spark, tmp_path, ("x", 301))
    run(spark, tmp_path, bounded=True)
    add(spark, tmp_path, ("a", 302))
    assert run(spark, tmp_path, bounded=True).count("a") == 2


def test_stream_keys_equal_batch_keys(spark, tmp_path):
    (tmp_path / "CRM.csv").write_text("customer_id,email,phone,created_ts\n" + "".join(f"{i},e{i % 7}@x.com,{i % 3},2024-01-01\n" for i in range(40)))
    fields = [{"name": "customer_id", "type": "string", "natural_key": True}, {"name": "email", "type": "string"}, {"name": "phone", "type": "string"}]
    config = config_from({"root": str(tmp_path / "lake"), "sources": [{"name": "CRM", "path": str(tmp_path / "CRM.csv"), "dedupe_keys": ["email", "phone"]}], "schemas": {"crm_customer": {"fields": fields}}})
    jobs.ingest(spark, config)
    jobs.bronze(spark, config)
    queries = streaming.dedupe_all(spark, config, available_now=True)
    streaming.wait(spark, queries, available_now=True)
    key = lambda df: {(r["email"], r["phone"]) for r in df.collect()}
    assert key(Table(spark, config.path("bronze_stream", "CRM", "customer")).read()) == key(jobs.bronze_side(spark, config, config.sources[0]))


def lake(spark, tmp_path, n=40):
    (tmp_path / "CRM.csv").write_text("customer_id,email,phone,created_ts\n" + "".join(f"{i},e{i}@x.com,{i},2024-01-01\n" for i in range(n)))
    fields = [{"name": "customer_id", "type": "string", "natural_key": True}, {"name": "email", "type": "string"}, {"name": "phone", "type": "string"}]
    return config_from({"root": str(tmp_path / "lake"), "sources": [{"name": "CRM", "path": str(tmp_path / "CRM.csv"), "dedupe_keys": ["email", "phone"]}], "schemas": {"crm_customer": {"fields": fields}}})


def streamed(spark, config):
    streaming.wait(spark, streaming.dedupe_all(spark, config, available_now=True), available_now=True)
    return Table(spark, config.path("bronze_stream", "CRM", "customer")).read()


def test_only_committed_files_are_streamed(spark, tmp_path):
    config = lake(spark, tmp_path)
    jobs.ingest(spark, config)
    raw = Table(spark, config.path("raw", "CRM", "customer"))
    lost = raw.read().withColumn("email", F.concat(F.lit("lost"), "email"))
    raw._write(lost, ["ingestion_date"])  # a writer that failed before its commit
    assert streamed(spark, config).count() == 40
    raw._write(lost, ["ingestion_date"])
    raw.append(raw.read().limit(5).withColumn("email", F.concat(F.lit("new"), "email")), ["ingestion_date"])
    got = streamed(spark, config)
    assert got.count() == 45 and got.where("email like 'lost%'").count() == 0


def test_commits_past_the_stream_log_s_compaction_are_streamed_once(spark, tmp_path):
    config = lake(spark, tmp_path, 3)
    jobs.ingest(spark, config)
    raw = Table(spark, config.path("raw", "CRM", "customer"))
    row = raw.read().limit(1)
    for k in range(13):
        if k == 6:
            assert streamed(spark, config).count() == 3 + 6
        raw.append(row.withColumn("email", F.lit(f"k{k}")), ["ingestion_date"])
    raw.compact()
    raw.append(row.withColumn("email", F.lit("last")), ["ingestion_date"])
    got = [r["email"] for r in streamed(spark, config).collect()]
    assert sorted(got) == sorted([f"e{i}@x.com" for i in range(3)] + [f"k{k}" for k in range(13)] + ["last"])
    assert sorted(r["email"] for r in raw.read().collect()) == sorted(got), "batch readers don't follow the stream's log"
