"""The registered queries and, where SQL can say the same, their oracle SQL."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.config import config_from, source_from
from keelson.functions import quality
from keelson.functions import standardize as S
from keelson.operators import dedupe, matching, setops, upsert
from keelson.operators.entities import DRAFT_CUSTOMER, RULES, EntityRule
from keelson.operators.survivors import with_survivor
from keelson.plans import fixtures as fx
from keelson.plans import jobs
from keelson.schema import Field, Schema
from keelson.sources.files import Folder
from keelson.sources.readers import read_csv, read_source, read_stream
from keelson.sources.store import NoSuchTable, Table
from keelson.streaming import dedupe as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the driver's JVM ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        base = "/tmp/checkpoints"
    folder = Folder(spark, f"{base}/catalog-{label}-{uuid.uuid4().hex}")
    folder.fs.mkdirs(folder.path())
    folder.fs.deleteOnExit(folder.path())
    return folder.uri


# ---------------------------------------------------------------- keyed dedupe

EVENT_KEYS = ["user_id", "event_type"]


@query("""
SELECT event_id, ts, user_id, event_type, value, props
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def dedupe_main(spark, sf_dir):
    return dedupe.main_rows(table(spark, sf_dir, "events"), EVENT_KEYS, dedupe.newest_first("ts", "event_id"))


@query("""
SELECT event_id, ts, user_id, event_type, value, props
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn > 1""")
def dedupe_conflicted(spark, sf_dir):
    marked = with_survivor(table(spark, sf_dir, "events"), EVENT_KEYS, dedupe.newest_first("ts", "event_id"))
    return marked.where(~F.col("__survivor")).drop("__survivor", "__main")


@query("""
SELECT 'user_id, event_type' AS keys, CASE WHEN rn = 1 THEN 'MAIN' ELSE 'CONFLICTED' END AS bronze_type, count(*) AS n
FROM (SELECT row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) GROUP BY ALL
UNION ALL
SELECT 'user_id', CASE WHEN rn = 1 THEN 'MAIN' ELSE 'CONFLICTED' END, count(*)
FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) GROUP BY ALL""")
def dedupe_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    parts = []
    for keys in (EVENT_KEYS, ["user_id"]):
        labelled = dedupe.split_labelled(events, keys, dedupe.newest_first("ts", "event_id"))
        parts.append(labelled.groupBy("bronze_type").agg(F.count("*").alias("n")).select(F.lit(", ".join(keys)).alias("keys"), "bronze_type", "n"))
    return parts[0].unionByName(parts[1])


@query("""
SELECT coalesce(user_id, -1) AS user_id, event_type, bronze_type, count(*) AS n FROM (
  SELECT k AS user_id, event_type, CASE WHEN row_number() OVER (PARTITION BY k, event_type ORDER BY ts DESC, event_id) = 1 THEN 'MAIN' ELSE 'CONFLICTED' END AS bronze_type
  FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS k FROM events)) GROUP BY ALL""")
def dedupe_null_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")))
    source = source_from({"name": "CRM", "dedupe_keys": EVENT_KEYS})
    return jobs.split_bronze(events.withColumn("updated_ts", F.col("ts")).withColumn("customer_id", F.col("event_id")), source).groupBy(F.coalesce("user_id", F.lit(-1)).alias("user_id"), "event_type", "bronze_type").agg(F.count("*").alias("n"))


@query("""
WITH fresh AS (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00')
SELECT event_id, user_id, event_type, ts, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1 THEN 'MAIN' ELSE 'CONFLICTED' END AS bronze_type FROM fresh""")
def incremental_batch(spark, sf_dir):
    from datetime import UTC, datetime

    fresh = jobs.changed_since(table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", datetime(2024, 1, 20, tzinfo=UTC))
    return dedupe.split_labelled(fresh, EVENT_KEYS, dedupe.newest_first("ts", "event_id")).select("event_id", "user_id", "event_type", "ts", "bronze_type")


@query("SELECT event_type AS entity, max(ts) AS last_ingestion_ts, count(*) AS n FROM events GROUP BY event_type")
def checkpoint_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity")).agg(F.max("ts").alias("last_ingestion_ts"), F.count("*").alias("n"))


@query("""
SELECT user_id, event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, event_id % 4 ORDER BY ts DESC, event_id) AS b FROM events) WHERE b = 1)) WHERE rn = 1""")
def global_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("batch", F.col("event_id") % 4)
    batches = dedupe.main_rows(events, [*EVENT_KEYS, "batch"], dedupe.newest_first("ts", "event_id")).drop("batch")
    source = source_from({"name": "CRM", "dedupe_keys": EVENT_KEYS})
    return jobs.global_latest(batches, source, "ts").select("user_id", "event_type", "event_id", "ts")


# ---------------------------------------------------------------- streaming


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    work = scratch(spark, "stream")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{work}/in")
    stream = read_stream(spark, f"{work}/in", events.schema, maxFilesPerTrigger="2")
    q = streaming.write_to_store(streaming.first_arrivals(stream, EVENT_KEYS, "ts", "60 days"), f"{work}/table", f"{work}/checkpoint", "events_main", available_now=True)
    q.awaitTermination()
    return Table(spark, f"{work}/table").read().select(*EVENT_KEYS)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_bounded(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    work = scratch(spark, "stream")
    events.write.parquet(f"{work}/in")
    stream = read_stream(spark, f"{work}/in", events.schema)
    q = streaming.write_to_store(streaming.first_arrivals(stream, EVENT_KEYS, "ts", "60 days", bounded=True), f"{work}/table", f"{work}/checkpoint", "events_bounded", available_now=True)
    q.awaitTermination()
    return Table(spark, f"{work}/table").read().select(*EVENT_KEYS)


# ---------------------------------------------------------------- upsert and store

DELTA_SQL = """
SELECT o_orderkey, o_custkey, 'U' AS o_orderstatus, o_totalprice + 100 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0
UNION ALL
SELECT o_orderkey + 1000000000, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 11 = 0"""
MERGED_SQL = f"""
WITH delta AS ({DELTA_SQL})
SELECT coalesce(d.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(d.o_custkey, t.o_custkey) AS o_custkey, coalesce(d.o_orderstatus, t.o_orderstatus) AS o_orderstatus,
       coalesce(d.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(t.o_orderdate, d.o_orderdate) AS o_orderdate, coalesce(d.o_orderpriority, t.o_orderpriority) AS o_orderpriority"""


def _orders_delta(orders: DataFrame) -> DataFrame:
    changed = orders.where("o_orderkey % 7 = 0").withColumns({"o_orderstatus": F.lit("U"), "o_totalprice": F.col("o_totalprice") + 100})
    added = orders.where("o_orderkey % 11 = 0").withColumns({"o_orderkey": F.col("o_orderkey") + 1_000_000_000, "o_orderstatus": F.lit("N")})
    return changed.unionByName(added)


@query(MERGED_SQL + """, CASE WHEN d.o_orderkey IS NULL THEN 'kept' WHEN t.o_orderkey IS NULL THEN 'inserted' ELSE 'updated' END AS merge_action
FROM orders t FULL OUTER JOIN delta d ON t.o_orderkey = d.o_orderkey""")
def upsert_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return upsert.merge(orders, _orders_delta(orders), ["o_orderkey"], preserve=["o_orderdate"], label="merge_action")


@query(MERGED_SQL + " FROM orders t FULL OUTER JOIN delta d ON t.o_orderkey = d.o_orderkey")
def store_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    target = Table(spark, scratch(spark, "upsert"))
    target.overwrite(orders)
    target.upsert(_orders_delta(orders), ["o_orderkey"], preserve=["o_orderdate"])
    return target.read()


def _versions(spark: SparkSession, sf_dir: str) -> Table:
    """v0: even orders; v1: + odd ones below 1000; v2: only open orders; v3: + a column."""
    orders = table(spark, sf_dir, "orders")
    t = Table(spark, scratch(spark, "versions"))
    t.overwrite(orders.where("o_orderkey % 2 = 0"), ["o_orderstatus"])
    t.append(orders.where("o_orderkey % 2 = 1 AND o_orderkey < 1000"))
    t.overwrite(orders.where("o_orderstatus = 'O'"))
    t.append(orders.where("o_orderstatus = 'F' AND o_orderkey % 5 = 0").withColumn("flag", F.lit("late")))
    return t


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey < 1000")
def time_travel(spark, sf_dir):
    return _versions(spark, sf_dir).read(version=1)


@query("""
SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'late' END AS flag FROM orders
WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderkey % 5 = 0)""")
def schema_evolution(spark, sf_dir):
    return _versions(spark, sf_dir).read()


@query("""
SELECT CAST(0 AS BIGINT) AS version, 'overwrite' AS operation, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS rows_added, CAST(0 AS BIGINT) AS rows_removed
UNION ALL SELECT 1, 'append', (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey < 1000), 0
UNION ALL SELECT 2, 'overwrite', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey < 1000)
UNION ALL SELECT 3, 'append', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0), 0""")
def table_history(spark, sf_dir):
    return _versions(spark, sf_dir).history().select("version", "operation", "rows_added", "rows_removed")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def partition_pruned(spark, sf_dir):
    t = Table(spark, scratch(spark, "partitioned"))
    t.overwrite(table(spark, sf_dir, "orders"), ["o_orderstatus"])
    return t.read().where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- sources


@query("SELECT CAST(p_partkey AS STRING) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS STRING) AS p_size FROM part")
def csv_scan(spark, sf_dir):
    uri = scratch(spark, "csv")
    table(spark, sf_dir, "part").drop("p_retailprice").write.csv(f"{uri}/part", header=True)
    return read_csv(spark, f"{uri}/part")


@query("SELECT p_name, p_size, p_retailprice FROM part")
def csv_scan_inferred(spark, sf_dir):
    uri = scratch(spark, "csv")
    table(spark, sf_dir, "part").write.csv(f"{uri}/part", header=True, sep=";")
    return read_csv(spark, f"{uri}/part", ";", infer=True).select("p_name", "p_size", "p_retailprice")


@query("""
SELECT format, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM part, (SELECT unnest(['json', 'orc', 'parquet']) AS format) GROUP BY format""")
def file_scans(spark, sf_dir):
    uri, parts = scratch(spark, "files"), []
    for kind in ("json", "orc", "parquet"):
        table(spark, sf_dir, "part").write.format(kind).save(f"{uri}/{kind}")
        config = config_from({"root": uri, "sources": [{"name": kind, "path": f"{uri}/{kind}"}], "connections": {kind: {"type": "file", "format": kind}}})
        df = read_source(spark, config.sources[0], config)
        parts.append(df.agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total")).select(F.lit(kind).alias("format"), "n", "total"))
    return setops.union_by_name(*parts)


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def _sql_state(error: Py4JJavaError) -> str | None:
    try:
        return error.java_exception.getSQLState()
    except Py4JError:  # not an SQLException
        return None


def derby_database(spark: SparkSession, df: DataFrame, name: str) -> str:
    """The JDBC URL of a new Derby database with ``df`` as table ``name``, to be read by any task.

    An embedded database lives in one JVM, so that executors don't see the driver's.
    The driver fills it, one row after another, and ships it as a jar, from which
    Derby opens it for reading in every JVM.  The jar is kept until the driver ends."""
    own = f"keelson{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext._temp_dir}/{own}"
    url = f"jdbc:derby:directory:{folder}/{own}"
    # no rows: Spark makes the table, on the driver
    spark.createDataFrame([], df.schema).write.format("jdbc").options(url=f"{url};create=true", dbtable=name, driver=DERBY).save()
    manager = spark._jvm.java.sql.DriverManager
    connection = manager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        columns = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
        insert = connection.prepareStatement(f"INSERT INTO {name} ({columns}) VALUES ({', '.join('?' * len(df.columns))})")
        for row in df.toLocalIterator():
            for i, value in enumerate(row, 1):
                insert.setObject(i, value)
            insert.executeUpdate()
        connection.commit()
    finally:
        connection.close()
    try:
        manager.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as error:
        if _sql_state(error) != "08006":  # how Derby says that it has shut down
            raise
    jar = shutil.make_archive(folder, "zip", folder)
    shutil.rmtree(folder)
    os.rename(jar, f"{folder}.jar")
    spark.sql(f"ADD JAR '{folder}.jar'")
    return f"jdbc:derby:classpath:{own}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jdbc_scan(spark, sf_dir):
    url = derby_database(spark, table(spark, sf_dir, "nation"), "nation")
    config = config_from({"root": "/", "sources": [{"name": "CRM", "entity": "nation"}], "connections": {"crm": {"type": "jdbc", "url": url, "driver": DERBY}}})
    df = read_source(spark, config.sources[0], config)
    return df.toDF(*[c.lower() for c in df.columns])


@query("SELECT range AS id FROM range(10)")
def range_source(spark, sf_dir):
    return spark.range(10)


# ---------------------------------------------------------------- standardisation

CUSTOMER_SCHEMA = Schema("crm_customer", (Field("customer_id", "long", True), Field("email", "string"), Field("balance", "double"), Field("opened", "date"), Field("seen", "timestamp")))


@query("""
SELECT c_custkey AS customer_id, lower(c_mktsegment) || '@x.example.com' AS email,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS balance,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(c_custkey % 28 AS INT) END AS opened,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE TIMESTAMP '2024-03-01 00:00:00' + to_minutes(CAST(c_custkey AS INT)) END AS seen, c_name AS "note"
FROM customer""")
def normalize_columns(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")).cast("string")
    messy = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" ")).alias(" Customer_ID "),
        F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit("@X.example.com ")).alias("EMAIL"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("Balance"),
        F.when(F.col("c_custkey") % 9 == 0, F.lit("not a date")).otherwise(day).alias("opened"),
        F.when(F.col("c_custkey") % 8 == 0, F.lit("yesterday")).otherwise(F.date_format(F.timestamp_seconds(F.lit(1709251200) + 60 * F.col("c_custkey")), "yyyy-MM-dd HH:mm:ss")).alias("Seen "),
        F.col("c_name").alias("Note"),
    )
    return S.standardize(S.normalize_headers(messy), CUSTOMER_SCHEMA)


@query("SELECT c_custkey AS customer_id, c_name AS email, c_mktsegment AS phone, c_acctbal FROM customer")
def synonym_rename(spark, sf_dir):
    return S.rename_synonyms(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CustomerID"), F.col("c_name").alias("SF_Email"), F.col("c_mktsegment").alias("contact_phone"), "c_acctbal"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date FROM orders""")
def date_repair(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.repair_date(text).alias("order_date"))


@query("""
SELECT c_custkey, coalesce(TRY_CAST(raw AS BIGINT), -1) AS as_long, TRY_CAST(raw AS DOUBLE) AS as_double
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'x' || CAST(c_custkey AS STRING) ELSE CAST(c_custkey AS STRING) END AS raw FROM customer)""")
def typed_cast(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(S.typed(raw, "long"), F.lit(-1)).alias("as_long"), S.typed(raw, "double").alias("as_double"))


@query(f"""
WITH people AS ({fx.oracle(fx.PEOPLE)})
SELECT customer_id, regexp_replace(phone, '[^0-9]', '', 'g') AS norm_phone, substr(regexp_replace(phone, '[^0-9]', '', 'g'), 1, 5) AS phone_prefix, split_part(email, '@', -1) AS email_domain FROM people""")
def phone_and_domain(spark, sf_dir):
    people = fx.relation(spark, sf_dir, fx.PEOPLE)
    return people.select("customer_id", S.digits(F.col("phone")).alias("norm_phone"), S.prefix(S.digits(F.col("phone")), 5).alias("phone_prefix"), S.email_domain(F.col("email")).alias("email_domain"))


def soundex_sql(x: str) -> str:
    first = f"translate(substr(upper({x}),1,1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','01230127022455012623017202')"
    rest = f"translate(regexp_replace(regexp_replace(substr(upper({x}),2),'[HW]','','g'),'[^A-Z]','0','g'),'ABCDEFGIJKLMNOPQRSTUVXYZ','012301202245501262301202')"
    code = f"({first}||{rest})"
    for d in "123456":
        code = f"regexp_replace({code},'{d}+','{d}','g')"
    return f"CASE WHEN regexp_matches({x},'^[A-Za-z]') THEN substr(substr(upper({x}),1,1)||replace(substr({code},2),'0','')||'000',1,4) ELSE {x} END"


@query(f"""
SELECT sound, count(*) AS n FROM (SELECT {soundex_sql("p_name")} AS sound FROM part UNION ALL SELECT {soundex_sql("s_name")} FROM supplier) GROUP BY sound""")
def soundex_block(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("x")).union(table(spark, sf_dir, "supplier").select("s_name"))
    return names.groupBy(F.soundex("x").alias("sound")).agg(F.count("*").alias("n"))


PRIORITY_SQL = "CASE lower(source_system) WHEN 'salesforce' THEN 1 WHEN 'erp' THEN 2 WHEN 'crm' THEN 3 WHEN 'sap' THEN 4 ELSE 5 END"


@query(f"""
SELECT lower(source_system) AS source_system, {PRIORITY_SQL} AS priority, CAST(5 AS INTEGER) AS compat_priority, count(*) AS n FROM ({fx.oracle(fx.CONTACTS)}) GROUP BY ALL""")
def source_priority(spark, sf_dir):
    lowered = fx.relation(spark, sf_dir, fx.CONTACTS).withColumn("source_system", F.lower("source_system"))
    ranked = lowered.select("source_system", S.source_rank(F.col("source_system")).alias("priority"), S.source_rank(F.col("source_system"), strict_compat=True).alias("compat_priority"))
    return ranked.groupBy("source_system", "priority", "compat_priority").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- quality

BROKEN = """SELECT customer_id, CASE WHEN customer_id % 7 = 0 THEN NULL ELSE email END AS email, CASE WHEN customer_id % 5 = 0 THEN NULL ELSE phone END AS phone FROM ({people})"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.relation(spark, sf_dir, BROKEN.replace("{people}", fx.PEOPLE))


@query(fx.oracle(BROKEN.replace("{people}", fx.PEOPLE)) + " WHERE customer_id % 7 <> 0 AND customer_id % 5 <> 0")
def quality_filter(spark, sf_dir):
    return quality.split(_broken(spark, sf_dir), quality.present(RULES["customer"].required))[0]


@query(fx.oracle(BROKEN.replace("{people}", fx.PEOPLE)) + " WHERE customer_id % 7 = 0 OR customer_id % 5 = 0")
def quality_rejects(spark, sf_dir):
    return quality.split(_broken(spark, sf_dir), quality.present(RULES["customer"].required))[1]


FORMATS = """SELECT customer_id, CASE customer_id % 4 WHEN 0 THEN email WHEN 1 THEN replace(email, '@', '') WHEN 2 THEN email || '@' ELSE NULL END AS email,
CASE customer_id % 3 WHEN 0 THEN '+1 555-0100' WHEN 1 THEN '555' ELSE phone END AS phone FROM ({people})"""


@query(f"""
SELECT customer_id, coalesce(regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$'), false) AS email_ok, coalesce(regexp_matches(phone, '^[0-9+\\- ]{{7,20}}$'), false) AS phone_ok
FROM ({fx.oracle(FORMATS.replace("{people}", fx.PEOPLE))})""")
def email_phone_format(spark, sf_dir):
    rows = fx.relation(spark, sf_dir, FORMATS.replace("{people}", fx.PEOPLE))
    return rows.select("customer_id", quality.valid_email(F.col("email")).alias("email_ok"), quality.valid_phone(F.col("phone")).alias("phone_ok"))


# ---------------------------------------------------------------- survivorship and gold

RELATIONS = {"customer": fx.PEOPLE, "account": fx.ACCOUNTS, "address": fx.ADDRESSES, "transactions": fx.TRANSACTIONS, "contacts": fx.CONTACTS}
IDS = {"customer": "customer_id", "account": "account_id", "address": "address_id", "transactions": "transaction_id", "contacts": "contact_id"}
BLOCK_SQL = {
    "customer": f"date_of_birth, substr(regexp_replace(phone, '[^0-9]', '', 'g'), 1, 5), {soundex_sql('first_name')}, {soundex_sql('last_name')}",
    "account": f"{soundex_sql('account_name')}, account_group",
    "address": f"postal_code, {soundex_sql('city')}, state",
    "transactions": "amount, currency, transaction_date",
    "contacts": soundex_sql("contact_value"),
}


def _order_sql(rule: EntityRule, columns: list[str]) -> str:
    rest = [c for c in dict.fromkeys([rule.id_column, *rule.identity, *rule.compared]) if c in columns and c not in ("source_system", "created_ts")]
    return ", ".join([PRIORITY_SQL, "created_ts DESC NULLS LAST", *(f"{c} NULLS LAST" for c in rest)])


COLUMNS = {
    "customer": "customer_id first_name last_name date_of_birth phone email address_line1 address_line2 city state postal_code source_system created_ts".split(),
    "account": "account_id account_name account_group account_owner account_code source_system created_ts".split(),
    "address": "address_id postal_code city state address_line1 address_line2 source_system created_ts".split(),
    "transactions": "transaction_id customer_id account_id amount currency transaction_date transaction_type source_system created_ts".split(),
    "contacts": "contact_id contact_value contact_type source_system created_ts".split(),
}


def _survivorship(entity: str) -> None:
    rule = RULES[entity]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = matching.blocked(fx.relation(spark, sf_dir, RELATIONS[entity]), rule)
        return found.select(IDS[entity], "source_system", "created_ts", F.col("__survivor").alias("survivor"))

    run.__name__ = f"survivorship_{entity}"
    query(f"""
SELECT {IDS[entity]}, source_system, created_ts, row_number() OVER (PARTITION BY {BLOCK_SQL[entity]} ORDER BY {_order_sql(rule, COLUMNS[entity])}) = 1 AS survivor
FROM ({fx.oracle(RELATIONS[entity])})""")(run)


def _gold(entity: str) -> None:
    rule = RULES[entity]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching.golden(fx.relation(spark, sf_dir, RELATIONS[entity]), rule)

    run.__name__ = f"gold_{entity}"
    query(f"""
SELECT {", ".join(rule.gold_columns or COLUMNS[entity])} FROM (
  SELECT *, row_number() OVER (PARTITION BY {", ".join(rule.identity)} ORDER BY {_order_sql(rule, COLUMNS[entity])}) AS rn FROM ({fx.oracle(RELATIONS[entity])})) WHERE rn = 1""")(run)


for _entity in RULES:
    _survivorship(_entity)
    _gold(_entity)


def _levenshtein_score(pairs):
    a, b = pairs[0]
    return F.round(F.lit(100.0) * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))), 6)


@query(f"""
WITH accounts AS ({fx.oracle(fx.ACCOUNTS)}),
keyed AS (SELECT *, {soundex_sql("account_name")} AS b1 FROM accounts),
ranked AS (SELECT *, row_number() OVER w AS rn, first_value(account_name) OVER w AS main_name FROM keyed
           WINDOW w AS (PARTITION BY b1, account_group ORDER BY {_order_sql(RULES["account"], COLUMNS["account"])})),
scored AS (SELECT account_id, rn, CASE WHEN rn > 1 THEN round(100.0::DOUBLE * (1 - levenshtein(account_name, main_name)::DOUBLE / greatest(length(account_name), length(main_name))), 6) END AS similarity FROM ranked)
SELECT account_id, similarity, CASE WHEN rn = 1 THEN 'MAIN' WHEN similarity >= 80 THEN 'CONFLICTED' ELSE 'MAIN' END AS silver_type FROM scored""")
def resolve_threshold(spark, sf_dir):
    found = matching.resolve(fx.relation(spark, sf_dir, fx.ACCOUNTS), RULES["account"], score=_levenshtein_score)
    return found.select("account_id", "similarity", "silver_type")


def _longest_block(x: str, y: str) -> str:
    """SQL for the longest common block of two strings, the first of equally long ones: length * 10^6 + (999 - its place in x) * 10^3 + 999 - its place in y."""
    common = f"len(list_filter(range(1, least(len({x}) - i, len({y}) - j) + 2), lambda q: substr({x}, i, q) = substr({y}, j, q)))"
    return f"list_max(flatten(list_transform(range(1, len({x}) + 1), lambda i: list_transform(range(1, len({y}) + 1), lambda j: {common} * 1000000 + (999 - i) * 1000 + 999 - j))))"


def ratios_sql(given: str) -> str:
    """CTEs ending in ratios (a, b, r): the share of matching blocks of the distinct unequal pairs (a, b) of ``given``,
    found block by block to the left and right of the longest one.  Goes behind WITH RECURSIVE."""
    return f"""
pairs AS (SELECT DISTINCT a, b FROM ({given}) WHERE a <> b),
blocks AS (SELECT a, b, a AS x, b AS y, {_longest_block("a", "b")} AS m FROM pairs
  UNION ALL
  SELECT a, b, x, y, {_longest_block("x", "y")} FROM (
    SELECT a, b, unnest([substr(x, 1, 998 - m // 1000 % 1000), substr(x, 999 - m // 1000 % 1000 + m // 1000000)]) AS x,
           unnest([substr(y, 1, 998 - m % 1000), substr(y, 999 - m % 1000 + m // 1000000)]) AS y
    FROM blocks WHERE m >= 1000000) WHERE x <> '' AND y <> ''),
ratios AS (SELECT a, b, 2.0::DOUBLE * sum(m // 1000000) / (len(a) + len(b)) AS r FROM blocks GROUP BY a, b)"""


def _resolved_sql(entity: str, threshold: str = "80", as_text: bool = False) -> str:
    """SELECT of all columns, similarity and silver_type of an entity's rows, by the default score."""
    rule, columns = RULES[entity], COLUMNS[entity]
    listed = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if as_text and c != "created_ts" else c for c in columns)
    compared = [c for c in rule.compared if c in columns]
    text = lambda c: f"lower(CASE WHEN CAST({c} AS VARCHAR) NOT IN ('', '0', '0.0') THEN CAST({c} AS VARCHAR) END)"
    first = ", ".join(f"first_value({c}) OVER w AS main_{c}" for c in compared)
    given = " UNION ALL ".join(f"SELECT {text(c)} AS a, {text('main_' + c)} AS b FROM ranked WHERE rn > 1" for c in compared)
    one = lambda c: f"CASE WHEN {text(c)} = {text('main_' + c)} THEN 1.0::DOUBLE ELSE coalesce((SELECT r FROM ratios WHERE a = {text(c)} AND b = {text('main_' + c)}), 0.0::DOUBLE) END"
    score = f"({' + '.join(map(one, compared))}) * {100.0 / len(compared)!r}::DOUBLE"
    return f"""
WITH RECURSIVE ranked AS (SELECT *, row_number() OVER w AS rn, {first} FROM (SELECT {listed} FROM ({fx.oracle(RELATIONS[entity])}))
  WINDOW w AS (PARTITION BY {BLOCK_SQL[entity]} ORDER BY {_order_sql(rule, columns)})),
{ratios_sql(given)},
scored AS (SELECT *, CASE WHEN rn > 1 THEN {score} END AS score FROM ranked)
SELECT {", ".join(columns)}, round(score, 6) AS similarity, CASE WHEN score >= {threshold} THEN 'CONFLICTED' ELSE 'MAIN' END AS silver_type FROM scored"""


@query(f"SELECT account_id, similarity, silver_type FROM ({_resolved_sql('account')})")
def similarity_ratio(spark, sf_dir):
    found = matching.resolve(fx.relation(spark, sf_dir, fx.ACCOUNTS), RULES["account"])
    return found.select("account_id", F.round("similarity", 6).alias("similarity"), "silver_type")


THRESHOLDS = {"Salesforce": 95.0, "ERP": 30.0, "CRM": 60.0}


@query(f"""SELECT account_id, similarity, silver_type FROM ({
    _resolved_sql("account", "CASE source_system " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + " ELSE 80 END")
})""")
def threshold_by_source(spark, sf_dir):
    config = config_from({"root": "/", "sources": [{"name": k, "entity": "account", "similarity_threshold": v} for k, v in THRESHOLDS.items()]})
    found = matching.resolve(fx.relation(spark, sf_dir, fx.ACCOUNTS), RULES["account"], config)
    return found.select("account_id", F.round("similarity", 6).alias("similarity"), "silver_type")


@query(f"""
SELECT customer_id, row_number() OVER (PARTITION BY split_part(email, '@', -1), substr(phone, 1, 3), {soundex_sql("first_name")}
  ORDER BY {_order_sql(DRAFT_CUSTOMER, COLUMNS["customer"])}) = 1 AS survivor FROM ({fx.oracle(fx.PEOPLE)})""")
def survivorship_draft(spark, sf_dir):
    return matching.blocked(fx.relation(spark, sf_dir, fx.PEOPLE), DRAFT_CUSTOMER).select("customer_id", F.col("__survivor").alias("survivor"))


_DRAFT_PEOPLE = f"SELECT * REPLACE (translate(phone, '()', '') AS phone) FROM ({fx.oracle(fx.PEOPLE)})"


@query(f"""
WITH RECURSIVE ranked AS (SELECT *, row_number() OVER w AS rn, first_value(first_name) OVER w AS main_name, first_value(email) OVER w AS main_email, first_value(phone) OVER w AS main_phone
  FROM ({_DRAFT_PEOPLE}) WHERE regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$') AND regexp_matches(phone, '^[0-9+\\- ]{{7,20}}$')
  WINDOW w AS (PARTITION BY split_part(email, '@', -1), substr(phone, 1, 3), {soundex_sql("first_name")} ORDER BY {_order_sql(DRAFT_CUSTOMER, COLUMNS["customer"])})),
{ratios_sql("SELECT first_name AS a, main_name AS b FROM ranked UNION ALL SELECT email, main_email FROM ranked UNION ALL SELECT phone, main_phone FROM ranked")},
scored AS (SELECT customer_id, rn, {" + ".join(f"CASE WHEN {c} = {m} THEN 30.0::DOUBLE ELSE coalesce((SELECT r FROM ratios WHERE a = {c} AND b = {m}), 0.0::DOUBLE) * 30.0::DOUBLE END" for c, m in (("first_name", "main_name"), ("email", "main_email"), ("phone", "main_phone")))} AS score FROM ranked)
SELECT customer_id, CASE WHEN rn > 1 THEN round(score, 6) END AS similarity, CASE WHEN rn > 1 AND score >= 80 THEN 'CONFLICTED' ELSE 'MAIN' END AS silver_type FROM scored""")
def similarity_weighted(spark, sf_dir):
    found = matching.draft_silver(fx.relation(spark, sf_dir, fx.PEOPLE).withColumn("phone", F.translate("phone", "()", "")))
    return found.select("customer_id", F.round("similarity", 6).alias("similarity"), "silver_type")


@query(" UNION ALL ".join(f"SELECT '{e}' AS entity, silver_type, count(*) AS n FROM ({_resolved_sql(e, as_text=True)}) GROUP BY silver_type" for e in RELATIONS))
def silver_all_entities(spark, sf_dir):
    parts = [fx.relation(spark, sf_dir, RELATIONS[e]).withColumn("entity", F.lit(e)) for e in RELATIONS]
    strings = [p.select(*[F.col(c).cast("string") if c != "created_ts" else F.col(c) for c in p.columns]) for p in parts]
    return matching.silver(setops.union_by_name(*strings)).groupBy("entity", "silver_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- set operations and audit


@query("""
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier""")
def union_missing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS nationkey", "c_mktsegment AS segment")
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nationkey", "s_suppkey AS id", "s_name AS name")
    return setops.union_by_name(c, s)


@query("""
SELECT c_custkey AS id, c_name AS name, 'crm' AS source_system, 'customer' AS entity FROM customer
UNION ALL SELECT s_suppkey, s_name, 'sap', 'customer' FROM supplier""")
def union_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "'X' AS source_system")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    return setops.union_by_name(setops.labelled(c, source_system="CRM", entity="Customer"), setops.labelled(s, source_system="SAP", entity="Customer"))


@query(f"""
WITH people AS ({fx.oracle(fx.PEOPLE)}),
ranked AS (SELECT source_system, row_number() OVER (PARTITION BY source_system, email, phone ORDER BY created_ts DESC, customer_id) AS rn FROM people),
each AS (SELECT source_system AS target, count(*) AS records_incoming, count(*) FILTER (rn = 1) AS records_main, count(*) FILTER (rn > 1) AS records_conflicted FROM ranked GROUP BY source_system)
SELECT * FROM each UNION ALL SELECT 'JOB_SUMMARY', CAST(sum(records_incoming) AS BIGINT), CAST(sum(records_main) AS BIGINT), CAST(sum(records_conflicted) AS BIGINT) FROM each""")
def audit_summary(spark, sf_dir):
    people = fx.relation(spark, sf_dir, fx.PEOPLE)
    labelled = dedupe.split_labelled(people, ["source_system", "email", "phone"], dedupe.newest_first("created_ts", "customer_id"))
    main = F.col("bronze_type") == "MAIN"
    counts = (F.count("*").alias("records_incoming"), F.count_if(main).alias("records_main"), F.count_if(~main).alias("records_conflicted"))
    # source and total in one pass: a rollup, not a second scan
    return labelled.rollup("source_system").agg(F.grouping("source_system").alias("g"), *counts).select(F.when(F.col("g") == 1, "JOB_SUMMARY").otherwise(F.col("source_system")).alias("target"), "records_incoming", "records_main", "records_conflicted")


# ---------------------------------------------------------------- the four jobs, end to end

MEDALLION = f"""
WITH people AS ({fx.oracle(fx.PEOPLE)}),
bronze AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_system, email, phone ORDER BY customer_id NULLS LAST) AS rn FROM people) WHERE rn = 1)
SELECT customer_id, first_name, last_name, lower(source_system) AS source_system, created_ts FROM (
  SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY first_name, last_name ORDER BY {PRIORITY_SQL}, created_ts DESC NULLS LAST, customer_id) AS rn FROM bronze) WHERE rn = 1"""
MEDALLION_FIELDS = [{"name": "customer_id", "type": "long", "natural_key": True}, *({"name": c, "type": "string"} for c in ("first_name", "last_name", "email", "phone", "address_line1", "city", "state", "postal_code")), {"name": "date_of_birth", "type": "date"}, {"name": "created_ts", "type": "date"}]
SYSTEMS = ("CRM", "ERP", "Salesforce", "SAP", "Other")


def medallion_config(spark: SparkSession, sf_dir: str, root: str, broken: bool = False):
    people = fx.relation(spark, sf_dir, fx.PEOPLE).drop("address_line2")
    sources = []
    for name in SYSTEMS:
        path = f"{root}/source/{name}"
        people.where(F.col("source_system") == name).drop("source_system").withColumnRenamed("customer_id", " Cust_ID").write.csv(path, header=True)
        sources.append({"name": name, "path": path, "entity": "customer", "dedupe_keys": ["email", "phone"], "similarity_threshold": 95})
    names = [*SYSTEMS, "Broken"] if broken else SYSTEMS
    if broken:
        sources.append({"name": "Broken", "path": f"{root}/source/not-there", "entity": "customer", "dedupe_keys": ["email", "phone"]})
    return config_from({"root": root, "sources": sources, "schemas": {f"{n}_customer".lower(): {"fields": MEDALLION_FIELDS} for n in names}})


@query(MEDALLION)
def medallion_gold(spark, sf_dir):
    root = scratch(spark, "medallion")
    config = medallion_config(spark, sf_dir, root)
    runs = jobs.run_all(spark, config)
    if any(r.status == "FAILED" for r in runs):
        raise RuntimeError(str([r.errors for r in runs]))
    gold = Table(spark, config.path("gold", "customer")).read()
    return gold.select("customer_id", "first_name", "last_name", "source_system", F.col("created_ts").cast(T.DateType()).alias("created_ts"))




# ---------------------------------------------------------------- what the jobs leave behind

PEOPLE_ROWS = f"""
people AS ({fx.oracle(fx.PEOPLE)}),
bronze AS (SELECT *, row_number() OVER (PARTITION BY source_system, email, phone ORDER BY customer_id) AS rn FROM people),
loads AS (SELECT lower(source_system || '_customer') AS target, source_system, count(*) AS incoming, count(*) FILTER (rn = 1) AS main, count(*) FILTER (rn > 1) AS conflicted FROM bronze GROUP BY source_system)"""


@query(f"""
WITH {PEOPLE_ROWS},
steps AS (
  SELECT 'raw_ingestion' AS job, target, 'INITIALIZE' AS load_type, 'SUCCESS' AS status, incoming, incoming AS inserted, 0 AS conflicted FROM loads
  UNION ALL SELECT 'raw_ingestion', 'broken_customer', 'FAILED', 'FAILED', 0, 0, 0
  UNION ALL SELECT 'deduplication', target, 'DEDUP', 'SUCCESS', incoming, main, conflicted FROM loads
  UNION ALL SELECT 'deduplication', 'broken_customer', 'FAILED', 'FAILED', 0, 0, 0),
audit AS (SELECT * FROM steps UNION ALL SELECT job, 'JOB_SUMMARY', 'SUMMARY', 'FAILED', CAST(sum(incoming) AS BIGINT), CAST(sum(inserted) AS BIGINT), CAST(sum(conflicted) AS BIGINT) FROM steps GROUP BY job)
SELECT 'audit' AS record, job, target, load_type, status, incoming, inserted, conflicted FROM audit
UNION ALL SELECT 'error', job, 'Broken', NULL, NULL, NULL, NULL, NULL FROM steps WHERE status = 'FAILED'
UNION ALL SELECT 'lineage', job, lower(replace(target, '_customer', '')), load_type, NULL, NULL, NULL, NULL FROM steps WHERE status <> 'FAILED'""")
def run_records(spark, sf_dir):
    """Audit, error and lineage rows of an ingestion and a deduplication with a source that can't be read."""
    root = scratch(spark, "records")
    config = medallion_config(spark, sf_dir, root, broken=True)
    runs = {r.run_id: r.job_name for r in (jobs.ingest(spark, config), jobs.bronze(spark, config))}
    job = F.create_map(*[F.lit(x) for pair in runs.items() for x in pair])[F.col("run_id")]
    nothing = [F.lit(None).cast("long").alias(c) for c in ("incoming", "inserted", "conflicted")]
    system = {n: Table(spark, config.path("system", n)).read().withColumn("job", job) for n in ("audit", "error", "lineage")}
    audit = system["audit"].select(F.lit("audit").alias("record"), "job", F.col("target"), "load_type", "status", F.col("records_incoming").alias("incoming"), F.col("records_inserted").alias("inserted"), F.col("records_conflicted").alias("conflicted"))
    error = system["error"].select(F.lit("error").alias("record"), "job", F.col("source_system").alias("target"), F.lit(None).cast("string").alias("load_type"), F.lit(None).cast("string").alias("status"), *nothing)
    lineage = system["lineage"].select(F.lit("lineage").alias("record"), "job", F.lower("source_system").alias("target"), "load_type", F.lit(None).cast("string").alias("status"), *nothing)
    return audit.unionByName(error).unionByName(lineage)


@query(f"""
WITH {PEOPLE_ROWS},
passed AS (SELECT * FROM bronze WHERE rn = 1 AND customer_id % 11 <> 0)
SELECT 'customer' AS entity, count(*) AS input_count, count(DISTINCT (first_name, last_name)) AS output_count, (SELECT count(*) FROM bronze WHERE rn = 1 AND customer_id % 11 = 0) AS rejected FROM passed""")
def gold_counts(spark, sf_dir):
    """The gold job's summary, and what silver's quality check kept from it; the sources lack some telephones."""
    root = scratch(spark, "gold-counts")
    config = medallion_config(spark, sf_dir, root)
    jobs.ingest(spark, config)
    jobs.bronze(spark, config)
    for source in config.sources:
        bronze = jobs.bronze_table(spark, config, source)
        bronze.overwrite(bronze.read().withColumn("phone", F.when(F.col("customer_id").cast("long") % 11 != 0, F.col("phone"))), jobs.BRONZE_LAYOUT)
    jobs.silver(spark, config)
    rejected = Table(spark, config.path("system", "dq")).read().agg(F.sum("records_rejected").alias("rejected"))
    return jobs.gold_summary(jobs.gold(spark, config)).withColumn("rejected", F.lit(rejected.first()[0]))


T1, T2, T3 = ("2024-05-01T00:00:00+00:00", "2024-05-02T00:00:00+00:00", "2024-05-03T00:00:00+00:00")


def _two_loads(spark: SparkSession, sf_dir: str, label: str):
    """A lake whose one source has even ids on the first day and all ids on the second."""
    from datetime import datetime

    root = scratch(spark, label)
    people = fx.relation(spark, sf_dir, fx.PEOPLE).drop("address_line2", "source_system").withColumnRenamed("customer_id", " Cust_ID")
    people.where(F.col(" Cust_ID") % 2 == 0).write.csv(f"{root}/day1", header=True)
    people.write.csv(f"{root}/day2", header=True)
    schema = {"crm_customer": {"fields": MEDALLION_FIELDS}}
    day = lambda n: config_from({"root": root, "sources": [{"name": "CRM", "path": f"{root}/day{n}", "entity": "customer", "dedupe_keys": ["email", "phone"]}], "schemas": schema})
    return day, [datetime.fromisoformat(t) for t in (T1, T2, T3)]


INCREMENTAL = f"""
WITH people AS ({fx.oracle(fx.PEOPLE)}),
batches AS (SELECT customer_id, email, phone, CASE WHEN customer_id % 2 = 0 THEN 1 ELSE 2 END AS batch FROM people {{again}})
SELECT customer_id, batch, CASE WHEN row_number() OVER (PARTITION BY email, phone, batch ORDER BY customer_id) = 1 THEN 'MAIN' ELSE 'CONFLICTED' END AS bronze_type FROM batches"""


def _incremental(spark: SparkSession, sf_dir: str, label: str, change_column: str) -> DataFrame:
    day, (t1, t2, t3) = _two_loads(spark, sf_dir, label)
    for n, at in ((1, t1), (2, t2)):
        jobs.ingest(spark, day(n), at=at)
        jobs.bronze(spark, day(n), change_column=change_column, at=at)
    jobs.bronze(spark, day(2), change_column=change_column, at=t3)  # nothing is new
    table = jobs.bronze_table(spark, day(2), day(2).sources[0]).read()
    return table.select("customer_id", F.dayofmonth("dedupe_ts").alias("batch"), "bronze_type")


@query(INCREMENTAL.replace("{again}", ""))
def incremental_bronze(spark, sf_dir):
    """Bronze after two days: each row is seen once, on the day it first came."""
    return _incremental(spark, sf_dir, "incremental", "ingestion_ts")


@query(INCREMENTAL.replace("{again}", "UNION ALL SELECT customer_id, email, phone, 2 FROM people WHERE customer_id % 2 = 0"))
def incremental_updates(spark, sf_dir):
    """Bronze by update time: rows that the second load touched are seen again."""
    return _incremental(spark, sf_dir, "updates", "updated_ts")


@query("""
WITH n AS (SELECT count(*) AS total, count(*) FILTER (c_custkey % 2 = 0) AS even FROM customer)
SELECT * FROM (VALUES (1, 'raw_ingestion', 'INITIALIZE', NULL), (2, 'deduplication', 'DEDUP', 1), (3, 'deduplication', 'NO_NEW', 1), (4, 'raw_ingestion', 'MERGE', 1), (5, 'deduplication', 'DEDUP', 2),
  (6, 'deduplication', 'DEDUP', 2), (7, 'raw_ingestion', 'INITIALIZE', 2)) steps(step, job, load_type, seen_day),
  LATERAL (SELECT CASE step WHEN 1 THEN even WHEN 2 THEN even WHEN 3 THEN 0 WHEN 4 THEN total WHEN 5 THEN total - even ELSE total END AS incoming FROM n)""")
def load_types(spark, sf_dir):
    """Every load type in one history, with the checkpoint after each step; step 6 follows a reset of checkpoints, 7 is a reset load."""
    from dataclasses import replace

    day, (t1, t2, _) = _two_loads(spark, sf_dir, "load-types")
    source, out = day(1).sources[0], []

    def note(run) -> None:
        seen = jobs.last_checkpoint(spark, day(1), source)
        o = run.outcomes[0]
        out.append((len(out) + 1, run.job_name, o.load_type, None if seen is None else seen.day, o.incoming))

    note(jobs.ingest(spark, day(1), at=t1))
    note(jobs.bronze(spark, day(1), at=t1))
    note(jobs.bronze(spark, day(1), at=t1))
    note(jobs.ingest(spark, day(2), at=t2))
    note(jobs.bronze(spark, day(2), at=t2))
    jobs.reset_checkpoints(spark, day(2))
    note(jobs.bronze(spark, day(2), at=t2))
    note(jobs.ingest(spark, replace(day(2), reset_mode=True), at=t2))
    return spark.createDataFrame(out, "step int, job string, load_type string, seen_day int, incoming long")


@query(f"""
WITH {PEOPLE_ROWS}
SELECT 'skip' AS missing, (SELECT count(*) FROM bronze WHERE rn = 1 AND source_system IN ('CRM', 'ERP')) AS n, '' AS refused
UNION ALL SELECT 'error', NULL, 'no bronze table of salesforce_customer'""")
def union_strict(spark, sf_dir):
    """The union of all sources' bronze where two of the sources have none: skipped, or an error."""
    root = scratch(spark, "strict")
    config = medallion_config(spark, sf_dir, root)
    for name in ("CRM", "ERP"):
        jobs.ingest(spark, config, only=name)
        jobs.bronze(spark, config, only=name)
    rows = [("skip", jobs.bronze_union(spark, config).count(), "")]
    try:
        jobs.bronze_union(spark, config, missing="error")
    except NoSuchTable as error:
        rows.append(("error", None, str(error)))
    return spark.createDataFrame(rows, "missing string, n long, refused string")


@query("""
WITH first AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'),
late AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' OR (ts >= TIMESTAMP '2024-01-12 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00'))
SELECT DISTINCT user_id, event_type FROM (SELECT * FROM first UNION ALL SELECT * FROM late WHERE ts > (SELECT max(ts) - INTERVAL 10 MINUTE FROM first))""")
def stream_late_rows(spark, sf_dir):
    """A stream of two days, stopped and started again with the next day and all before: rows before its watermark are late and dropped."""
    root = scratch(spark, "late")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-12")
    after = (F.col("ts") < "2024-01-10") | ((F.col("ts") >= "2024-01-12") & (F.col("ts") < "2024-01-13"))
    for rows in (events.where(first), events.where(after)):
        rows.write.mode("append").parquet(f"{root}/in")
        stream = read_stream(spark, f"{root}/in", events.schema)
        unique = streaming.first_arrivals(stream, EVENT_KEYS, "ts")
        streaming.write_to_store(unique, f"{root}/out", f"{root}/checkpoint", "late", available_now=True).awaitTermination()
    return Table(spark, f"{root}/out").read().select("user_id", "event_type")
