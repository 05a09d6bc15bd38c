"""Entity relations derived from the test tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a table.  The synthetic source system cycles through the
four known systems and an unknown one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYSTEM = "CASE {id} % 5 WHEN 0 THEN 'Salesforce' WHEN 1 THEN 'ERP' WHEN 2 THEN 'CRM' WHEN 3 THEN 'SAP' ELSE 'Other' END"


def system(column: str) -> str:
    return SYSTEM.replace("{id}", column)


PEOPLE = f"""
SELECT c_custkey AS customer_id, lower(c_mktsegment) AS first_name, lower(n_name) AS last_name,
       lower(c_mktsegment) || CAST(c_custkey % 40 AS STRING) || '@mail' || CAST(c_custkey % 3 AS STRING) || '.example.com' AS email,
       '+1 (555) ' || CAST(1000 + c_custkey % 50 AS STRING) AS phone,
       date '1980-01-01' + CAST(c_custkey % 4 AS INT) AS date_of_birth,
       CAST(c_nationkey AS STRING) || ' Main Street' AS address_line1, CAST(NULL AS STRING) AS address_line2,
       lower(n_name) AS city, lower(r_name) AS state, CAST(10000 + c_nationkey AS STRING) AS postal_code,
       {system("c_custkey")} AS source_system, date '2020-01-01' + CAST(c_custkey % 365 AS INT) AS created_ts
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""
ACCOUNTS = f"""
SELECT p_partkey AS account_id, p_name AS account_name, p_brand AS account_group, p_type AS account_owner, CAST(p_size AS STRING) AS account_code,
       {system("p_partkey")} AS source_system, date '2020-01-01' + CAST(p_partkey % 365 AS INT) AS created_ts
FROM {{part}}
"""
ADDRESSES = f"""
SELECT s_suppkey AS address_id, CAST(10000 + s_nationkey AS STRING) AS postal_code, n_name AS city, r_name AS state, s_name AS address_line1,
       CAST(NULL AS STRING) AS address_line2, {system("s_suppkey")} AS source_system, date '2020-01-01' + CAST(s_suppkey % 365 AS INT) AS created_ts
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""
TRANSACTIONS = f"""
SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_custkey % 100 AS account_id, CAST(floor(o_totalprice / 20000) AS BIGINT) AS amount,
       o_orderpriority AS currency, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 2 AS INT) AS transaction_date, o_orderstatus AS transaction_type,
       {system("o_orderkey")} AS source_system, CAST(o_orderdate AS DATE) AS created_ts
FROM {{orders}}
"""
CONTACTS = f"""
SELECT doc_id AS contact_id, source AS contact_value, lang AS contact_type, {system("doc_id")} AS source_system,
       date '2020-01-01' + CAST(doc_id % 365 AS INT) AS created_ts
FROM {{documents}}
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def relation(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in query]
    return spark.sql(query, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(query: str) -> str:
    return query.format(**{t: t for t in TABLES})
