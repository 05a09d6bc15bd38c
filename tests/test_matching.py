import datetime

from pyspark.sql import functions as F

from keelson.config import config_from
from keelson.operators import matching, setops
from keelson.operators.entities import RULES

D = datetime.date
CUSTOMER = "customer_id string, first_name string, last_name string, email string, phone string, date_of_birth date, source_system string, created_ts date"
CONFIG = config_from({"root": "/", "sources": [{"name": n, "path": "", "similarity_threshold": t} for n, t in (("CRM", 95), ("Salesforce", 97))]})


def people(spark):
    return spark.createDataFrame(
        [
            ("1", "rahul", "gupta", "r@x.com", "12345678", D(1990, 1, 1), "crm", D(2024, 1, 1)),
            ("2", "rahool", "guptha", "r@x.com", "12345678", D(1990, 1, 1), "salesforce", D(2020, 1, 1)),
            ("3", "rahul", "gupta", "r@x.com", "12345678", D(1990, 1, 1), "other", D(2025, 1, 1)),
            ("4", None, None, None, None, None, "crm", D(2024, 1, 1)),
            ("5", None, None, None, None, None, "sap", D(2024, 1, 1)),
        ],
        CUSTOMER,
    )


def test_priority_beats_recency_and_thresholds_follow_the_row(spark):
    got = {r["customer_id"]: r for r in matching.resolve(people(spark), RULES["customer"], CONFIG).collect()}
    assert got["2"]["silver_type"] == "MAIN" and got["2"]["similarity"] is None
    assert 80 < got["1"]["similarity"] < 95
    assert got["1"]["silver_type"] == "MAIN", "crm asks for 95"
    assert got["3"]["silver_type"] == "CONFLICTED", "an unknown source asks for 80"


def test_null_blocks_and_zero_scores_are_kept(spark):
    got = {r["customer_id"]: r for r in matching.resolve(people(spark), RULES["customer"], CONFIG).collect()}
    assert len(got) == 5
    assert got["4"]["silver_type"] == "MAIN"
    assert got["5"]["similarity"] == 0.0 and got["5"]["silver_type"] == "MAIN"
    strict = {r["customer_id"]: r["silver_type"] for r in matching.resolve(people(spark), RULES["customer"], CONFIG, strict_compat=True).collect()}
    assert sum(v is None for v in strict.values()) == 1


def test_unknown_entity_passes(spark):
    df = people(spark).withColumn("entity", F.when(F.col("customer_id") < "4", "customer").otherwise("widget"))
    got = matching.silver(df, CONFIG)
    assert got.count() == 5
    assert got.where("entity = 'widget' AND silver_type = 'MAIN'").count() == 2


def test_golden(spark):
    rows = matching.golden(people(spark), RULES["customer"]).collect()
    assert len(rows) == 3
    assert [r["customer_id"] for r in rows if r["first_name"] == "rahul"] == ["1"]
    assert rows[0].__fields__ == list(RULES["customer"].gold_columns)
    compat = matching.golden(people(spark), RULES["customer"], strict_compat=True).collect()
    assert [r["customer_id"] for r in compat if r["first_name"] == "rahul"] == ["3"]


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    assert sorted(map(tuple, setops.union_by_name(a, b).collect()), key=repr) == [(1, 2, None), (4, None, 3)]
