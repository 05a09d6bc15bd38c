import datetime

import pytest
from pyspark.sql import functions as F

from keelson import schema as schemas
from keelson.functions import quality
from keelson.functions import standardize as S


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "` Cust_ID ` int, `EMAIL` int")
    assert S.normalize_headers(df).columns == ["cust_id", "email"]
    assert S.rename_synonyms(S.normalize_headers(df)).columns == ["customer_id", "email"]
    with pytest.raises(ValueError, match="collide"):
        S.normalize_headers(spark.createDataFrame([(1, 2)], "`a ` int, `A` int"))
    with pytest.raises(ValueError, match="collide"):
        S.rename_synonyms(spark.createDataFrame([(1, 2)], "id int, customerid int"))


def test_types(spark):
    s = schemas.from_config("CRM_Customer", {"schemas": {"crm_customer": {"fields": [{"name": "id", "type": "long", "natural_key": True}, {"name": "name", "type": "string"}, {"name": "d", "type": "date"}, {"name": "t", "type": "timestamp"}, {"name": "x", "type": "double"}, {"name": "m", "type": "decimal(10,2)"}, {"name": "absent", "type": "string"}]}}})
    assert s.natural_keys == ["id"]
    df = spark.createDataFrame([(" 7 ", " MiXed ", "2024-02-03", "2024-02-03 04:05:06", "1.5", "2.345", "kept"), ("x", None, "no", "no", "no", "no", None)], "id string, name string, d string, t string, x string, m string, more string")
    good, bad = S.standardize(df, s).collect()
    assert (good["id"], good["name"], good["d"], good["x"], str(good["m"]), good["more"]) == (7, "mixed", datetime.date(2024, 2, 3), 1.5, "2.35", "kept")
    assert good["t"] == datetime.datetime(2024, 2, 3, 4, 5, 6)
    assert list(bad) == [None] * 7
    with pytest.raises(KeyError):
        schemas.data_type("array")


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-03",), ("03-02-2024",), ("2024/02/03",), ("31-02-2024",), (None,), ("",)], "d string")
    assert [r[0] for r in df.select(S.repair_date(F.col("d"))).collect()] == [datetime.date(2024, 2, 3)] * 2 + [None] * 4


def test_source_rank(spark):
    df = spark.createDataFrame([("salesforce",), ("ERP",), ("Crm",), ("SAP",), ("x",), (None,)], "s string")
    got = df.select(S.source_rank(F.col("s")).alias("a"), S.source_rank(F.col("s"), strict_compat=True).alias("b")).collect()
    assert [r["a"] for r in got] == [1, 2, 3, 4, 5, 5]
    assert [r["b"] for r in got] == [5, 2, 5, 4, 5, 5]


def test_value_functions(spark):
    r = spark.createDataFrame([("+1 (23)-4", "a@b@c.d", "9lives")], "p string, e string, n string").select(S.digits(F.col("p")).alias("d"), S.prefix(F.col("p"), 3).alias("x"), S.email_domain(F.col("e")).alias("m"), F.soundex("n").alias("s")).first()
    assert tuple(r) == ("1234", "+1 ", "c.d", "9lives")


def test_quality(spark):
    df = spark.createDataFrame([("a@b.c", "+1 555-0100"), ("a@b", "555"), ("@b.c", "12345678"), (None, None)], "e string, p string")
    got = df.select(quality.valid_email(F.col("e")), quality.valid_phone(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, True), (False, False)]
    good, bad = quality.split(df, quality.present(["e", "p"]))
    assert (good.count(), bad.count()) == (3, 1)


def test_created_date(spark):
    df = spark.createDataFrame([("2024-01-02", 1)], "created_ts string, ingestion_ts int")
    assert S.created_date(df).first()["created_ts"] == datetime.date(2024, 1, 2)
    assert S.created_date(df.drop("created_ts")).first()["created_ts"] == 1
