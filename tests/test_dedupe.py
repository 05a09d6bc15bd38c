import random

import pytest
from pyspark.sql import functions as F

from keelson.config import source_from
from keelson.operators import dedupe
from keelson.operators.survivors import with_survivor
from keelson.plans import jobs

SCHEMA = "id int, region string, device string, seen int"


def random_rows(seed, n, regions, devices, times):
    rng = random.Random(seed)
    return [(i, rng.choice(regions), rng.choice(devices), rng.choice(times)) for i in range(n)]


#: (rows, keys): survivors and losers are worked out by plain loops below.
CASES = {
    "many keys, few rows each": (random_rows(1, 120, [f"r{i}" for i in range(60)], ["d"], list(range(50))), ["region"]),
    "ties on the time": (random_rows(2, 90, ["north", "south"], ["a", "b", "c"], [7]), ["region", "device"]),
    "unknown times come last": (random_rows(3, 80, ["north", "south", "east"], ["a"], [None, None, 4, 9]), ["region"]),
    "parts of the key unknown": (random_rows(4, 100, ["north", None], ["a", None], list(range(5))), ["region", "device"]),
    "one key has nearly all": (random_rows(5, 200, ["hot"] * 40 + ["cold"], ["a"], list(range(8))), ["region"]),
    "nothing at all": ([], ["region"]),
}


@pytest.mark.parametrize("case", CASES)
def test_split_equals_plain_loops(spark, case):
    rows, keys = CASES[case]
    df = spark.createDataFrame(rows, SCHEMA)
    order = dedupe.newest_first("seen", "id")
    groups = {}
    for r in rows:
        named = dict(zip(("id", "region", "device", "seen"), r, strict=True))
        groups.setdefault(tuple(named[k] for k in keys), []).append(r)
    best = {min(g, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))[0] for g in groups.values()}
    assert {r["id"] for r in dedupe.main_rows(df, keys, order).collect()} == best
    assert {r["id"] for r in dedupe.conflicted_rows(df, keys, order).collect()} == {r[0] for r in rows} - best
    labels = {r["id"]: r["bronze_type"] for r in dedupe.split_labelled(df, keys, order).collect()}
    assert labels == {r[0]: "MAIN" if r[0] in best else "CONFLICTED" for r in rows}


def test_missing_key_is_an_error(spark):
    with pytest.raises(ValueError, match="absent"):
        dedupe.main_rows(spark.range(3), ["absent"], dedupe.newest_first("id"))
    with pytest.raises(ValueError, match="dedupe keys"):
        jobs.split_bronze(spark.range(3).withColumn("updated_ts", F.lit(1)), source_from({"name": "X", "dedupe_keys": ["absent"]}))


def test_salted_and_plain_survivors_agree_on_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(9)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, t int")
    order = dedupe.newest_first("t", "id")
    plain = with_survivor(df, ["k"], order, ["id"], salts=1)
    salted = with_survivor(df, ["k"], order, ["id"], salts=7)
    as_set = lambda d: {(r["id"], r["__survivor"], r["__main"]["id"]) for r in d.collect()}
    assert as_set(plain) == as_set(salted)
    assert sum(s for _, s, _ in as_set(salted)) == 4


def test_repeated_rows_have_one_survivor(spark):
    df = spark.createDataFrame([(1, "a", 1)] * 5, "id int, k string, t int")
    for salts in (1, 4):
        assert with_survivor(df, ["k"], dedupe.newest_first("t", "id"), salts=salts).where("__survivor").count() == 1
