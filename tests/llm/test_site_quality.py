import math
import random

import numpy as np
from pyspark.sql import functions as F

from keelson.llm import site_quality as q
from keelson.llm.queries import op7_site_quality

GOOD = "Plain words form a sentence here. Another one follows it, and so on."
BAD = "BUY!! NOW!! ### $$$ CHEAP!! | HOME | NEWS |"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"row": F.lit(1), "y": F.lit(2), "score": F.lit("x")})


def test_held_out_accuracy(spark, sf_dir):
    where = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    got = {r["id"]: r["kept"] for r in q.score(docs, labels.where("doc_id % 4 <> 0")).collect()}
    held = labels.where("doc_id % 4 = 0").collect()
    assert len(held) > 50
    assert sum(got[r["doc_id"]] == (r["quality"] == 1) for r in held) >= 0.95 * len(held)


def test_sites_shrink_toward_their_parents(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        host = "big" if i % 3 == 0 else f"h{i % 30}"
        good = rng.random() < (0.95 if host == "big" else 0.3)
        rows.append((i, GOOD if good else BAD, host, "en" if i % 2 else "de"))
        labels.append((i, int(good), 0))
    rows.append((5000, GOOD, "new", "en"))
    labels.append((777_777, 1, 0))
    got = {r["id"]: r for r in q.score(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    overall = sum(v for _, v, _ in labels[:-1]) / 900
    assert got[0]["host_rate"] > 0.9
    assert abs(got[5000]["host_rate"] - overall) < 0.05, "a host with one document leans on the global rate"
    assert all(0 <= r["path_rate"] <= 1 for r in got.values())
    assert sum(r["kept"] == (rows[i if i < 5000 else 900][1] == GOOD) for i, r in got.items()) > 0.97 * len(got)


def test_rates_equal_a_plain_computation(spark):
    rows = [(i, GOOD if i % 4 else BAD, "ab"[i % 2], "xyz"[i % 3]) for i in range(60)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(60)]
    got = {r["id"]: r for r in q.score(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    y = {i: v for i, v, _ in labels}
    hosts = {h: [y[i] for i, _, s, _ in rows if s == h] for h in "ab"}
    rate = sum(y.values()) / 60

    def strength(groups):
        n = sum(g[1] for g in groups)
        spread = sum(g[1] * (g[0] / g[1] - g[2]) ** 2 for g in groups)
        noise = sum(g[2] * (1 - g[2]) for g in groups)
        between, within = max((spread - noise) / n, 0), sum(g[2] * (1 - g[2]) * g[1] for g in groups) / n
        return min(1e4, max(1.0, within / between - 1)) if between > 0 else 1e4

    k = strength([(sum(v), len(v), rate) for v in hosts.values()])
    for i, r in got.items():
        v = hosts[rows[i][2]]
        assert math.isclose(r["host_rate"], (sum(v) - y[i] + k * rate) / (len(v) - 1 + k), rel_tol=1e-9)


def test_edges(spark):
    rows = [(None, None, None, None), (1, "", "a", None), (1, GOOD, "a", "en"), (1, GOOD, "a", "en"), (2, "w" * 200_000 + " " + GOOD * 2000, None, "en")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.score(table(spark, rows), none).collect()
    assert len(got) == 5 and all(r["kept"] and r["evidence"] == 0 for r in got)
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (1, 1, 0), (1, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.score(table(spark, rows), odd).count() == 5
    assert q.score(table(spark, []), odd).count() == 0
    assert q.features(None) == q.features(b" \n") == (0.0,) * len(q.FEATURES)


def test_fit_separates_and_is_bounded():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    w = q.fit(x, (x[:, 0] > 0).astype(float))
    assert ((np.hstack([np.ones((500, 1)), x]) @ w > 0) == (x[:, 0] > 0)).mean() > 0.97
    assert np.isfinite(q.fit(np.zeros((3, 2)), np.array([1.0, 1.0, 1.0]))).all()
    assert (q.fit(np.zeros((0, 2)), np.zeros(0)) == 0).all()


def test_query_covers_every_document(spark, sf_dir):
    got = op7_site_quality(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_training_sample_is_bounded_and_repeatable(spark):
    df = spark.range(20_000).withColumns({"y": F.lit(1.0), **{f: F.col("id").cast("double") for f in q.FEATURES}})
    rows = sorted(r["log_words"] for r in q.training_sample(df, 1000).collect())
    assert 850 < len(rows) < 1150
    assert sorted(r["log_words"] for r in q.training_sample(df.repartition(7), 1000).collect()) == rows
    assert q.training_sample(df.limit(900), 1000).count() == 900
