import random
import re

import pytest
from pyspark.sql import functions as F

from keelson.llm import source_mix
from keelson.llm.queries import ORACLE_SQL, op1_source_mix
from tests.oracle import assert_same

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=150, most=2):
    """Share by weight, cap, share the excess again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), sum(sizes.values()) * share / 100
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash"))
    return source_mix.mix(df, **options).collect()


def check(rows, got):
    assert len(got) == len(rows)
    sizes, longest = {}, {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
        longest[s] = max(longest.get(s, 0), n)
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    return want, taken, longest


@pytest.mark.parametrize("seed", range(4))
def test_random_sources(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(rng.randrange(1, 12))] + [None, "ü", "z"]
    rows = [(i, "s0" if rng.random() < 0.3 else rng.choice(names), int(rng.paretovariate(1.2) * 20)) for i in range(4000)]
    want, taken, longest = check(rows, run(spark, rows))
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * longest[s] + 0.02 * t


def test_capped_source_is_taken_twice_whole(spark):
    rows = [(i, "a", 10) for i in range(4)] + [(100 + i, "b", 1000) for i in range(50)]
    got = run(spark, rows)
    check(rows, got)
    assert {r["copies"] for r in got if r["source"] == "a"} == {2}


def test_reruns_and_partitions_do_not_matter(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(50)) for i in range(3000)]
    first = sorted((r["doc_id"], r["copies"]) for r in run(spark, rows))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted((r["doc_id"], r["copies"]) for r in run(spark, rows)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, "a", 0), (2, "b", 0)], [(1, "a", 5)], [(None, "a", 5)] * 9, [(3, "a", 5)] * 9 + [(4, "b", 0)]])
def test_edges(spark, rows):
    check(rows, run(spark, rows))


def test_emit_repeats_rows_and_keeps_columns(spark):
    texts = [None, "", "a b c", "x " * 5000, "one\ttwo\x0bthree"]
    rows = [(i % 7, texts[i % 5], "s" if i % 3 else None, i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = source_mix.emit(docs)
    assert out.columns == docs.columns
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    taken = sum(len((r["text"] or "").split()) for r in out.collect())
    assert abs(taken - 1.5 * total) <= 2 * 5000 * 2
    known = set(rows)
    assert all(tuple(r) in known for r in out.collect())


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_source_mix(spark, sf_dir).collect()
    rows = [(i, r["source"], len(WORDS.findall(r["text"] or ""))) for i, r in docs.items()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    assert {r["doc_id"]: r["size"] for r in got} == {i: n for i, _, n in rows}
    for r in got:
        assert abs(r["target"] - want[docs[r["doc_id"]]["source"]]) < 1e-6
        assert r["taken"] <= 2 * r["size"]
    again = op1_source_mix(spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_main_path_has_no_python(spark, sf_dir):
    plan = op1_source_mix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark, sf_dir):
    assert_same(op1_source_mix(spark, sf_dir), ORACLE_SQL["op1_source_mix"], sf_dir)


def test_input_columns_of_any_name(spark):
    rows = [(i, f"s{i % 3}", 1 + i % 7) for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, source string, size long")
    names = ["start", "rate", "offset", "__task", "__at", "__of", "__row", "__id", "__src", "copies", "target"]
    clashing = source_mix.mix(plain.withColumns({c: F.lit("own") for c in names}))
    assert {(r["doc_id"], r["copies"]) for r in clashing.collect()} == {(r["doc_id"], r["copies"]) for r in source_mix.mix(plain).collect()}
    assert clashing.where("start = 'own' and rate = 'own' and offset = 'own' and __row = 'own' and __id = 'own'").count() == 40
