import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from keelson.llm import shards as s
from keelson.llm.queries import op10_tiered_shards


def docs(spark, n, parts=8, start=0):
    rng = random.Random(n)
    rows = [(start + i, "".join(rng.choice("abcdefgh ") for _ in range(200)), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(parts)


def test_plans():
    runs = [s.Run(f"f{i}", size, 1) for i, size in enumerate([1, 1, 1, 1, 5, 5, 90, 100, 2])]
    groups = s.plan_merges(runs, fan_in=4, small=4, target=100)
    assert [[r.path for r in g] for g in groups] == [["f0", "f1", "f2", "f3"]]
    assert [len(g) for g in s.plan_merges([s.Run(f"f{i}", 60, 1) for i in range(4)], 4, 4, 100)] == [2, 2]
    assert s.plan_merges([s.Run(f"f{i}", 70, 1) for i in range(4)], 4, 4, 100) == []
    full = s.plan_merges([s.Run(f"f{i}", 40, 1) for i in range(5)], 4, 4, 100)
    assert [len(g) for g in full] == [2, 2]
    assert [s.tier_of(x, 4, 4) for x in (0, 3, 4, 15, 16, 64)] == [0, 0, 1, 1, 2, 3]


def test_append_compact_versions(spark, tmp_path):
    store = s.ShardSet(spark, f"file://{tmp_path}/set")
    assert store.version() == 0 and store.read() is None
    for k in range(3):
        store.append(docs(spark, 200, 4, 1000 * k))
    assert store.version() == 3 and len(store.runs()) == 12
    rows = sorted(map(tuple, store.read().drop("__path", "__bytes").collect()))
    version = store.compact(fan_in=4, small=1 << 10, target=1 << 20)
    assert version > 3 and len(store.runs()) < 12
    assert sorted(map(tuple, store.read().drop("__path", "__bytes").collect())) == rows
    assert sum(r.rows for r in store.runs()) == 600
    assert store.read(2).count() == 400, "earlier versions stay readable while their files are kept"
    assert store.compact(4, 1 << 10, 1 << 20) == version, "nothing is left to merge"


def test_two_commits_of_a_version_one_fails(spark, tmp_path):
    store = s.ShardSet(spark, f"file://{tmp_path}/set")
    store.append(docs(spark, 10, 1))
    with pytest.raises(Exception, match="exists"):
        store._commit(0, "append", "{}", [])
    assert store.version() == 1 and store.read().count() == 10


def files(tmp_path):
    return {str(p.resolve()) for p in tmp_path.rglob("*.parquet")}


def test_older_versions_stay_readable_until_they_are_vacuumed(spark, tmp_path):
    store = s.ShardSet(spark, f"file://{tmp_path}/set")
    first = store.append(docs(spark, 100, 8))
    reader = store.read(first)  # planned before the merge, run after it
    store.compact(4, 1 << 10, 1 << 20)
    assert reader.count() == 100 and len(files(tmp_path)) > len(store.runs())
    assert store.vacuum(least_age=3600) == 0 and reader.count() == 100
    assert store.vacuum() >= 8
    assert files(tmp_path) == {"/" + r.path.removeprefix("file:").lstrip("/") for r in store.runs()}
    assert store.versions() == [store.version()] and store.read().count() == 100
    assert store.append(docs(spark, 10, 1, 500)) == store.version() == max(store.versions())


def test_appends_at_once_all_arrive(spark, tmp_path):
    store = s.ShardSet(spark, f"file://{tmp_path}/set")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: s.ShardSet(spark, store.uri).append(docs(spark, 20, 2, 100 * k)), range(6)))
    assert store.version() == 6
    assert sorted(r["doc_id"] for r in store.read().collect()) == sorted(100 * k + i for k in range(6) for i in range(20))


def brute_tiers(sizes, fan_in, small, target):
    """The passes over named sizes by plain counting: the groups of every pass, a merge's size being its parts' sum."""
    files, passes, fresh = dict(sizes), [], 0
    while True:
        tier = {n: 0 if z < small else 1 for n, z in files.items()}
        for n, z in files.items():
            while z >= small * fan_in ** tier[n] and z >= small:
                tier[n] += 1
        groups = []
        for t in sorted(set(tier.values())):
            waiting = sorted((z, n) for n, z in files.items() if tier[n] == t and z < target)
            group = []
            for z, n in waiting:
                if sum(x for x, _ in group) + z > 1.25 * target:
                    group = []
                group.append((z, n))
                if len(group) > 1 and (len(group) == fan_in or 4 * sum(x for x, _ in group) >= 3 * target):
                    groups.append([n for _, n in group])
                    group = []
        if not groups:
            return passes, files
        passes.append(groups)
        for g in groups:
            files[f"merged{fresh:03d}"] = sum(files.pop(n) for n in g)
            fresh += 1


@pytest.mark.parametrize("seed", range(6))
def test_arrivals_and_passes_equal_brute_force(seed):
    """Many arrivals of unequal files, compacted after each: plans equal plain counting, and no file is left that could merge."""
    rng = random.Random(seed)
    now, fresh = {}, 0
    for arrival in range(8):
        now |= {f"a{arrival}-{i}": rng.choice([1, 2, 3, 7, 20, 50, 90]) + rng.randrange(5) for i in range(rng.randrange(1, 9))}
        passes, left = brute_tiers(now, 4, 4, 100)
        runs, made = [s.Run(n, z, 1) for n, z in now.items()], 0
        for groups in passes:
            plan = s.plan_merges(runs, 4, 4, 100)
            assert [[r.path for r in g] for g in plan] == groups
            gone = {r.path for g in plan for r in g}
            merged = []
            for g in plan:
                merged.append(s.Run(f"merged{made:03d}", sum(r.bytes for r in g), sum(r.rows for r in g)))
                made += 1
            runs = [r for r in runs if r.path not in gone] + merged
        assert s.plan_merges(runs, 4, 4, 100) == []
        assert {r.path: r.bytes for r in runs} == left and sum(left.values()) == sum(now.values())
        now = {f"{arrival}/{n}": z for n, z in left.items()}


def test_three_arrivals_end_in_one_set(spark, tmp_path):
    uri = f"file://{tmp_path}/set"
    for k in range(3):
        got = s.shard(docs(spark, 150, 5, 1000 * k), uri=uri, fan_in=3, small=1 << 10, target=1 << 16)
        assert got.count() == 150 * (k + 1)
    assert sorted(r["id"] for r in got.collect()) == sorted(1000 * k + i for k in range(3) for i in range(150))
    store = s.ShardSet(spark, uri)
    assert [store.read(v).count() for v in store.versions() if store.manifest(v)["operation"] == "append"] == [150, 300, 450]


def test_every_row_is_in_one_shard(spark):
    df = docs(spark, 300, 6).union(spark.createDataFrame([(None, None, 1), (7, "x" * 100_000, 1), (7, "x" * 100_000, 1)], "doc_id long, text string, shard int"))
    df = df.withColumns({"path": F.lit("clash"), "tier": F.lit("clash"), "__path2": F.lit(1)})
    got = s.shard(df, fan_in=3, small=1 << 10, target=1 << 16).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(r["doc_id"]) for r in df.collect())
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + 1
    assert all(size[r["shard"]] == r["shard_rows"] for r in got)
    assert sorted(size) == list(range(len(size)))


def test_empty_table(spark):
    assert s.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    df = op10_tiered_shards(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    # by a plain plan: one arrival of a small table is one tier, its files merge into one
    parts = {r["shard"] for r in rows}
    assert parts == set(range(len(parts)))
    for k in parts:
        mine = [r for r in rows if r["shard"] == k]
        assert {(r["tier"], r["shard_rows"], r["version"]) for r in mine} == {(mine[0]["tier"], len(mine), mine[0]["version"])}
    firsts = [min(r["doc_id"] for r in rows if r["shard"] == k) for k in sorted(parts)]
    assert firsts == sorted(firsts) and len(parts) < s.FAN_IN
