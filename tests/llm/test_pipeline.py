import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import line_quality, scratch, source_mix
from tests.llm.test_simhash import brute_similar


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    benchmark = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
        out[name] = [r.asDict() for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    limits, passed = line_quality.Limits(), {}
    for i, r in rows.items():
        n, _, repeats, lost, text = line_quality.clean((r["text"] or "").encode())
        if n >= 50 and 100 * repeats <= 50 * n and lost <= limits.max_lost_share * n:
            passed[i] = r | {"text": text.decode(), "n_chars": len(text.decode())}
    assert {r["doc_id"]: r for r in out["quality_rules"]} == passed

    comps = brute_similar({i: r["text"] for i, r in passed.items()})
    single = {i: passed[i] for i in set(comps.values())}
    assert {r["doc_id"]: r for r in out["simhash_near_dedup"]} == single

    clean = {r["doc_id"]: r for r in out["benchmark_decontamination"]}
    leaking = {i for i, r in single.items() if any(b in r["text"] for b in benchmark)}
    assert set(clean) == set(single) - leaking
    assert all(clean[i] == single[i] for i in clean)

    copies = Counter(r["doc_id"] for r in out["source_mix"])
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    assert all(r == clean[r["doc_id"]] for r in out["source_mix"])
    words = lambda r: len(r["text"].split())
    total, taken = sum(map(words, clean.values())), sum(map(words, out["source_mix"]))
    assert abs(taken - 1.5 * total) < 0.15 * total

    assert Counter(r["doc_id"] for r in out["sharding"]) == copies


CLASHES = ["row", "id", "fp", "content", "kept", "cleaned", "size", "start", "rate", "offset", "copies", "target", "source_size", "rows", "__row", "__id", "__src", "__size", "__head", "__content", "path", "shard", "tier"]


def prose(seed, n=12):
    rng = random.Random(seed)
    return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9)) + "." for _ in range(n))


def made(spark, rows, clashes):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"own {c}") for c in clashes})


@pytest.mark.parametrize("clashes", [[], CLASHES])
def test_edge_rows_through_all_stages(spark, sf_dir, clashes):
    """NULLs in every column, empty and very long texts, repeated rows, ties and columns with clashing names."""
    long = prose(99, 4000)
    rows = [(i, prose(i), "en", f"s{i % 2}", 5) for i in range(12)]
    rows += [(20, None, "en", "s0", 0), (21, "", None, None, None), (None, None, None, None, None), (22, "\n \t", "en", "s1", 3)]
    rows += [(30, prose(30), None, None, None), (None, prose(31), "en", "s0", 7), (40, long, "en", "s1", 9)]
    rows += [(50, prose(50), "en", "s1", 1)] * 3 + [(51, prose(50), "en", "s0", 1), (None, prose(52), "en", "s1", 2), (None, prose(52), "en", "s1", 2)]
    docs = made(spark, rows, clashes)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(r[c] == f"own {c}" for r in seen[name] for c in clashes)
    texts = lambda name: Counter((r["doc_id"], r["text"]) for r in seen[name])
    good = Counter((i, t) for i, t, *_ in rows if t and len(t) > 100)
    assert texts("quality_rules") == good
    alone = Counter({k: 1 for k in good if k not in ((51, prose(50)),)})
    assert texts("simhash_near_dedup") == alone and texts("benchmark_decontamination") == alone
    taken = texts("source_mix")
    assert set(taken) <= set(alone) and max(taken.values()) <= 2 and (40, long) in taken
    assert Counter(r["doc_id"] for r in seen["sharding"]) == Counter({i: 0 for i, _ in taken}) + Counter(r["doc_id"] for r in seen["source_mix"])


def test_empty_table_through_all_stages(spark, sf_dir):
    docs = made(spark, [], CLASHES[:3])
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_equal_rows_keep_their_copies(spark):
    """Of equal rows one stands for all; rows that differ in any column are themselves."""
    rows = [(1, "a b c", "en", "s", 1)] * 5 + [(1, "a b c", "de", "s", 1), (None, "x y", None, None, None), (None, "x y", None, None, None)]
    got = Counter(tuple(r) for r in source_mix.emit(made(spark, rows, []), share_percent=200).collect())
    assert got == Counter({(1, "a b c", "en", "s", 1): 10, (1, "a b c", "de", "s", 1): 2, (None, "x y", None, None, None): 4})


def test_run_returns_the_last_stage(spark, sf_dir):
    df = corpus_pipeline.run(spark, sf_dir)
    assert df.columns == ["doc_id", "shard", "tier", "shard_rows", "version"] and df.count() > 0


def test_shared_folder_is_the_sessions(spark):
    assert scratch.shared_dir(spark).uri.endswith(spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/"))
