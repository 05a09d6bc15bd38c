import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import line_dedup, queries
from keelson.llm.perfect_hash import Shard
from tests.oracle import assert_same

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(k := key(line)) >= min_chars:
                holders[k].add(i)
                owner[k] = max(owner.get(k, -(1 << 63)), -(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        mine = -(1 << 63) if i is None else i
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and owner[key(x)] != mine)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "a": F.lit(1), "kept_text": F.lit(2)}).repartition(3)
    got = line_dedup.dedup_lines(df, ["doc_id"], **options).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted(map(tuple, got), key=repr)


LONG = "The quick brown fox jumps over the lazy dog again"


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, "\n"), (4, "x")],
        [(i, f"own line {i}\n {LONG} \nend") for i in range(7)],
        [(i, f"{LONG.upper() if i % 2 else LONG}\n{LONG}\t\n") for i in range(5)],
        [(i, LONG) for i in range(4)] + [(9, f"{LONG}\n" * 9)],
        [(None, LONG)] * 3 + [(1, LONG)] * 3,
        [(None, LONG)] * 6,
        [(7, LONG)] * 6,
        [(1, LONG)] * 4 + [(2, LONG)],
        [(i, LONG) for i in (1, 2, 3, 4, None)] + [(4, LONG)],
        [(i, "é" * 39 + "\n" + "É" * 40 + "\n" + "ü" * 40) for i in range(6)],
        [(i, LONG + "\xa0\n" + LONG + "\n" + "z" * 200_000) for i in range(6)],
    ],
)
def test_equals_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_many_shards_and_a_small_cache(spark, monkeypatch):
    lines = [f"a passage number {i} that is long enough to be counted" for i in range(300)]
    rows = [(d, "\n".join(lines[(d * 37 + k) % 300] for k in range(60))) for d in range(40)]
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 5)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 3)
    assert run(spark, rows, min_docs=3) == brute(rows, min_docs=3)


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        a, b = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
        if n > 10:
            a[:5] = a[0]  # equal first halves
        shard, index = Shard.build(a, b)
        assert sorted(index.tolist()) == list(range(n))
        again = Shard.from_bytes(shard.to_bytes())
        assert (again.lookup(a, b) == index).all()
        strange = rng.integers(0, 2**63, 2000).astype(np.uint64)
        assert (again.lookup(strange, strange) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        Shard.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def test_index_evicts_shards(spark):
    rows = [(d, "\n".join(f"line number {k} is shared by all the documents here" for k in range(50))) for d in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    uri, n = line_dedup.build_index(df, "doc_id", "text", 40, 5)
    index = line_dedup.Index(uri, n, limit=1)
    pairs = np.array([line_dedup.hashes(f"line number {k} is shared by all the documents here".encode()) for k in range(50)], np.uint64)
    docs, owner = index.lookup(pairs[:, 0].copy(), pairs[:, 1].copy())
    assert (docs == 6).all() and (owner == 5).all() and len(index.held) == 1


def test_counts_decide_and_one_index_serves_several_limits(spark):
    rows = [(d, "\n".join(f"line number {k} is held by the first {k} of the documents" for k in range(d + 1, 9))) for d in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    uri, n = line_dedup.build_index(df, "doc_id", "text", 40)
    index = line_dedup.Index(uri, n)
    pairs = np.array([line_dedup.hashes(f"line number {k} is held by the first {k} of the documents".encode()) for k in range(9)], np.uint64)
    docs, _ = index.lookup(pairs[:, 0].copy(), pairs[:, 1].copy())
    assert docs.tolist() == [0, 0, 2, 3, 4, 5, 6, 7, 8]
    for limit in (2, 4, 8):
        assert run(spark, rows, min_docs=limit) == brute(rows, min_docs=limit)
    with pytest.raises(ValueError, match="never dropped"):
        line_dedup.dedup_lines(df, ["doc_id"], min_docs=1)


def test_query_equals_sql(spark, sf_dir):
    assert_same(queries.op2_line_dedup(spark, sf_dir), queries.ORACLE_SQL["op2_line_dedup"], sf_dir)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]
    assert sorted(tuple(r) for r in queries.op2_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == sorted(want)
