import datetime
import os
import subprocess
import sys
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from keelson.sources.files import AlreadyThere, Folder
from keelson.sources.store import NoSuchTable, Table

SCHEMA = "k int, v string, at int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"))


def test_versions_time_travel_and_history(spark, table):
    assert not table.exists()
    with pytest.raises(NoSuchTable):
        table.read()
    a, b = spark.createDataFrame([(1, "a", 0)], SCHEMA), spark.createDataFrame([(2, "b", 0)], SCHEMA)
    assert table.append(a) == 0
    between = datetime.datetime.now(datetime.UTC)
    assert table.append(b) == 1
    assert table.overwrite(b) == 2
    assert rows(table.read()) == [(2, "b", 0)]
    assert rows(table.read(version=1)) == [(1, "a", 0), (2, "b", 0)]
    assert rows(table.read(timestamp=between)) == [(1, "a", 0)]
    assert [(r["version"], r["operation"]) for r in table.history().collect()] == [(2, "overwrite"), (1, "append"), (0, "append")]
    with pytest.raises(ValueError, match="not both"):
        table.read(version=1, timestamp=between)
    with pytest.raises(ValueError, match="version 9"):
        table.read(version=9)
    with pytest.raises(ValueError, match="as old as"):
        table.read(timestamp="2000-01-01")


def test_log_checkpoints_keep_the_state(spark, table):
    for i in range(23):
        table.append(spark.createDataFrame([(i, "x", 0)], SCHEMA))
    assert table.count() == 23 and table.count(11) == 12
    assert sorted(r["k"] for r in table.read().collect()) == list(range(23))


def test_schema_evolves_and_type_changes_fail(spark, table):
    table.append(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    table.append(spark.createDataFrame([(2, "new")], "k int, extra string"))
    assert rows(table.read()) == [(1, "a", 0, None), (2, None, None, "new")]
    with pytest.raises(ValueError, match="column k"):
        table.append(spark.createDataFrame([("x",)], "k string"))


def test_two_writers_one_fails(spark, table):
    table.append(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    folder = Folder(spark, table.uri)
    with pytest.raises(Exception, match="exists"):
        folder.create_json(f"_log/{0:020d}.json", {})
    assert table.count() == 1
    assert [n for n in folder.names("_log") if n.startswith(".draft")] == []


def test_upsert(spark, table):
    table.append(spark.createDataFrame([(1, "a", 10), (2, "b", 10), (None, "n", 10)], SCHEMA))
    table.append(spark.createDataFrame([(9, "far", 10)], SCHEMA))
    table.upsert(spark.createDataFrame([(2, "B", 20), (3, "c", 20), (None, "m", 20)], SCHEMA), ["k"], preserve=["at"])
    assert rows(table.read()) == sorted([(1, "a", 10), (2, "B", 10), (3, "c", 20), (9, "far", 10), (None, "m", 20), (None, "n", 10)], key=repr)
    last = table.history().first()
    assert last["metrics"]["rows_inserted"] == 2 and table.metrics()["rows_in_source"] == 3
    files = set(table._state(1)[1]) & set(table._state(2)[1])
    assert files, "files without a matching key are not rewritten"
    before = rows(table.read())
    table.upsert(spark.createDataFrame([(2, "B", 20), (3, "c", 20)], SCHEMA), ["k"], preserve=["at"])
    assert rows(table.read()) == before, "an upsert is idempotent"
    with pytest.raises(ValueError, match="several source rows"):
        table.upsert(spark.createDataFrame([(2, "x", 1), (2, "y", 1)], SCHEMA), ["k"])
    with pytest.raises(ValueError, match="at least one key"):
        table.upsert(spark.createDataFrame([(2, "x", 1)], SCHEMA), [])


def test_upsert_moves_rows_between_partitions(spark, table):
    table.overwrite(spark.createDataFrame([(1, "a", 10), (2, "b", 11)], SCHEMA), ["at"])
    table.upsert(spark.createDataFrame([(1, "A", 12)], SCHEMA), ["k"])
    assert rows(table.read()) == [(1, "A", 12), (2, "b", 11)]
    assert table.read().where("at = 12").count() == 1


def test_stream_epochs_are_applied_once(spark, table):
    df = spark.createDataFrame([(1, "a", 0)], SCHEMA)
    table.append(df, txn=("q", 0))
    table.append(df, txn=("q", 0))
    table.append(df, txn=("other", 0))
    table.append(df, txn=("q", 1))
    assert table.count() == 3 and table.last_epoch("q") == 1


def test_compact_and_vacuum(spark, table):
    for i in range(4):
        table.append(spark.range(3).select(F.col("id").cast("int").alias("k"), F.lit(str(i)).alias("v"), F.lit(0).alias("at")))
    before = rows(table.read())
    table.compact()
    assert rows(table.read()) == before
    assert len(table._state(table.latest())[1]) == 1
    assert table.vacuum() > 0
    assert rows(table.read()) == before


def test_empty_rows(spark, table):
    table.append(spark.createDataFrame([], SCHEMA))
    assert table.exists() and table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "a", 0)], SCHEMA), ["k"])
    assert rows(table.read()) == [(1, "a", 0)]


def test_one_winner_for_each_name(spark, tmp_path):
    """Writers that start at a barrier: exactly one creates the file, and what it wrote is what is there."""
    folder, writers, rounds = Folder(spark, str(tmp_path / "race")), 4, 250
    barrier, won = threading.Barrier(writers), [[] for _ in range(rounds)]

    def write(me):
        mine = Folder(spark, folder.uri)
        for r in range(rounds):
            barrier.wait()
            try:
                mine.create_json(f"{r}.json", {"by": me})
                won[r].append(me)
            except AlreadyThere:
                pass

    with ThreadPoolExecutor(writers) as pool:
        list(pool.map(write, range(writers)))
    assert [len(w) for w in won] == [1] * rounds
    assert [folder.read_json(f"{r}.json")["by"] for r in range(rounds)] == [w[0] for w in won]
    assert len(os.listdir(tmp_path / "race")) == rounds, "neither drafts nor checksum files stay"


def test_one_winner_among_processes(spark, tmp_path):
    """Links made by other processes count as well: each name has one winner."""
    folder, rounds = Folder(spark, str(tmp_path / "race")), 200
    folder.fs.mkdirs(folder.path())
    rival = "import os, sys\nwon = 0\nfor r in range(%d):\n    p = f'{sys.argv[1]}/{r}.json'; d = f'{sys.argv[1]}/.rival-{r}'\n    open(d, 'w').write('{\"by\": \"rival\"}')\n    try: os.link(d, p); won += 1\n    except FileExistsError: pass\n    os.remove(d)\nprint(won)" % rounds
    process = subprocess.Popen([sys.executable, "-c", rival, str(tmp_path / "race")], stdout=subprocess.PIPE, text=True)
    mine = 0
    for r in range(rounds - 1, -1, -1):  # the rival comes from the other end, so that they meet
        try:
            folder.create_json(f"{r}.json", {"by": "me"})
            mine += 1
        except AlreadyThere:
            pass
    assert mine + int(process.communicate(timeout=60)[0]) == rounds
    assert sum(folder.read_json(f"{r}.json")["by"] == "me" for r in range(rounds)) == mine


def test_appends_at_once_all_arrive(spark, tmp_path):
    barrier = threading.Barrier(4)
    for n in range(5):
        table = Table(spark, str(tmp_path / f"t{n}"))

        def write(me, uri=table.uri):
            barrier.wait()
            return [Table(spark, uri).append(spark.createDataFrame([(10 * me + i, "a", 0)], SCHEMA)) for i in range(2)]

        with ThreadPoolExecutor(4) as pool:
            versions = [v for vs in pool.map(write, range(4)) for v in vs]
        assert sorted(versions) == list(range(8))
        assert sorted(r["k"] for r in table.read().collect()) == sorted(10 * me + i for me in range(4) for i in range(2))


def test_a_store_without_atomic_creation_is_refused(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "put"))
    with pytest.raises(Exception, match="conditional|Unrecognized|not supported"):
        folder._put(folder.path("x.json"), "{}")
    assert not folder.exists("x.json")


def test_many_files_are_counted_by_a_job(spark, table, monkeypatch):
    from keelson.sources import store

    monkeypatch.setattr(store, "FOOTERS_ON_DRIVER", 0)
    table.append(spark.range(10).select(F.col("id").cast("int").alias("k"), F.lit("x y").alias("v"), (F.col("id") % 2).cast("int").alias("at")), ["v"])
    assert table.count() == 10 and table.read().where("v = 'x y'").count() == 10
