import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_imports_without_the_optional_operators():
    code = "import sys; sys.modules['keelson.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_the_optional_operators():
    for p in (REPO / "keelson").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "keelson.llm" not in p.read_text(), p


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
import __spark_entry__ as e
assert e.queries()["similarity_ratio"](s, "/root/testdata/sf0.001").count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=180)


def test_a_missing_library_is_an_error_not_a_missing_operator():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "xxhash" in done.stderr
