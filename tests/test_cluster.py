"""What local mode hides: a driver and executors that are JVMs of their own."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from keelson.plans import catalog

spark = SparkSession.builder.master("local-cluster[2,1,1000]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false")
spark = spark.config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
nulls = spark.createDataFrame([(1, None, 1.5), (None, "it's", None)], 'id long, `a "b` string, x double')
url = catalog.derby_database(spark, nulls, "odd")
odd = spark.read.format("jdbc").options(url=url, dbtable="odd", driver=catalog.DERBY).load()
assert odd.dtypes == nulls.dtypes and {tuple(r) for r in odd.collect()} == {tuple(r) for r in nulls.collect()}
for _ in range(2):
    got, want = catalog.jdbc_scan(spark, sys.argv[1]), spark.read.parquet(sys.argv[1] + "/nation.parquet")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
spark.stop()
print("all rows")
"""


def test_jdbc_scan_on_executors(sf_dir, tmp_path):
    """The database is read by JVMs that didn't write it."""
    done = subprocess.run([sys.executable, "-c", SCRIPT, sf_dir, str(tmp_path)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("all rows"), done.stderr[-3000:]
