import difflib
import random

from pyspark.sql import functions as F

from keelson.functions import similarity as sim


def reference_score(pairs):
    return sum(difflib.SequenceMatcher(None, str(a).lower(), str(b).lower()).ratio() for a, b in pairs if a and b) * 100 / len(pairs)


def test_multi_similarity_equals_difflib(spark):
    rng = random.Random(1)
    word = lambda: rng.choice([None, "", "Rahool", "rahul", "Guptha", "gupta", "x" * 250 + "ab", "ab" + "x" * 250, "0"])
    rows = [(word(), word(), word(), word()) for _ in range(120)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = df.select(sim.multi_similarity([(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))]).alias("s")).collect()
    for r, (a, b, c, d) in zip(got, rows, strict=True):
        real = [(None if x == "0" else x, None if y == "0" else y) for x, y in ((a, b), (c, d))]
        assert abs(r["s"] - reference_score(real)) < 1e-9


def test_order_of_arguments_matters_and_all_missing_is_zero(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(sim.multi_similarity([(F.col("a"), F.col("b"))])).collect()]
    assert got[0] == 25.0 and got[1] == 50.0 and got[2] == 0.0


def test_weighted(spark):
    df = spark.createDataFrame([("Ann", "Ann", "a@b", "a@b", "1", "1", 7, 7), ("Ann", "ann", None, "x", "12", "21", 7, 8)], "a string, b string, c string, d string, e string, f string, g int, h int")
    pairs = [(F.col(x), F.col(y)) for x, y in ("ab", "cd", "ef", "gh")]
    full, part = (r[0] for r in df.select(sim.weighted_similarity(*pairs)).collect())
    assert abs(full - 100) < 1e-9
    expected = 30 * difflib.SequenceMatcher(None, "Ann", "ann").ratio() + 30 * difflib.SequenceMatcher(None, "12", "21").ratio()
    assert abs(part - expected) < 1e-9
