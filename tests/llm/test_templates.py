import random

import pytest
from pyspark.sql import functions as F

from keelson.llm import templates as t
from keelson.llm.queries import op4_template_decontamination

ITEM = "A train leaves Boston at 60 km per hour and drives for 3 hours toward the coast. How many kilometres has it gone when Alice gets off after 45 minutes?"
OTHER = "A train leaves Denver at 75 km per hour and drives for 8 hours toward the coast. How many kilometres has it gone when Peter gets off after 20 minutes?"
FILLER = "Nothing in this passage has anything to do with vehicles of any kind, only with weather and birds. "


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "h": F.lit("x"), "item": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(3))
    return {(r["id"], r["item"]): r for r in t.contaminated(d, b, **options).collect()}


def brute(docs, items, coverage=0.8):
    def parts(text):
        """{position: forms of the window there}"""
        out = {}
        for names in (True, False):
            tokens, values = t.canonical(text, names)
            n = max(1, len(tokens) - t.WIDTH + 1) if tokens else 0
            for k in range(n):
                span = range(k, min(k + t.WIDTH, len(tokens)))
                if sum(j not in values for j in span) >= min(t.LEAST_LITERALS, len(tokens)):
                    out.setdefault(k, set()).add(tuple(tokens[j] for j in span))
        return out

    found = set()
    for i, text in docs:
        mine = {w for forms in parts(text).values() for w in forms}
        for j, item in items:
            theirs = parts(item)
            if theirs and sum(bool(forms & mine) for forms in theirs.values()) >= coverage * len(theirs):
                found.add((i, j))
    return found


def test_copies_and_reparameterised_questions_are_caught(spark):
    docs = [(1, FILLER + ITEM + " " + FILLER), (2, FILLER + OTHER), (3, FILLER * 3), (4, ITEM.upper()), (5, ITEM[:60]), (6, None), (7, "")]
    got = run(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "1 2 3 4 5 6")])
    assert (1, 10) in got and not got[1, 10]["reparameterised"]
    assert (2, 10) in got and got[2, 10]["reparameterised"] and got[2, 10]["slot_agreement"] == 1.0
    assert {i for i, _ in got} <= {1, 2, 4}


def test_copies_that_lost_or_got_capitals(spark):
    item = "The quiet river near Old Harrow bends twice before Lower Pine and then, past Mill Lane, meets the sea"
    docs = [(1, item.lower()), (2, "so we read, " + item + " again"), (3, item.upper()), (4, item.title())]
    got = run(spark, docs, [(5, item)])
    assert {i for i, _ in got} >= {1, 2, 3}
    assert got[2, 5]["coverage"] == 1.0


def test_inconsistent_slots_are_refused(spark):
    item = "first add 7 to the pile then take 7 from the heap and again put 7 on the stack before 7 are left on the floor"
    same = item.replace("7", "9")
    mixed = item
    for n in ("1", "2", "3", "4"):
        mixed = mixed.replace("7", n, 1)
    got = run(spark, [(1, same), (2, mixed)], [(5, item)])
    assert set(got) == {(1, 5)}


def test_one_consistent_occurrence_is_enough(spark):
    more = ITEM.replace("60", "12").replace("3 hours", "9 hours").replace("45", "31").replace("Alice", "Maria").replace("Boston", "Dallas")
    docs = [(1, f"{ITEM} {OTHER}"), (2, f"{FILLER}{OTHER}\n{FILLER}{more}\n{FILLER}{ITEM}"), (3, " ".join([OTHER, more] * 20)), (4, FILLER)]
    got = run(spark, docs, [(9, ITEM)])
    assert set(got) == {(1, 9), (2, 9), (3, 9)}
    assert [got[i, 9]["reparameterised"] for i in (1, 2, 3)] == [False, False, True]
    assert all(r["slot_agreement"] == 1.0 for r in got.values())


def test_an_item_that_repeats_its_windows_with_other_values(spark):
    item = " ".join(f"then add exactly {n} grams of salt to the pot" for n in (1, 2, 3, 4, 5))
    got = run(spark, [(1, f"{FILLER}{item}"), (2, FILLER)], [(5, item)])
    assert set(got) == {(1, 5)} and not got[1, 5]["reparameterised"]


def test_a_long_passage_of_an_item_is_enough(spark):
    context = " ".join(f"fact{i}x about place{i * 7}y" for i in range(60))
    question = "Which of the two old towers beside the river was built first and by whose order was it raised?"
    words = ITEM.split()
    docs = [(1, FILLER + question + " " + FILLER), (2, FILLER + " ".join(words[8:]) + " " + FILLER), (3, " ".join(words[:9]) + " " + FILLER + " ".join(words[18:26])), (4, FILLER)]
    got = run(spark, docs, [(7, f"{context} {question}"), (8, ITEM + " " + context)])
    assert set(got) == {(1, 7), (2, 8)}
    assert all(r["coverage"] < 0.8 for r in got.values())


def test_canonical_tokens():
    tokens, values = t.canonical("On Monday, we saw Anna pay $3.50 for 5km (or 7 miles), 20% more. \x01 Then")
    assert b" ".join(tokens) == b"on \x01p we saw \x01p pay \x01n \x01u for \x01n \x01u or \x01n \x01u \x01n \x01u more then"
    assert (values[1], values[4], values[6]) == (b"pmonday", b"panna", b"n350")
    plain, _ = t.canonical("we saw Anna pay", names=False)
    assert plain == [b"we", b"saw", b"anna", b"pay"]
    assert t.canonical(None) == ([], {}) and t.canonical(" \n") == ([], {})


def test_short_items_match_only_equal_documents(spark):
    got = run(spark, [(1, "Red green blue."), (2, "red green blue and more words than five here")], [(9, "red, green, blue")])
    assert set(got) == {(1, 9)}


def test_repeats_null_ids_and_many_occurrences(spark):
    docs = [(None, ITEM), (None, FILLER), (3, ITEM + "\n" + (FILLER + ITEM + "\n") * 50), (3, FILLER)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("content", F.lit("clash"))
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, OTHER)], "item_id long, text string")
    kept = t.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["text"]) for r in kept.collect()) == [(False, FILLER), (True, FILLER)]


@pytest.mark.parametrize("docs, items", [([], [(1, ITEM)]), ([(1, ITEM)], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == {}


def test_a_long_text(spark):
    long = " ".join(f"w{i}x" for i in range(100_000))
    assert set(run(spark, [(1, long + " " + ITEM), (2, long)], [(7, ITEM)])) == {(1, 7)}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op4_template_decontamination(spark, sf_dir).collect()}
    assert got == brute(docs, items)
    assert {(i, j) for i, text in docs for j, item in items if item in text} <= got


def test_a_window_that_everyone_shares_meets_no_pairs(spark):
    """Items and documents that share one phrase are not paired for it; a whole item still is found."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    phrase = "which of the following is the right answer here"
    items = [(i, f"{words(20)} {phrase} {words(20)}") for i in range(40)]
    docs = [(i, f"{words(30)} {phrase} {words(30)}") for i in range(60)] + [(100 + i, f"{words(10)} {items[i][1]} {words(10)}") for i in range(40)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").withColumns({"__id": F.lit(1), "__content": F.lit("x"), "row": F.lit(2), "h": F.lit(3)})
    benchmark, table = frame(items, "item_id"), frame(docs, "doc_id")
    found = t.contaminated(table, benchmark).collect()
    assert sorted((r["id"], r["item"]) for r in found) == [(100 + i, i) for i in range(40)]
    left = t.decontaminate(table, benchmark)
    assert left.columns == table.columns and sorted(r["doc_id"] for r in left.collect()) == list(range(60))
    windows = t._explode_windows(benchmark, "item_id", "text", 5, 3, None).distinct()
    needed = windows.groupBy("row").agg(F.count_distinct("pos").alias("item_windows"))
    telling = t._telling(windows, needed, t.COVERAGE, t.RUN)
    shared = windows.groupBy("h").agg(F.count_distinct("row").alias("n")).where("n > 1").select("h")
    assert shared.count() >= 5 and telling.join(shared, "h", "left_semi").count() == 0


def test_telling_windows_are_in_every_match(spark):
    """Any 80 % of an item's windows, and any 11 in a row, hold a telling one."""
    rng = random.Random(8)
    for n in (1, 2, 4, 5, 9, 10, 30, 63):
        text = " ".join(f"w{rng.randrange(40)}x" for _ in range(n + 4))
        windows = t._explode_windows(spark.createDataFrame([(1, text)], "item_id long, text string"), "item_id", "text", 5, 3, None).distinct()
        needed = windows.groupBy("row").agg(F.count_distinct("pos").alias("item_windows"))
        telling = {r["h"] for r in t._telling(windows, needed, t.COVERAGE, t.RUN).collect()}
        places = {r["pos"]: r["h"] in telling for r in windows.collect()}
        without = [p for p, told in places.items() if not told]
        assert len(without) < t.COVERAGE * len(places)
        order = sorted(places)
        assert all(any(places[p] for p in order[k : k + t.RUN]) for k in range(len(order) - t.RUN + 1))
