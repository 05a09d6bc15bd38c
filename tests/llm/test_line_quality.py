import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson.llm import line_quality as q
from keelson.llm.queries import ORACLE_SQL, op3_line_quality
from tests.oracle import assert_same

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n




class Sentences:
    """``GOOD % i``: a sentence of eight words that no other has."""

    def __mod__(self, i):
        return " ".join(f"{w}{i}" for w in "the plain words here offend nobody at all".split()) + "."


GOOD = Sentences()
CASES = {
    "null": None,
    "empty": "",
    "blank": " \n\t\n\x0c",
    "prose": "\n".join(GOOD % i for i in range(9)),
    "shouting": "\n".join("BUY!! NOW!! THIS!! IS!! NUMBER%d!! ONLY!! HERE!!" % i for i in range(20)),
    "symbols": " ".join("word%d***" % i for i in range(90)),
    "menu": " | ".join("item%d" % i for i in range(90)),
    "stutter": " ".join(w for i in range(30) for w in ["w%d" % i] * 9),
    "repeats": "a b c d e f " * 30,
    "mostly good": "\n".join([*(GOOD % i for i in range(9)), "Home | News | About | Contact | More", "BUY NOW OR NEVER AGAIN"]),
    "capital letters of other alphabets": "É " * 10 + "\n".join(GOOD % i for i in range(9)),
    "long": " ".join("w%d" % i for i in range(60_000)),
    "boilerplate": "Copyright 2020. All rights reserved.\n" + "\n".join(GOOD % i for i in range(9)),
    "a menu with an item a line": "\n".join([*(f"Item {i} of the menu" for i in range(20)), *(GOOD % i for i in range(6))]),
    "verse": "\n".join(f"drift{i} sand{i} sea{i}," for i in range(20)),
    "four headings in a row": "\n".join([*(f"Chapter {i}" for i in range(4)), *(GOOD % i for i in range(9))]),
    "marks": "\n".join([*("???? !!! ---- .... word%d" % i for i in range(20)), *(GOOD % i for i in range(4))]),
    "teasers": "\n".join([*(f"And then it happened to number {i} ..." for i in range(9)), *(GOOD % i for i in range(4))]),
    "one line again and again": "\n".join(x for i in range(9) for x in (GOOD % i, "Our motto, as ever, is to serve.")),
    "notices": "\n".join([*(f"© {i} die Verfasser dieser Seite, tous droits réservés" for i in range(9)), *(GOOD % i for i in range(6))]),
    "dup lines": "\n".join([GOOD % 1] * 2 + [GOOD % i for i in range(2, 12)] + ["", ""]),
}
KEPT = {"verse", "four headings in a row", "prose", "mostly good", "capital letters of other alphabets", "long", "boilerplate", "dup lines"}


def test_measures_and_verdicts(spark):
    rows = [(i, t) for i, t in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "kept": F.lit("clash")})
    got = {r["doc_id"]: r for r in q.quality(df).collect()}
    for i, (name, text) in enumerate(CASES.items()):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), name
        assert r["kept"] == (name in KEPT), name


def test_repeated_words_with_a_large_vocabulary(monkeypatch):
    words = [b"w%d" % (i % 7) for i in range(50)] + [b"x%d" % i for i in range(30)]
    assert q.repeated_words(words) == brute(" ".join(w.decode() for w in words))[4]


def test_lines_that_fail_are_removed(spark):
    df = spark.createDataFrame([(1, CASES["mostly good"], "x", 7), (2, CASES["menu"], "y", 8), (None, CASES["prose"], None, 9), (None, CASES["prose"], None, 9)], "doc_id long, text string, lang string, n_words int")
    got = q.keep_good(df)
    assert got.columns == df.columns
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted([(1, "\n".join(GOOD % i for i in range(9)), "x", 7)] + [(None, CASES["prose"], None, 9)] * 2, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality(df).count() == 0 and q.keep_good(df).count() == 0


def test_query_equals_brute_force_and_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in op3_line_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(d["text"])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_verdicts_agree_with_labels(spark, sf_dir, sf):
    where = sf_dir.rsplit("/", 1)[0] + "/" + sf
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    rows = [r for r in op3_line_quality(spark, where).collect() if r["doc_id"] in labels and not r["base_failed"]]
    right = sum(r["kept"] == (labels[r["doc_id"]] == 1) for r in rows)
    assert right >= 0.98 * len(rows) and rows


def test_query_equals_sql(spark, sf_dir):
    assert_same(op3_line_quality(spark, sf_dir), ORACLE_SQL["op3_line_quality"], sf_dir)
