"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects the same number of copies, target / size of
the source.  Documents are put in one order, the expected copies are summed along
it within each source, one random offset is added, and a document is taken once
for each integer boundary its interval crosses.  The order is (source, stripe,
size, hash of the id, id), sizes rising in even stripes and falling in odd ones:
neighbours have like sizes, so the words taken come close to the target.  A
stripe is about STRIPE_ROWS documents of a source, drawn by hash; each has
documents of every size, so that no task gets all the long ones.

The prefix sum is distributed: the order is made by range partitioning, so a
source that holds a third of all rows spreads over many tasks, and each task's
part of a source starts at an offset that is a sum over the tasks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.scratch import materialize
from keelson.llm.words import WORD_PATTERN

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = 20240229
STRIPE_ROWS = 1024
#: monotonically_increasing_id() is the task's number times 2^33 plus the row's place in the task.
PLACE_BITS = 33


def n_words(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draw(seed: int, what: str, value: Column) -> Column:
    """52 hashed bits of a value, the same in every engine that has MD5."""
    text = F.concat(F.lit(f"{seed}:{what}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _ordered(df: DataFrame, label: str, *keys: Column) -> DataFrame:
    """``df`` in one global order of ``keys``, written, with __task and __place (0, 1, …) of each row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    spot = F.monotonically_increasing_id()
    written = materialize(dealt.withColumn("__spot", spot), label)
    task = F.shiftright("__spot", PLACE_BITS)
    return written.withColumn("__task", task).withColumn("__place", F.col("__spot") - F.shiftleft(task, PLACE_BITS)).drop("__spot")


def _targets(sizes: DataFrame, weights, share_percent: int, most: int) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    With the level L, a source gets min(most * size, L * weight).  L is found by
    sharing the total by weight, capping, and sharing the excess again until no
    source is above its cap: each round is one aggregate, and two numbers reach the driver."""
    known = _ordered(sizes, "mix-sources", F.col("source").asc_nulls_last())
    before = known.groupBy("__task").agg(F.count("*").alias("n"))
    # one row per task of a bounded number of tasks
    starts = before.select("__task", (F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("start") + F.col("__place")) % len(weights) + 1).cast("int"))
    known = known.join(starts, "__task").select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    known = materialize(known, "mix-weights")
    share = known.agg(F.sum("source_size")).first()[0] or 0
    total = share * share_percent / 100
    level = 0.0
    while True:
        open_ = F.col("cap") > F.lit(level) * F.col("weight")
        capped, rest = known.agg(F.sum(F.when(~open_, F.col("cap")).otherwise(0)), F.sum(F.when(open_, F.col("weight")).otherwise(0))).first()
        if not rest:
            break
        raised = (total - capped) / rest
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return known.select("source", "source_size", target.alias("target"))


def mix(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``sized`` with source_size, target and copies of every row.

    ``size_col`` is a column of longs.  Sources are ordered by code point, NULL
    last, and take the weights in turn.  The sizes' sum times ``share_percent`` / 100
    is shared by weight; a target stops at ``most`` times its source's size.  No row
    gets more than ``most`` copies.  Reruns give the same copies: the order ends in
    the id, and rows that tie in it are repeated rows of one document, which of
    them gets a copy makes no difference.  A source without words has target 0, its
    rows no copies.  An empty table gives an empty result.  Input columns named
    source_size, target or copies are replaced; others may have any name.
    """
    carried = [c for c in sized.columns if c not in ("source_size", "target", "copies")]
    # what the caller's columns are called doesn't matter inside a struct
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("__row")
    base = sized.select(row, *[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "__id"), (source_col, "__src"), (size_col, "__size"))])
    id_col, source_col, size_col = "__id", "__src", "__size"
    spark = sized.sparkSession
    tie = draw(seed, "tie", F.col(id_col))
    counted = base.groupBy(F.col(source_col).alias("__of")).agg(F.ceil(F.count("*") / STRIPE_ROWS).alias("__stripes"))
    counted = materialize(counted, "mix-stripes")  # its size is known now, so Spark broadcasts it only if it is small
    base = base.join(counted, F.col(source_col).eqNullSafe(F.col("__of")))
    stripe = draw(seed, "stripe", F.col(id_col)) % F.col("__stripes")
    along_size = F.when(stripe % 2 == 0, F.col(size_col)).otherwise(-F.col(size_col))
    base = _ordered(base, "mix-order", F.col(source_col).asc_nulls_last(), stripe, along_size, tie, F.col(id_col))
    parts = base.groupBy(F.col(source_col).alias("source"), "__task").agg(F.count("*").alias("rows"), F.sum(size_col).alias("words"), F.min("__place").alias("first"))
    parts = materialize(parts, "mix-parts")  # a row for each source and for each further task it spreads over
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = _targets(sizes, weights, share_percent, most)
    along = Window.partitionBy("source").orderBy("__task").rowsBetween(Window.unboundedPreceding, 0)
    starts = parts.select("source", "__task", (F.sum("rows").over(along) - F.col("rows") - F.col("first")).alias("start"))
    offset = (draw(seed, "offset", F.col("t.source")) + F.lit(0.5)) / F.lit(float(1 << 52))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    facts = facts.select(F.col("t.source").alias("__source"), F.col("__task").alias("__at"), "start", "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    facts = materialize(facts, "mix-facts")  # its size is known now, so Spark broadcasts it only if it is small
    found = base.join(facts, base[source_col].eqNullSafe(F.col("__source")) & (F.col("__task") == F.col("__at")))
    rank = F.col("start") + F.col("__place")
    crossed = F.floor((rank + 1) * F.col("rate") + F.col("offset")) - F.floor(rank * F.col("rate") + F.col("offset"))
    copies = F.when(F.col(size_col) > 0, F.least(crossed, F.lit(most))).otherwise(crossed * 0)
    return found.select("__row.*", "source_size", "target", copies.cast("long").alias("copies"))


def sizes_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size): a narrow table, so that the order moves no text."""
    return materialize(docs.select(F.col(id_col), F.col(source_col).cast("string").alias(source_col), n_words(F.col(text_col).cast("string")).alias("size")), "mix-sizes")


def emit(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: ``docs`` with each row repeated as often as it is taken.

    The order is made of ids, sources and sizes; texts move once, when they meet
    their copies.  Rows are known by their id and a hash of all their columns (but
    maps, which have none), so of equal rows one stands for all their copies.  NULL
    sources are a source; NULL and empty texts have no words and are never taken;
    columns may have any names; an empty table gives an empty result."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    key = {"id": F.col(f"`{id_col}`"), "content": F.xxhash64(*hashed)}
    narrow = docs.select(*[c.alias(n) for n, c in key.items()], F.col(f"`{source_col}`").cast("string").alias("of"), n_words(F.col(f"`{text_col}`").cast("string")).alias("size"))
    taken = mix(materialize(narrow, "mix-sizes"), "id", "of", "size", **options)
    copies = materialize(taken.groupBy("id", "content").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "mix-copies")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in key.items()]).alias("doc")

    def repeated(rows: DataFrame, counts: DataFrame) -> DataFrame:
        counts = counts.alias("many")
        met = rows.join(counts, F.col("doc.id").eqNullSafe(F.col("many.id")) & (F.col("doc.content") == F.col("many.content")))
        return met.select("doc.row", F.explode(F.array_repeat(F.lit(1), F.col("many.copies").cast("int")))).select("row.*")

    once, many = copies.where("rows = 1"), copies.where("rows > 1")
    out = repeated(named, once)
    if many.isEmpty():
        return out
    alike = named.join(many.alias("many"), F.col("doc.id").eqNullSafe(F.col("many.id")) & (F.col("doc.content") == F.col("many.content")), "left_semi")
    return out.unionByName(repeated(alike.groupBy("id", "content").agg(F.first("row").alias("row")).alias("doc"), many))
