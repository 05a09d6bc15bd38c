"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, the rest is lower-cased and
stripped of punctuation, and windows of five canonical tokens are hashed: a
question with other numbers or names has the same windows.  Names are known by
their capital inside a sentence, which copies may have lost or got (a passage
pasted into a sentence, lower-cased text), so a window that holds a name is also
hashed with the name as a plain word.  Windows of documents and benchmark meet
in a hash join.  A document is contaminated by an item if it holds at least 80 %
of the item's windows and fills the item's slots consistently: each value of the
item stands for one value of the document.  Values are first judged over all
windows of the document at once; a pair refused there is judged again by each
place where the item occurs, as a document may hold an item several times with
other values, and one consistent occurrence is enough.  A long passage of an item
is enough too: RUN windows in a row with consistent slots, 15 words or more.

Before the join, documents drop the windows that cannot match by a Bloom filter
over the benchmark's windows.  Its size is bounded; a benchmark beyond that only
lets more windows through to the join, which is exact.

A window that many items and many documents share would join to all their pairs.
So pairs are first met by an item's telling windows alone: its rarest ones, one
more than a contaminated document may lack, and the rarest of each stretch that
every passage holds whole.  No pair that can be contaminated lacks all of them.
The other windows are then counted for these pairs only.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keelson.llm.bloom import bloom_filter, bloom_holds
from keelson.llm.scratch import materialize, small_batches
from keelson.llm.words import HASH_SEED

WIDTH = 5
COVERAGE = 0.8
AGREEMENT = 0.8
LEAST_LITERALS = 3
#: Windows in a row that make a passage of an item: 15 words.
RUN = 11
#: How far the windows of one occurrence may be moved against each other, as a share of the item's windows.
SLACK = 0.25
SLOT = b"\x01"
UNITS = "%|°c|°f|km/h|mph|km|cm|mm|kg|mg|ml|kb|mb|gb|tb|hz|khz|mhz|ghz|kw|kwh|miles?|feet|foot|inch(?:es)?|yards?|pounds?|ounces?|grams?|metres?|meters?|lit(?:re|er)s?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|gbp|percent|degrees?"
NUMBER = re.compile(rf"(?<![\w.])([$€£¥]?)(\d+(?:[.,:/]\d+)*)(?:\s?({UNITS})(?!\w))?", re.IGNORECASE)
#: A capitalised word inside a sentence.
NAME = re.compile(r"(?<=[a-zß-öø-ÿ,;] )([A-ZÀ-ÖØ-Þ][^\W\d_][\w'’-]*)")
PUNCTUATION = b".,;:!?\"'()[]{}<>|*#&%$/\\-_=+~`^@"


def _number(m: re.Match) -> str:
    unit = (m[1] or m[3] or "").lower()
    return f" \x01n{m[2]} " + (f"\x01u{unit} " if unit else "")


def canonical(text: str | None, names: bool = True) -> tuple[list[bytes], dict[int, bytes]]:
    """Canonical tokens, and the value of each placeholder by position; without ``names``
    names are plain words, and the tokens as many as with them."""
    text = (text or "").replace("\x01", " ")
    if names:
        text = NAME.sub("\x01p\\1", text)
    text = NUMBER.sub(_number, text)
    tokens = text.lower().encode("utf-8", "replace").translate(None, PUNCTUATION).split()
    values: dict[int, bytes] = {}
    if SLOT in b"".join(tokens):
        for i, t in enumerate(tokens):
            if t[:1] == SLOT:
                values[i], tokens[i] = t[1:], t[:2]
    return tokens, values


def windows(tokens: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The signed hash of every window; of the whole if there are fewer tokens."""
    if not tokens:
        return np.zeros(0, np.int64)
    n = max(1, len(tokens) - width + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(width, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n).view(np.int64)


def placed_windows(text: str | None, width: int, least_literals: int, wanted=None):
    """(position, hash, slots) of the windows of a text, those with names in both forms,
    that have enough literal tokens and whose hashes ``wanted`` (hashes to positions) picks."""
    tokens, values = canonical(text)
    forms = [(tokens, values)]
    if any(v[:1] == b"p" for v in values.values()):
        forms.append(canonical(text, names=False))
    for tokens, values in forms:
        h = windows(tokens, width)
        for k in range(len(h)) if wanted is None else wanted(h):
            span = range(k, min(k + width, len(tokens)))
            filled = tuple(values[x] for x in span if x in values) if values else ()
            if len(span) - len(filled) >= min(least_literals, len(tokens)):
                yield k, int(h[k]), filled


def _window_rows(width: int, least_literals: int, bloom):
    """(row, text) to (row, pos, h, slots).  With a filter only windows that may be in the
    benchmark, each hash with the same slots once."""

    def run(batches):
        wanted = None
        if bloom is not None:
            bits = np.frombuffer(bloom.value, np.uint8)

            def wanted(h):
                return np.flatnonzero(bloom_holds(bits, h)).tolist()

        for batch in batches:
            at, places, hs, slots = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                seen = set()
                for k, h, filled in placed_windows(text, width, least_literals, wanted):
                    key = (h, filled) if wanted else (k, h)
                    if key not in seen:
                        seen.add(key)
                        at.append(i)
                        places.append(k)
                        hs.append(h)
                        slots.append([v.decode("utf-8", "replace") for v in filled])
            row = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.record_batch([row, pa.array(places, pa.int64()), pa.array(hs, pa.int64()), pa.array(slots, pa.list_(pa.string()))], ["row", "pos", "h", "slots"])

    return run


def _explode_windows(df: DataFrame, id_col: str, text_col: str, width: int, least_literals: int, bloom) -> DataFrame:
    small_batches(df.sparkSession)
    text = F.col(text_col).cast("string")
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("content")).alias("row"), text.alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("pos", T.LongType()), T.StructField("h", T.LongType()), T.StructField("slots", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(_window_rows(width, least_literals, bloom), schema)


def _telling(items: DataFrame, needed: DataFrame, coverage: float, run: int) -> DataFrame:
    """(item, h) of the windows by which pairs are met: of any ``coverage`` of an item's
    windows, and of any ``run`` in a row, at least one is among them."""
    shared = items.groupBy("h").agg(F.count_distinct("row").alias("in_items"))
    places = items.join(shared, "h").groupBy("row", "pos").agg(F.max("in_items").alias("in_items"))
    by_place, rarest = Window.partitionBy("row").orderBy("pos"), [F.col("in_items"), F.col("pos")]
    stretch = F.floor((F.row_number().over(by_place) - 1) / ((run + 1) // 2))
    places = places.withColumn("stretch", stretch).join(needed, "row")
    of_stretch = F.row_number().over(Window.partitionBy("row", "stretch").orderBy(*rarest))
    of_item = F.row_number().over(Window.partitionBy("row").orderBy(*rarest))
    spare = F.col("item_windows") - F.ceil(F.col("item_windows") * F.lit(coverage))
    chosen = places.withColumns({"of_stretch": of_stretch, "of_item": of_item}).where((F.col("of_stretch") == 1) | (F.col("of_item") <= spare + 1))
    return items.join(chosen.select("row", "pos"), ["row", "pos"]).select(F.col("row").alias("item"), "h").distinct()


@lru_cache(maxsize=256)
def _item_windows(text: str, width: int, least_literals: int) -> list[tuple]:
    return list(placed_windows(text, width, least_literals))


def _agreement(uses: Counter) -> tuple[int, float, bool]:
    """(uses of slots, share of those that give each item value its commonest document value,
    whether a value differs) of the uses of (item value, document value)."""
    best: Counter = Counter()
    for (of, _), n in uses.items():
        best[of] = max(best[of], n)
    total = sum(uses.values())
    return total, sum(best.values()) / total if total else 1.0, any(a != b for a, b in uses)


def consistent_occurrence(text: str | None, item_text: str | None, width: int = WIDTH, coverage: float = COVERAGE, agreement: float = AGREEMENT, least_literals: int = LEAST_LITERALS) -> tuple[int, float, bool] | None:
    """(uses of slots, agreement, whether a value differs) of the most consistent occurrence
    of an item in a text, None if none is consistent.

    An occurrence begins at a place of the text and takes for each window of the item
    the equal window nearest to where it should be, not farther than SLACK.  A text
    that holds 80 % of the windows with the item's own values is one at any order."""
    item = _item_windows(item_text or "", width, least_literals)
    least = coverage * len({k for k, _, _ in item})
    sought = np.array(sorted({h for _, h, _ in item}), np.int64)
    places: dict[int, list] = defaultdict(list)
    for p, h, filled in placed_windows(text, width, least_literals, lambda hs: np.flatnonzero(np.isin(hs, sought)).tolist()):
        places[h].append((p, filled))
    found = [(k, h, filled) for k, h, filled in item if h in places]
    if not found:
        return None
    at = {h: np.array([p for p, _ in spots], np.int64) for h, spots in places.items()}
    own = {(h, filled) for h, spots in places.items() for _, filled in spots}
    if len({k for k, h, filled in found if (h, filled) in own}) >= least:
        return sum(len(filled) for _, _, filled in found), 1.0, False
    first = max(k for k, _, _ in found)
    starts = np.zeros(first + 1 + max(int(ps[-1]) for ps in at.values()), np.int64)
    for k, h, _ in found:
        starts[at[h] - k + first] += 1
    slack = max(width, int(SLACK * len(item)))
    upto = np.concatenate(([0], np.cumsum(starts)))
    here = np.flatnonzero(starts)
    near = upto[np.minimum(here + slack + 1, len(starts))] - upto[np.maximum(here - slack, 0)]
    best = None
    for start in (here[near >= least] - first).tolist():
        uses: Counter = Counter()
        matched = set()
        for k, h, filled in found:
            spots, wish = places[h], start + k
            i = bisect_left(spots, wish, key=lambda x: x[0])
            i = min((j for j in (i - 1, i) if 0 <= j < len(spots)), key=lambda j: abs(spots[j][0] - wish))
            if abs(spots[i][0] - wish) <= slack:
                matched.add(k)
                uses.update(zip(filled, spots[i][1], strict=True))
        if len(matched) >= least:
            judged = _agreement(uses)
            if judged[1] >= agreement and (best is None or (judged[1], not judged[2]) > (best[1], not best[2])):
                best = judged
    return best


def consistent_run(text: str | None, item_text: str | None, run: int = RUN, width: int = WIDTH, agreement: float = AGREEMENT, least_literals: int = LEAST_LITERALS) -> tuple[int, float, bool] | None:
    """As consistent_occurrence, for the first passage of ``run`` windows that text and item
    have in a row.  Windows that don't count don't end a passage if those around them overlap or meet."""
    item = _item_windows(item_text or "", width, least_literals)
    counting = sorted({k for k, _, _ in item})
    before = {b: a for a, b in zip(counting, counting[1:]) if b - a <= width}
    sought = np.array(sorted({h for _, h, _ in item}), np.int64)
    by_hash = defaultdict(list)
    for k, h, filled in item:
        by_hash[h].append((k, filled))
    lines: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for p, h, filled in placed_windows(text, width, least_literals, lambda hs: np.flatnonzero(np.isin(hs, sought)).tolist()):
        for k, own in by_hash[h]:
            lines[p - k][k] += zip(own, filled, strict=True)
    for _, line in sorted(lines.items()):
        passage: list[int] = []
        for k in sorted(line):
            passage = [*passage[1 - run :], k] if passage and before.get(k) == passage[-1] else [k]
            if len(passage) >= run:
                judged = _agreement(Counter(use for j in passage[-run:] for use in line[j]))
                if judged[1] >= agreement:
                    return judged
    return None


def _judged_again(width: int, coverage: float, agreement: float, least_literals: int, run_windows: int):
    """(row, item, text, item_text) to (row, item, n_slots, slot_agreement, reparameterised) of the pairs with a consistent occurrence or passage."""

    def judge(text, item_text):
        whole = consistent_occurrence(text, item_text, width, coverage, agreement, least_literals)
        return whole or consistent_run(text, item_text, run_windows, width, agreement, least_literals)

    def run(batches):
        for batch in batches:
            found = [judge(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            n, share, moved = zip(*filter(None, found), strict=True) if len(at) else ((), (), ())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array(moved, pa.bool_())], ["row", "item", "n_slots", "slot_agreement", "reparameterised"])

    return run


def _keyed_texts(df: DataFrame, id_col: str, text_col: str, key: str, name: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("content")).alias(key), text.alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, coverage: float = COVERAGE, agreement: float = AGREEMENT, least_literals: int = LEAST_LITERALS, run: int = RUN) -> DataFrame:
    """Contaminated pairs: (id, content, item, item_windows, matched_windows, coverage, n_slots, slot_agreement, reparameterised).

    A document is a pair of id and text, so rows without an id are told apart by
    their text and repeated rows give one result.  Windows with fewer than
    ``least_literals`` tokens that are no placeholders don't count.  Items
    without windows (NULL, empty, all placeholders) contaminate nothing; items
    of fewer than five tokens only documents of the same tokens.  Pairs below
    ``coverage`` are there by a passage of ``run`` windows in a row.  Texts of any
    length are read whole.  An empty table on either side gives an empty result.
    Other columns, whatever their names, are not read.
    """
    items = materialize(_explode_windows(benchmark, item_col, item_text_col, width, least_literals, None).distinct(), "benchmark-windows")
    needed = items.groupBy("row").agg(F.count_distinct("pos").alias("item_windows"))
    hits = _explode_windows(docs, id_col, text_col, width, least_literals, bloom_filter(items.select("h").distinct())).drop("pos")
    hits = materialize(hits, "document-windows")
    candidates = hits.select("row", "h").distinct().join(materialize(_telling(items, needed, coverage, run), "telling-windows"), "h")
    candidates = materialize(candidates.select("row", "item").distinct(), "candidate-pairs")
    sides = items.select(F.col("row").alias("item"), "pos", "h", F.col("slots").alias("item_slots"))
    met = materialize(hits.join(candidates, "row").join(sides, ["item", "h"]), "window-matches")
    counted = met.groupBy("row", "item").agg(F.count_distinct("pos").alias("matched_windows"))
    counted = counted.join(needed.withColumnRenamed("row", "item"), "item").withColumn("coverage", F.col("matched_windows") / F.col("item_windows"))
    pairs = materialize(counted.where((F.col("coverage") >= coverage) | (F.col("matched_windows") >= run)), "covered-items")
    filled = met.join(pairs.select("row", "item"), ["row", "item"]).select("row", "item", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    uses = filled.groupBy("row", "item", F.col("s.item_slots").alias("of"), F.col("s.slots").alias("is")).agg(F.count("*").alias("n"))
    by_value = uses.groupBy("row", "item", "of").agg(F.max("n").alias("best"), F.sum("n").alias("n"), F.max((F.col("of") != F.col("is")).cast("int")).alias("moved"))
    slots = by_value.groupBy("row", "item").agg(F.sum("n").alias("n_slots"), (F.sum("best") / F.sum("n")).alias("slot_agreement"), F.max("moved").alias("moved"))
    found = pairs.join(slots, ["row", "item"], "left").withColumns({"n_slots": F.coalesce("n_slots", F.lit(0)), "slot_agreement": F.coalesce("slot_agreement", F.lit(1.0)), "reparameterised": F.coalesce(F.col("moved") > 0, F.lit(False))})
    found = materialize(found, "judged-pairs")
    clear = (F.col("coverage") >= coverage) & (F.col("slot_agreement") >= agreement)
    refused, found = found.where(~clear), found.where(clear)
    if not refused.isEmpty():
        refused = materialize(refused.drop("n_slots", "slot_agreement", "reparameterised", "moved"), "refused-pairs")
        texts = refused.select("row", "item").join(_keyed_texts(benchmark, item_col, item_text_col, "item", "item_text").distinct(), "item")
        texts = _keyed_texts(docs, id_col, text_col, "row", "text").join(texts, "row").select("row", "item", "text", "item_text")
        kinds = [texts.schema[c] for c in ("row", "item")]
        schema = T.StructType([*kinds, T.StructField("n_slots", T.LongType()), T.StructField("slot_agreement", T.DoubleType()), T.StructField("reparameterised", T.BooleanType())])
        again = texts.mapInArrow(_judged_again(width, coverage, agreement, least_literals, run), schema).distinct()
        found = found.drop("moved").unionByName(refused.join(again, ["row", "item"]))
    return found.select(F.col("row.id").alias("id"), F.col("row.content").alias("content"), F.col("item.id").alias("item"), "item_windows", "matched_windows", "coverage", "n_slots", "slot_agreement", "reparameterised")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated documents, with all its columns, whatever their names.

    Rows without a text, an empty one among them, hold no item and stay; of repeated
    rows all go or all stay; rows without an id are told apart by their texts."""
    found = contaminated(docs, benchmark, id_col, text_col, **options)
    gone = materialize(found.select("id", "content").distinct(), "contaminated").alias("gone")
    named = docs.alias("doc")
    content = F.xxhash64(F.col(f"doc.`{text_col}`").cast("string"))
    return named.join(gone, F.col(f"doc.`{id_col}`").eqNullSafe(F.col("gone.id")) & (content == F.col("gone.content")), "left_anti")
