"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into segments of three bits (the last has one) and
embedded as the vector of their bit counts.  Flipping a bit moves one coordinate
by one, so the Manhattan distance of two vectors never exceeds the Hamming
distance of the fingerprints.  All pairs within Manhattan distance 2 meet on an
integer grid: every point visits the cells at distance 0 and 1 of itself, and two
points at distance 2 or less always visit a common cell.

One aggregate over the visits finds the cells that several fingerprints visit.
A cell of two is a candidate pair by itself; for the others, few, the visitors
are fetched by the vectors around the cell.  Candidate pairs are then verified by
their exact Hamming distance.

A cell of more than PAIRS_CELL visitors is split instead of paired: its visitors
go to the same grid at one bit to a segment, where the embedding is the
fingerprint itself, a cell has 65 visitors at most, and any two of them differ in
two bits or fewer.  So a group of near copies of any size costs rows in
proportion to its fingerprints, never to their pairs.

``keep_one``, for pipelines, asks for near copies by the Jaccard similarity of
five-word shingles.  Its fingerprints are of words, several for each text; they
meet in the same grid, and every candidate pair is verified on whole texts.  In
crowded cells texts are told by their differences from what is usual among them: few
differences make them alike without a comparison, and with more they must share some,
of which the rarest give the pairs.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm import components
from keelson.llm.bloom import bloom_filter, bloom_holds
from keelson.llm.scratch import materialize, small_batches
from keelson.llm.words import HASH_SEED

BITS = 64
SEGMENT_BITS = 3
SEGMENTS = -(-BITS // SEGMENT_BITS)
CHUNK = 65536
RADIUS = 2
#: Cells of more visitors are split at one bit to a segment.
PAIRS_CELL = 64
#: About so many visits are made in a task.
VISITS_A_TASK = 4_000_000
#: Near copies have so many words in a shingle and so much in common; tables of fingerprints that look for them.
SIMILAR_WORDS, SIMILARITY, TABLES = 5, 0.8, 4
#: In cells of more texts each is compared with two of them, and then by its differences from the others.
SIMILAR_CELL = 16
#: Shingles of such texts are counted in so many spots.
COUNT_SPOTS = 1 << 21
#: The shingles of a family are told from its usual ones in so many parts.
SALTS = 64


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of ``width``-word shingles, repeats included."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        counts += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = pa.array([fingerprint(x, width) for x in texts], pa.int64())
            yield pa.record_batch([batch.column(0), found], ["row", "fp"])

    return run


def content_of(text: Column) -> Column:
    """What tells rows with one id, or none, apart."""
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, content, fp) for every row; fp is signed."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.struct(F.col(id_col).alias("id"), content_of(F.col(text_col)).alias("content"))
    found = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(width), f"row struct<id:{kind},content:bigint>, fp long")
    return found.select("row.id", "row.content", "fp")


def _segment_counts(fp: Column) -> list[Column]:
    mask = (1 << SEGMENT_BITS) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(mask))).cast("long") for i in range(SEGMENTS)]


#: What a visit to a cell at distance 1 adds to the vector's number: a step along a coordinate.
STEPS = [(SEGMENT_BITS + 3) ** i for i in range(SEGMENTS)]
#: Vectors of fingerprint table t have numbers from t times this on; a long has room for 70 tables.
TABLE_STEP = (SEGMENT_BITS + 3) ** SEGMENTS


def embedded(points: DataFrame) -> DataFrame:
    """(node, t, fp, home): the number of the fingerprint's vector, in the range of its table t.

    A coordinate is 0 to 3 and a neighbour's -1 to 4; shifted by one and written in
    base 6 the 22 coordinates fit a long.  A step off a visited cell that leaves -1
    to 4 carries into the next digit and leaves 0 or 5 behind, which no vector has."""
    counts = _segment_counts(F.col("fp"))
    home = sum(((c + F.lit(1)) * F.lit(x) for c, x in zip(counts, STEPS, strict=True)), F.lit(0).cast("long"))
    return points.select("node", "t", "fp", (home + F.col("t") * F.lit(TABLE_STEP)).alias("home"))


def _moves() -> Column:
    return F.array(*[F.lit(m).cast("long") for m in (0, *STEPS, *(-x for x in STEPS))])


def visits(homes: DataFrame) -> DataFrame:
    """(node, cell): the grid cells within Manhattan distance 1 of each vector."""
    return homes.select("node", "home", F.explode(_moves()).alias("move")).select("node", (F.col("home") + F.col("move")).alias("cell"))


def bit_cells(points: DataFrame) -> DataFrame:
    """``points`` with cell: the fingerprint and its 64 one-bit neighbours, the grid at one bit to a segment."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long") for i in range(BITS)])
    return points.select("*", F.explode(flips).alias("flip")).withColumn("cell", F.col("fp").bitwiseXOR(F.col("flip"))).drop("flip")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def meetings(points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(homes, met, around) of ``points`` (node, t, fp), one row for each node and table t of
    fingerprints.  met: the cells that several visit, with their number n and the least and
    greatest of them; around: the vectors (at) from which cells of n > 2 are visited."""
    spark = points.sparkSession
    homes = embedded(points)
    tasks = -(-points.count() * (2 * SEGMENTS + 1) // VISITS_A_TASK)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        homes = homes.repartition(tasks, "node")  # a small file has many visits
    met = visits(homes).groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("dst"), F.max("node").alias("src")).where("n > 1")
    met = materialize(met, "simhash-cells")
    around = met.where("n > 2").select("cell", "n", F.explode(_moves()).alias("move")).withColumn("at", F.col("cell") - F.col("move"))
    return homes, met, around


def paired(homes: DataFrame, met: DataFrame, around: DataFrame, most: int) -> DataFrame:
    """All pairs (src, dst) of visitors of cells of at most ``most``."""
    twos = met.where("n = 2").select("src", "dst")
    crowd = around.where(F.col("n") <= most).join(homes, F.col("at") == F.col("home"))
    crowd = materialize(crowd.select("cell", "move", "node"), "simhash-crowds")
    left, right = (crowd.select("cell", F.col("node").alias(name), F.col("move").alias(f"{name}_move")) for name in ("dst", "src"))
    # visitors with one vector share all their cells: their pair counts at home alone
    pairs = left.join(right, "cell").where("dst < src and (dst_move <> src_move or dst_move = 0)").select("src", "dst")
    return twos.unionByName(pairs)


def visitors(homes: DataFrame, around: DataFrame, most: int) -> DataFrame:
    """``homes`` from which a cell of more than ``most`` visitors is visited, each once, however many of these it visits."""
    hot = materialize(around.where(F.col("n") > most).select(F.col("at").alias("home")).distinct(), "simhash-hot")
    return homes.join(hot, "home", "left_semi")


def candidates(points: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (src, dst) of nodes whose fingerprints in a table are within Manhattan distance
    RADIUS.  Cells of more than ``most`` visitors are split, with enough pairs within
    Hamming distance RADIUS to reach all.

    ``points``: (node, t, fp), one row for each node and table t of fingerprints."""
    most = PAIRS_CELL if most is None else most
    homes, met, around = meetings(points)
    found = paired(homes, met, around, most)
    fine = bit_cells(visitors(homes, around, most).select("node", "t", "fp"))
    first = fine.groupBy("t", "cell").agg(F.min("node").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = fine.join(materialize(first, "simhash-split"), ["t", "cell"]).select(F.col("node").alias("src"), "dst").where("src <> dst")
    return found.unionByName(starred).distinct()


def links(distinct: DataFrame) -> DataFrame:
    """Edges (src, dst) whose components are those of all links at RADIUS or fewer bits.

    ``distinct``: one row for each fingerprint (column fp).  Between fingerprints
    that meet in no split cell every link is an edge."""
    found = candidates(distinct.select(F.col("fp").alias("node"), F.lit(0).cast("long").alias("t"), "fp"))
    return found.where(hamming(F.col("src"), F.col("dst")) <= RADIUS)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, content, fp, root, component) for every row: root, the least fingerprint
    reachable, names the group; component is the least id in it."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    labels = components.connected_components(materialize(links(distinct), "simhash-links"))
    rooted = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = materialize(rooted.join(least, "root").select("fp", "root", "component"), "simhash-components")
    return prints.join(known, "fp").select("id", "content", "fp", "root", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component) for every row of ``docs``: fingerprints that differ in two
    or fewer bits are linked, and component is the smallest id reachable.

    NULL and empty texts and texts of white space have fingerprint zero and are
    linked like any other.  Rows with a NULL id are kept; a component has a NULL
    id only if none of its rows has another.  Repeated rows stay repeated.  An
    empty table gives an empty result.  Other columns, whatever their names, are
    not read.
    """
    return grouped(docs, id_col, text_col, width).select("id", "fp", "component")


# ---------------------------------------------------------------- near copies by similarity


def word_fingerprints(data: bytes | None, tables: int = TABLES) -> np.ndarray:
    """``tables`` signed 64-bit SimHashes of the words, each counting as the bits of its frequency's number.

    Single words, as an edit changes one of them but five five-word shingles: at a
    similarity of 0.8 the fingerprints of shingles are some ten bits apart."""
    times = Counter(data.lower().split()) if data else {}
    if not times:
        return np.zeros(tables, np.int64)
    width = -(-tables // 2)
    digest = xxhash.xxh3_128_digest
    digests = b"".join([digest(w, HASH_SEED + k) for w in times for k in range(width)])
    weight = np.fromiter(map(int.bit_length, times.values()), np.int64, len(times))
    rows = np.frombuffer(digests, np.uint8).reshape(len(times), 16 * width)
    counts = np.zeros(128 * width, np.int64)
    for least in range(1, int(weight.max()) + 1):
        # a word of weight w is counted w times: sums of bits are far faster than products of integers
        mine = rows[weight >= least]
        for i in range(0, len(mine), CHUNK // 16):
            counts += np.unpackbits(mine[i : i + CHUNK // 16], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > weight.sum()).view(np.int64)[:tables]


def shingles(data: bytes | None, width: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct signed hashes of ``width``-word shingles; of the whole sequence if there are fewer words."""
    words = data.lower().split() if data else []
    if not words:
        return np.zeros(0, np.int64)
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), HASH_SEED) for i in range(max(1, len(words) - width + 1))}
    return np.fromiter(found, np.uint64, len(found)).view(np.int64)


def _word_prints(tables: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            flat = np.concatenate([word_fingerprints(x, tables) for x in texts]) if texts else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(flat), tables).cast(pa.list_(pa.int64()))], ["row", "fps"])

    return run


def _wanted_shingles(bloom, width: int):
    def run(batches):
        bits = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            content = batch.column(0).to_numpy()
            mine = pa.array(np.flatnonzero(bloom_holds(bits, content)))
            found = [shingles(x, width) for x in batch.column(1).take(mine).cast(pa.binary()).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0).take(mine), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["content", "shingles"])

    return run


def shingle_counts(crowd: DataFrame):
    """A broadcast of how many texts of ``crowd`` (column shingles) hold each shingle, added up in
    COUNT_SPOTS spots by its hash."""

    def run(batches):
        for batch in batches:
            spots = batch.column(0).flatten().to_numpy().view(np.uint64) & np.uint64(COUNT_SPOTS - 1)
            spot, n = np.unique(spots.astype(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(spot), pa.array(n)], ["spot", "n"])

    found = crowd.select("shingles").mapInArrow(run, "spot bigint, n bigint").groupBy("spot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_SPOTS, np.uint32)
    counts[found["spot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 0xFFFFFFFF)
    return crowd.sparkSession.sparkContext.broadcast(counts.tobytes())


def rarest(bag: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` rarest of a bag, in one order for all bags, by count and hash, which may be any."""
    return bag[np.lexsort((bag, counts[bag.view(np.uint64) & np.uint64(len(counts) - 1)]))[:n]]


def prefix(bag: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a text's shingles, so many that two texts of ``similarity`` or more share one of theirs.

    A text without words has the shingle 0, so that these meet."""
    return rarest(bag, counts, len(bag) - math.ceil(similarity * len(bag) - 1e-6) + 1) if len(bag) else np.zeros(1, np.int64)


def _slices(column) -> list[np.ndarray]:
    flat, lengths = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _prefixes(counts, similarity: float):
    def run(batches):
        often = np.frombuffer(counts.value, np.uint32)
        for batch in batches:
            found = [prefix(bag, often, similarity) for bag in _slices(batch.column(1))]
            nodes = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.record_batch([pa.array(np.concatenate(found)), pa.array(nodes)], ["shingle", "node"])

    return run


def families(crowd: DataFrame, similarity: float) -> DataFrame:
    """``crowd`` (node, shingles, homes) with family; texts as similar as that are of one family, texts alone in theirs are left out.

    Two such texts share one of their rarest shingles (``prefix``): what these join is a family."""
    found = _prefixes(shingle_counts(crowd), similarity)
    prefixes = materialize(crowd.select("node", "shingles").mapInArrow(found, "shingle bigint, node bigint"), "crowd-prefixes")
    heads = prefixes.groupBy("shingle").agg(F.min("node").alias("dst"), F.max("node").alias("last")).where("dst < last")
    shared = prefixes.join(heads, "shingle").select(F.col("node").alias("src"), "dst").where("src <> dst").distinct()
    labels = materialize(components.connected_components(materialize(shared, "crowd-shared")), "crowd-families")
    return materialize(crowd.join(labels.withColumnRenamed("label", "family"), "node"), "crowd-members")


def differences(members: DataFrame, similarity: float) -> DataFrame:
    """(node, family, homes, size, shingles, over): shingles, the differences of a text from what
    more than half of its family has, and how many they are over its part of those that two
    texts of ``similarity`` may differ in.

    Texts x and y differ in |dx| + |dy| - 2 |dx & dy| shingles, whatever dx and dy are taken
    from, and are as similar as that if these are at most (1 - similarity) / (1 + similarity) of
    both sizes together.  So they are if over_x + over_y <= 0; else they must have half of that
    sum in common."""
    each = members.select("family", F.explode("shingles").alias("shingle")).groupBy("family", "shingle").agg(F.count("*").alias("n"))
    # a large family has many shingles: they are spread by a salt, and its number of texts is repeated for each
    each = each.withColumn("salt", F.pmod("shingle", F.lit(SALTS)))
    total = members.groupBy("family").agg(F.count("*").alias("texts")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    often = materialize(each.join(total, ["family", "salt"]).where("2 * n > texts").select("family", "shingle"), "crowd-often")
    usual = often.groupBy("family").agg(F.collect_list("shingle").alias("usual"))
    known = members.join(materialize(usual, "crowd-usual"), "family", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<bigint>")))
    differs = F.array_union(F.array_except("shingles", "usual"), F.array_except("usual", "shingles"))
    # differences of two families are never the same
    differs = F.transform(differs, lambda x: x.bitwiseXOR(F.col("family")))
    found = known.select("node", "family", "homes", F.size("shingles").cast("long").alias("size"), differs.alias("shingles"))
    return materialize(found.withColumn("over", F.size("shingles") - F.col("size") * F.lit((1 - similarity) / (1 + similarity))), "crowd-differences")


def _rare_differences(counts, similarity: float):
    share = (1 - similarity) / (1 + similarity) / similarity

    def run(batches):
        often = np.frombuffer(counts.value, np.uint32)
        for batch in batches:
            bags, size, over = _slices(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            # what any text as similar, at most size / similarity long, must have in common with this one
            least = np.maximum(1, np.ceil(over - share * size - 1e-6)).astype(np.int64)
            found = [rarest(bag, often, max(0, len(bag) - n + 1)) for bag, n in zip(bags, least, strict=True)]
            lengths = [len(x) for x in found]
            rest = np.concatenate([len(bag) - np.arange(n) for bag, n in zip(bags, lengths, strict=True)])
            nodes, overs = (np.repeat(batch.column(i).to_numpy(), lengths) for i in (0, 3))
            yield pa.record_batch([pa.array(np.concatenate(found)), pa.array(nodes), pa.array(overs), pa.array(rest)], ["shingle", "node", "over", "rest"])

    return run


def surely_alike(rooted: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst) of ``rooted`` (differences, with root) that join all texts of a cell that are alike
    by ``over_x + over_y <= 0``: those that are so with any are so with the one of the least
    ``over``.  No more rows than visits, whatever the number of such texts."""
    share = (1 - similarity) / (1 + similarity) / similarity
    # the least over is that of a text without differences, at most size / similarity long
    near = rooted.where(F.col("over") <= F.col("size") * F.lit(share) + F.lit(1e-6)).select("family", "node", "root", "over", F.explode("homes").alias("home"))
    spots = near.groupBy("family", "home").agg(F.min(F.struct("over", "node", "root")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high"))
    steps = materialize(spots, "crowd-spots").select("*", F.explode(_moves()).alias("move")).withColumn("cell", F.col("home") + F.col("move"))
    heads = steps.groupBy("family", "cell").agg(F.min("head").alias("head"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    heads = materialize(heads.select("family", "cell", "head"), "crowd-heads")
    met = steps.select("family", "home", "cell").join(heads, ["family", "cell"]).select("family", "home", "head").distinct()
    sure = near.join(met, ["family", "home"]).where("root <> head.root").where(F.col("over") + F.col("head.over") <= F.lit(1e-6))
    return sure.select(F.greatest("node", "head.node").alias("src"), F.least("node", "head.node").alias("dst"))


def _alike(similarity: float) -> Column:
    common = F.size(F.array_intersect("src_bag", "dst_bag"))
    return common >= F.lit(similarity) * (F.size("src_bag") + F.size("dst_bag") - common)


def crowded_links(crowd: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """``edges`` (src, dst) and so many more links between nodes of ``crowd`` (node, shingles,
    homes) that all its links lie within their components.

    Texts are told by their ``differences`` from what is usual in their family.  Those with few
    are alike without a comparison and joined cell by cell (``surely_alike``); others have some
    of their rarest differences in common.  By each of these a text is first compared with the
    one that has the fewest; then all that share one and are not in one component yet are
    compared."""
    told = differences(families(crowd, similarity), similarity)
    found = _rare_differences(shingle_counts(told), similarity)
    rare = told.select("node", "shingles", "size", "over").mapInArrow(found, "shingle bigint, node bigint, over double, rest bigint")
    rare = materialize(rare, "crowd-rare")
    cells = lambda homes: F.flatten(F.transform(homes, lambda h: F.transform(_moves(), lambda m: h + m)))
    # the first difference in common and what comes after it have room for all that they must share
    room = lambda x, y, both: (both > F.lit(-1e-6)) & (2 * F.least(x, y) >= both - F.lit(1e-6))
    for first in (True, False):
        labels = materialize(components.connected_components(edges), "crowd-labels")
        with_root = lambda rows: rows.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node")).drop("label")  # noqa: E731, B023
        rooted = with_root(rare)
        heads = rooted.groupBy("shingle").agg(F.min(F.struct("over", "node", "root", "rest")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        rooted = materialize(rooted.join(heads.select("shingle", "head"), "shingle"), "crowd-rooted")
        if first:
            enough = room(F.col("rest"), F.col("head.rest"), F.col("over") + F.col("head.over"))
            pairs = rooted.where("root <> head.root").where(enough).select(F.greatest("node", "head.node").alias("src"), F.least("node", "head.node").alias("dst"))
            pairs = pairs.unionByName(surely_alike(materialize(with_root(told.drop("shingles")), "crowd-told"), similarity))
        else:
            a, b = (rooted.select("shingle", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "root", "over", "rest")]) for name in ("src", "dst"))
            enough = room(F.col("src_rest"), F.col("dst_rest"), F.col("src_over") + F.col("dst_over"))
            pairs = a.join(b, "shingle").where("src_node > dst_node and src_root <> dst_root").where(enough).select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
        pairs = materialize(pairs.distinct(), "crowd-candidates")
        a, b = (crowd.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_bag"), F.col("homes").alias(f"{name}_homes")) for name in ("src", "dst"))
        compared = pairs.join(a, "src").join(b, "dst").where(F.arrays_overlap(cells("src_homes"), cells("dst_homes"))).where(_alike(similarity))
        edges = edges.unionByName(materialize(compared.select("src", "dst"), "crowd-links"))
    return edges


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: int = TABLES, width: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, content, root) for every row: root names the group of texts that links of
    ``similarity`` or more join.

    A link is a pair of texts that meet in the popcount grid of one of ``tables``
    word fingerprints and have so much in common by the exact Jaccard similarity of
    their ``width``-word shingles.  Equal texts are one node, so copies are never
    paired.  In cells of more than SIMILAR_CELL texts each is compared with two of them;
    then ``crowded_links`` finds the links that are left there, so that groups don't depend
    on the limit.  Only nodes of candidate pairs and of these cells have their shingles
    made, chosen by a Bloom filter of bounded size, and no text is shuffled."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), content_of(text).alias("content")).alias("row"), text.alias("text"))
    prints = keyed.mapInArrow(_word_prints(tables), f"row struct<id:{kind},content:bigint>, fps array<bigint>").select("row.id", "row.content", "fps")
    prints = materialize(prints, "word-prints")
    nodes = prints.groupBy(F.col("content").alias("node")).agg(F.first("fps").alias("fps"))
    points = materialize(nodes.select("node", F.posexplode("fps").alias("t", "fp")).select("node", F.col("t").cast("long").alias("t"), "fp"), "word-points")
    homes, met, around = meetings(points)
    hot = met.where(F.col("n") > SIMILAR_CELL).select(F.col("cell").alias("home"), F.array("dst", "src").alias("ends"))
    ends = homes.join(hot, "home").select("node", F.explode("ends").alias("end")).where("node <> end")
    starred = ends.select(F.greatest("node", "end").alias("src"), F.least("node", "end").alias("dst"))
    pairs = materialize(paired(homes, met, around, SIMILAR_CELL).unionByName(starred).distinct(), "similar-candidates")
    crowd = materialize(visitors(homes, around, SIMILAR_CELL).select("node").distinct(), "similar-crowd")
    wanted = bloom_filter(pairs.select(F.explode(F.array("src", "dst")).alias("h")).union(crowd).distinct())
    bags = keyed.select("row.content", "text").mapInArrow(_wanted_shingles(wanted, width), "content bigint, shingles array<bigint>")
    bags = materialize(bags.groupBy("content").agg(F.first("shingles").alias("shingles")), "similar-shingles")
    a, b = (bags.select(F.col("content").alias(name), F.col("shingles").alias(f"{name}_bag")) for name in ("src", "dst"))
    edges = materialize(pairs.join(a, "src").join(b, "dst").where(_alike(similarity)).select("src", "dst"), "similar-links")
    if not crowd.isEmpty():
        at = homes.join(crowd, "node", "left_semi").groupBy("node").agg(F.collect_list("home").alias("homes"))
        crowd = materialize(at.join(bags, F.col("node") == F.col("content")).select("node", "shingles", "homes"), "crowd-shingles")
        edges = crowded_links(crowd, edges, similarity)
    labels = materialize(components.connected_components(edges), "similar-labels")
    return prints.join(labels, prints["content"] == labels["node"], "left").select("id", "content", F.coalesce("label", "content").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one document of each group of near copies (similar_groups):
    the one with the smallest id stays (one with a NULL id only where a group has no
    other).

    A document is a pair of id and text: several texts of one id are several
    documents, and of repeated rows one stays.  Texts without words are alike.  Texts
    of any length are read whole; an empty table gives an empty result; columns may
    have any names.
    """
    each = similar_groups(docs, id_col, text_col, **options).groupBy("root", "id", "content").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "content", "rows")).alias("head")
    heads = materialize(each.groupBy("root").agg(first).select(F.col("head.id").alias("__head"), F.col("head.content").alias("__content"), F.col("head.rows").alias("__rows")), "simhash-heads")
    heads, named = heads.alias("head"), docs.alias("doc")
    mine = lambda c: F.col(f"doc.`{c}`")
    same_text = content_of(mine(text_col)) == F.col("head.__content")
    unique = heads.where("__head IS NOT NULL AND __rows = 1")
    # one plan at every size: heads are about as many as documents, never small enough to broadcast
    kept = named.join(unique.hint("merge"), (mine(id_col) == F.col("head.__head")) & same_text, "left_semi")
    others = heads.where("__head IS NULL OR __rows > 1")
    if others.isEmpty():
        return kept
    # repeated rows and rows without an id: few, so that a second look at the table is cheaper than sorting it
    again = named.join(others, mine(id_col).eqNullSafe(F.col("head.__head")) & same_text, "left_semi")
    return kept.unionByName(again.dropDuplicates([id_col, text_col]))
