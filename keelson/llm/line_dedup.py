"""Line deduplication over a sharded minimal perfect hash.

Pass one gives each document's distinct line keys as 128-bit hashes, and Spark
counts the distinct documents of each (partial sums first).  The hashes of lines
found in INDEXED_DOCS documents or more go to shards; a task per shard builds a
minimal perfect hash over its keys, with arrays of fingerprints, document counts
and owners (the largest id that holds the line), and the shards are written to
the shared folder.  Pass two maps over the documents and probes the arrays: no
line is joined, and no text is shuffled.  The counts decide there, so one index
serves every limit from INDEXED_DOCS on.

A line of a single document can't be dropped at any limit, so it is left out of
the index: a probe that finds no fingerprint has its answer.  That matters since
every probing task reads the shards: over 30 GB all distinct lines would be about
20 times the keys.  ``indexed_docs=1`` indexes them all.

Probing tasks hold the hashes of a bounded chunk of documents, and shards in a
cache bounded in bytes, so memory does not grow with the corpus or the index.
"""

from __future__ import annotations

import functools
import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.perfect_hash import Shard
from keelson.llm.scratch import new_dir, small_batches
from keelson.llm.words import HASH_SEED, code_points, line_key

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines of fewer documents are not in the index.
INDEXED_DOCS = 2
KEYS_PER_SHARD = 250_000
LEAST_SHARDS = 32
CACHE_BYTES = 256 << 20
OWNER_NONE = -(1 << 63)
#: Document counts in the index; larger ones stop at its maximum.
COUNT = np.uint32


def long_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line with at least ``min_chars`` code points."""
    key = line_key(line)
    if len(key) < min_chars or (len(key) < 4 * min_chars and code_points(key) < min_chars):
        return None
    return key


def hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, HASH_SEED), xxhash.xxh64_intdigest(key, HASH_SEED + 1)


def _document_keys(min_chars: int):
    def run(batches):
        for batch in batches:
            a, b, ids = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found = {hashes(k) for k in (long_key(x, min_chars) for x in (text or b"").split(b"\n")) if k is not None}
                for x, y in found:
                    a.append(x)
                    b.append(y)
                ids += [i] * len(found)
            owner = batch.column(0).take(pa.array(ids, pa.int64()))
            yield pa.record_batch([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), owner], ["a", "b", "owner"])

    return run


def _build_shard(group):
    """One row: the shard's arrays, for pandas rows (shard, a, b, docs, owner)."""
    import pandas as pd

    a, b = group["a"].to_numpy().view(np.uint64), group["b"].to_numpy().view(np.uint64)
    shard, index = Shard.build(a, b)
    docs, owner = np.zeros(len(a), COUNT), np.zeros(len(a), np.int64)
    docs[index], owner[index] = np.minimum(group["docs"].to_numpy(), np.iinfo(COUNT).max), group["owner"].to_numpy()
    return pd.DataFrame([{"shard": int(group["shard"].iloc[0]), "docs": docs.tobytes(), "owner": owner.tobytes(), **shard.to_bytes()}])


SHARD_SCHEMA = "shard int, docs binary, owner binary, sizes binary, bits binary, ranks binary, prints binary"


def build_index(docs: DataFrame, id_col: str, text_col: str, min_chars: int, indexed_docs: int = INDEXED_DOCS) -> tuple[str, int]:
    """(URI, number of shards) of the index of the keys found in ``indexed_docs`` documents or more."""
    spark = docs.sparkSession
    owner = F.coalesce(F.col(id_col).cast("long"), F.lit(OWNER_NONE))
    rows = docs.select(owner.alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = rows.mapInArrow(_document_keys(min_chars), "a long, b long, owner long")
    # a hot line is spread by its owners first, then one row a task
    counted = keys.groupBy("a", "b").agg(F.count_distinct("owner").alias("docs"), F.max("owner").alias("owner"))
    counted_uri = new_dir(spark, "line-counts")
    counted.where(F.col("docs") >= indexed_docs).write.parquet(counted_uri)
    indexed = spark.read.schema("a long, b long, docs long, owner long").parquet(counted_uri)
    n_shards = max(LEAST_SHARDS, math.ceil(indexed.count() / KEYS_PER_SHARD))
    uri = new_dir(spark, "line-index")
    sharded = indexed.withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int"))
    built = sharded.groupBy("shard").applyInPandas(_build_shard, SHARD_SCHEMA)
    built.withColumn("part", F.col("shard")).write.partitionBy("part").parquet(uri)
    return uri, n_shards


class Index:
    """Reads shards of an index on demand; keeps the last ones used, up to a number of bytes."""

    def __init__(self, uri: str, n_shards: int, limit: int = CACHE_BYTES):
        self.uri, self.n_shards, self.limit = uri, n_shards, limit
        self.held: OrderedDict[int, tuple[Shard, np.ndarray, np.ndarray, int] | None] = OrderedDict()
        self.bytes = 0

    def _load(self, k: int):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, path = pafs.FileSystem.from_uri(f"{self.uri}/part={k}")
        files = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        files = [x.path for x in files if x.path.endswith(".parquet")]
        if not files:
            return None
        if len(files) > 1:
            raise ValueError(f"shard {k} was written more than once")
        with fs.open_input_file(files[0]) as f:
            row = pq.ParquetFile(f).read().to_pylist()[0]
        size = sum(len(v) for v in row.values() if isinstance(v, bytes))
        return Shard.from_bytes(row), np.frombuffer(row["docs"], COUNT), np.frombuffer(row["owner"], np.int64), size

    def shard(self, k: int):
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        found = self.held[k] = self._load(k)
        self.bytes += found[3] if found else 0
        while self.bytes > self.limit and len(self.held) > 1:
            _, old = self.held.popitem(last=False)
            self.bytes -= old[3] if old else 0
        return found

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, owner) of each key; no documents for keys that are not in the index."""
        docs, owner = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        place = a.view(np.int64) % self.n_shards  # numpy's % has the divisor's sign, as pmod has
        order = np.argsort(place, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            if len(part) and (found := self.shard(int(place[part[0]]))):
                at = found[0].lookup(a[part], b[part])
                hit = at >= 0
                docs[part[hit]], owner[part[hit]] = found[1][at[hit]], found[2][at[hit]]
        return docs, owner


@functools.lru_cache(maxsize=1)
def _index(uri: str, n_shards: int) -> Index:
    """One index for each Python worker, which Spark reuses for the tasks of a stage."""
    return Index(uri, n_shards)


def _probe(uri: str, n_shards: int, min_chars: int, min_docs: int):
    def run(batches):
        index = _index(uri, n_shards)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            a, b, spots = [], [], []
            for i, text in enumerate(texts):
                for j, line in enumerate(text.split(b"\n")):
                    if (key := long_key(line, min_chars)) is not None:
                        x, y = hashes(key)
                        a.append(x)
                        b.append(y)
                        spots.append((i, j))
            found, owner = index.lookup(np.array(a, np.uint64), np.array(b, np.uint64))
            gone: dict[int, set[int]] = {}
            for n in np.flatnonzero(found >= min_docs).tolist():
                i, j = spots[n]
                if owner[n] != (OWNER_NONE if ids[i] is None else ids[i]):
                    gone.setdefault(i, set()).add(j)
            kept = [t if i not in gone else b"\n".join(x for j, x in enumerate(t.split(b"\n")) if j not in gone[i]) for i, t in enumerate(texts)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
                    pa.array([len(gone.get(i, ())) for i in range(len(texts))], pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["row", "n_lines", "n_dropped", "kept_text"],
            )

    return run


def dedup_lines(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) for every row; row holds the columns ``carry``.

    A document is all rows of one id; rows without an id are one document together.
    A line whose key has ``min_chars`` code points or more and is found in ``min_docs``
    documents or more stays only in the document with the largest id that holds it
    (in rows without an id only if no holder has one); every line of that key stays
    there.  NULL and empty texts have one empty line; texts of any length are read
    whole.  Repeated rows stay repeated.  An empty table gives an empty result.
    Other columns, whatever their names, are not read but for those carried.
    """
    small_batches(docs.sparkSession)
    if min_docs < INDEXED_DOCS:
        raise ValueError(f"a line of fewer than {INDEXED_DOCS} documents is never dropped")
    uri, n_shards = build_index(docs, id_col, text_col, min_chars)
    row = F.struct(*[F.col(f"`{c}`") for c in carry])
    kind = T.StructType([docs.schema[c] for c in carry])
    schema = T.StructType([T.StructField("row", kind), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_probe(uri, n_shards, min_chars, min_docs), schema)
