"""One query for each operator, over its whole table, and oracle SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import line_dedup, line_quality, link_trust, shards, simhash, site_quality, source_mix, templates, warc, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_mix.mix(source_mix.sizes_of(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _op1_sql() -> str:
    seed, weights = source_mix.SEED, ", ".join(map(str, source_mix.WEIGHTS))

    def draw(what: str, value: str) -> str:
        return f"CAST('0x' || substr(md5('{seed}:{what}:' || coalesce(CAST({value} AS VARCHAR), '')), 1, 13) AS BIGINT)"

    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(count(*) / {source_mix.STRIPE_ROWS}.0) AS BIGINT) AS stripes FROM sized GROUP BY source),
weighed AS (SELECT *, ([{weights}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(source_mix.WEIGHTS)}] AS weight, source_size * {source_mix.MOST_COPIES} AS cap FROM sources),
total AS (SELECT CAST(sum(source_size) * {source_mix.SHARE_PERCENT} AS DOUBLE) / 100 AS words FROM weighed),
levels AS (  -- the level if all sources whose cap for a unit of weight is at most r are capped
    SELECT r, (words - coalesce((SELECT sum(cap) FROM weighed WHERE CAST(cap AS DOUBLE) / weight <= r), 0))
              / (SELECT sum(weight) FROM weighed WHERE CAST(cap AS DOUBLE) / weight > r) AS level
    FROM (SELECT -1.0::DOUBLE AS r UNION SELECT CAST(cap AS DOUBLE) / weight FROM weighed), total),
chosen AS (SELECT arg_min(level, r) AS level FROM levels l WHERE level IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM weighed WHERE CAST(cap AS DOUBLE) / weight > l.r AND CAST(cap AS DOUBLE) <= l.level * weight)),
targets AS (SELECT source, source_size, stripes, least(CAST(cap AS DOUBLE), level * weight) AS target FROM weighed, chosen),
placed AS (SELECT doc_id, size, t.source, source_size, target, {draw("stripe", "doc_id")} % stripes AS stripe FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stripe, CASE WHEN stripe % 2 = 0 THEN size ELSE -size END, {draw("tie", "doc_id")}, doc_id NULLS FIRST) - 1 AS r,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate, ({draw("offset", "source")} + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS o FROM placed)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN least(floor((r + 1) * rate + o) - floor(r * rate + o), {source_mix.MOST_COPIES}) ELSE 0 END AS BIGINT) * size AS taken
FROM ranked"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
    SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, line, pos,
           translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (key) GROUP BY doc_id
"""


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    limits = line_quality.Limits()
    separators = ", ".join(f"'{x.decode()}'" for x in sorted(line_quality.SEPARATORS))
    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    furniture = " OR ".join("contains({}, '{}')".format(low, x.decode().replace("'", "''")) for x in line_quality.BOILERPLATE)
    word, symbols = r"'[^\x20\x09-\x0D]+'", f"'[{line_quality.SYMBOLS}]'"

    def ends(marks) -> str:
        return "(" + " OR ".join("ends_with(ws[n], '{}')".format(x.decode().replace("'", "''")) for x in marks) + ")"

    def share(condition: str, limit: float, of: str = "n") -> str:
        return f"len(list_filter(ws, lambda x: {condition})) > {limit}::DOUBLE * {of}"

    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, {word}) AS ws FROM texts)),
windows AS (SELECT *, lead(word, 1) OVER d AS w2, lead(word, 2) OVER d AS w3 FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS hit FROM windows),
covered AS (SELECT doc_id, word, hit OR coalesce(lag(hit, 1) OVER d, false) OR coalesce(lag(hit, 2) OVER d, false) AS again FROM hits WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
words AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (again) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, line, pos, regexp_extract_all(line, {word}) AS ws, len(regexp_extract_all(line, {word})) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts)),
spoken AS (SELECT *, n <= {limits.item_max_words} AND NOT {ends(line_quality.END_MARKS)} AS item, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS spot,
    count(*) OVER (PARTITION BY doc_id, line) AS times FROM lines WHERE n > 0),
runs AS (SELECT *, spot - row_number() OVER (PARTITION BY doc_id, item ORDER BY pos) AS run FROM spoken),
placed_lines AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item, run) AS run_lines FROM runs),
judged AS (SELECT doc_id, line, n,
    (item AND run_lines >= {limits.run_lines})
    OR (n <= {limits.boilerplate_max_words} AND (times >= {limits.repeated_lines} OR {ends(line_quality.ELLIPSES)}))
    OR {share("regexp_matches(x, '^[!-/:-@" + chr(92) + "[-`{-~]+$')", limits.marks_share)} OR
    (n >= 3 AND {share(f"x IN ({separators})", limits.separator_share)})
    OR {share(f"regexp_matches(x, {symbols}) AND x NOT IN ({separators})", limits.symbol_words_share)}
    OR (n >= {limits.shout_min_words} AND regexp_matches(line, '[A-Za-z]') AND {share("ends_with(x, '!!')", limits.shout_share)})
    OR (n >= {limits.shout_min_words} AND {share("regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')", limits.shout_share)})
    OR (n >= {limits.stutter_min_words} AND len(list_filter(range(1, n), lambda k: ws[k] = ws[k + 1])) > {limits.stutter_share}::DOUBLE * (n - 1))
    OR (n <= {limits.boilerplate_max_words} AND ({furniture})) AS fails
  FROM placed_lines),
lost AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (fails), 0) AS BIGINT) AS n_lost_words FROM judged GROUP BY doc_id),
found AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, {symbols})) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words
  FROM texts LEFT JOIN words USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < {limits.base_min_words} OR 100 * n_repeat_words > {limits.base_max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {limits.base_min_words} OR 100 * n_repeat_words > {limits.base_max_repeat_percent} * n_words) AND n_lost_words <= {limits.max_lost_share}::DOUBLE * n_words AS kept
FROM found"""


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("content").withColumnsRenamed({"id": "doc_id", "item": "item_id"}).withColumn("coverage", F.round("coverage", 6)).withColumn("slot_agreement", F.round("slot_agreement", 6))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op8_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP8_SQL = """
WITH digests AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
           CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::BIGINT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests
"""


def op9_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_line_dedup": op2_line_dedup,
    "op3_line_quality": op3_line_quality,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_simhash_components": op5_simhash_components,
    "op6_wrapper_extraction": op6_wrapper_extraction,
    "op7_site_quality": op7_site_quality,
    "op8_warc_roundtrip": op8_warc_roundtrip,
    "op9_link_trust": op9_link_trust,
    "op10_tiered_shards": op10_tiered_shards,
}
ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": _op1_sql(),
    "op2_line_dedup": OP2_SQL,
    "op3_line_quality": _op3_sql(),
    "op8_warc_roundtrip": OP8_SQL,
}
