"""URL filtering by rules and, where no rule fits, by link-graph trust.

In DataFrame operations only.  Hosts are the nodes, links between pages of
different hosts the edges, weighted by their number.  Trust flows from trusted
hosts along the edges and distrust from blocked hosts against them, both by
personalised PageRank with one unit at each seed.  A host whose distrust exceeds
its trust by ``MARGIN`` is blocked.

PageRank splits a seed's unit over all that link to it, so that each host of a
large farm gets little.  The same is therefore asked relative to a host's own
links: the chance that a walk along its links, going on with ``DAMPING`` at every
step, comes to a blocked host, and that a walk back along the links into it comes
to a trusted one.  These don't depend on the size of the graph or on how many
others link to a seed; a host is also blocked if the first exceeds the second by
``MARGIN``.

Seeds come from the rules: a host is trusted (blocked) if rules allow (block)
more than ``SEED_SHARE`` of its pages; of hosts known only from links, if the
rule for their root page does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.scratch import drop_dir, materialize, new_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
MARGIN = 0.05
SEED_SHARE = 0.5
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, NULL if none does; of two equally
    long ones the one with the longer host, then the first."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), 1)).alias("to"))
    edges = found.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> dst and src <> ''")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def trust_scores(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, walks: bool = False) -> DataFrame:
    """(host, trust, distrust) from ``edges`` (src, dst, n) and ``seeds`` (host, good, bad: 0 or 1).

    With ``walks`` the chances of a host's walks to come to a seed, which is 1 at the
    seeds themselves, instead of PageRank.  Every host of ``seeds`` is a node, and every end of an edge must be one.
    Rounds are written to the shared folder; one number a round reaches the driver.

    A round shrinks what is left to change by ``damping``: in sum over the hosts for
    PageRank, in the largest change for walks.  So the number of rounds until no host
    changes by more than TOLERANCE is known beforehand; if it weren't enough, that
    would be an error, never a result."""
    spark = edges.sparkSession
    # written, so that no aggregate stands between a join and the exchange of a hub's edges, which Spark then splits
    out = materialize(edges.groupBy("src").agg(F.sum("n").alias("all")), "links-out")
    into = materialize(edges.groupBy("dst").agg(F.sum("n").alias("all")), "links-in")
    if walks:  # a host's own links sum to one, not those of the host that a score comes from
        out, into = into.withColumnRenamed("dst", "of"), out.withColumnRenamed("src", "of")
        shared_out, shared_in = edges.join(out, F.col("dst") == F.col("of")), edges.join(into, F.col("src") == F.col("of"))
    else:
        shared_out, shared_in = edges.join(out, "src"), edges.join(into, "dst")
    forward = shared_out.select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("t"), F.lit(0.0).alias("d"))
    backward = shared_in.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("all")).alias("d"))
    flows = materialize(forward.union(backward).groupBy("from", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "trust-flows")
    unit = F.lit(1.0 if walks else 1 - damping)
    base = seeds.select("host", (unit * F.col("good")).alias("good"), (unit * F.col("bad")).alias("bad"))
    base = materialize(base, "trust-seeds")
    now, last = base.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), None
    most = 1.0 if walks else float(base.agg(F.greatest(F.sum("good"), F.sum("bad"))).first()[0] or 0)
    rounds = max(0, math.ceil(math.log(max(most, TOLERANCE) / TOLERANCE) / -math.log(damping))) + 1
    for _ in range(rounds):
        moved = flows.join(now, flows["from"] == now["host"]).select("to", (F.col("t") * F.col("trust")).alias("t"), (F.col("d") * F.col("distrust")).alias("d"))
        gained = moved.groupBy("to").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        fresh = base.join(gained, base["host"] == gained["to"], "left").join(now.select(F.col("host").alias("h"), F.col("trust").alias("t0"), F.col("distrust").alias("d0")), F.col("host") == F.col("h"))
        trust = F.col("good") + damping * F.coalesce("t", F.lit(0.0))
        distrust = F.col("bad") + damping * F.coalesce("d", F.lit(0.0))
        if walks:
            trust, distrust = F.when(F.col("good") > 0, 1.0).otherwise(trust), F.when(F.col("bad") > 0, 1.0).otherwise(distrust)
        uri = new_dir(spark, "trust-round")
        fresh.select("host", trust.alias("trust"), distrust.alias("distrust"), F.greatest(F.abs(trust - F.col("t0")), F.abs(distrust - F.col("d0"))).alias("change")).write.parquet(uri)
        written = spark.read.parquet(uri)
        change = written.agg(F.max("change")).first()[0]
        now = written.select("host", "trust", "distrust")
        if last is not None:
            drop_dir(spark, last)
        last = uri
        if change is None or change <= TOLERANCE:
            return now
    raise RuntimeError(f"scores still change after {rounds} rounds")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, margin: float = MARGIN) -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    A NULL url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed.  NULL html has no links.  Rows with NULL ids and repeated rows
    are judged like others and stay; an empty table gives an empty result.  Urls and
    html of any length are read whole; other columns, whatever their names, are not
    read.
    """
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col).cast("string")).alias("host"), path_of(F.col(url_col).cast("string")).alias("path"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = materialize(parts.withColumn("rule", text).withColumn("ruled", verdict), "ruled-urls")
    edges = materialize(host_edges(pages, url_col, html_col), "host-edges")
    shares = ruled.where("host <> ''").groupBy("host").agg(*[F.avg(F.when(F.col("ruled") == v, 1).otherwise(0)).alias(n) for v, n in (("allow", "good"), ("block", "bad"))])
    seen = shares.select("host", *[(F.col(c) > SEED_SHARE).cast("int").alias(c) for c in ("good", "bad")])
    _, root = longest_rule(F.col("host"), F.lit("/"), rules)
    linked = edges.select(F.col("dst").alias("host")).distinct().join(seen, "host", "left_anti")
    linked = linked.select("host", *[F.coalesce((root == v).cast("int"), F.lit(0)).alias(n) for v, n in (("allow", "good"), ("block", "bad"))])
    seeds = materialize(seen.unionByName(linked), "host-seeds")
    scores = trust_scores(edges, seeds).unionByName(trust_scores(edges, seeds, walks=True))
    blocked = materialize(scores.where(F.col("distrust") - F.col("trust") > margin).select(F.col("host").alias("bad_host")).distinct(), "blocked-hosts")
    found = ruled.join(blocked, F.col("host") == F.col("bad_host"), "left")
    by_method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return found.select("id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"))
