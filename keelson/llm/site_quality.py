"""Quality by hierarchical empirical Bayes: document evidence and site priors.

A logistic classifier of style features, fitted on a bounded sample of labelled
documents, gives each document's evidence as log-odds.  Every document, by its
label or else its evidence, is then an observation of its host and of its path
within the host.  Grouped sums give each host's rate, shrunk toward the global
rate, and each path's rate, shrunk toward its host's: sparse sites lean on their
parents, large ones speak for themselves.  How strongly rates are shrunk is
estimated from how much they differ, by moments over all groups.  The verdict
adds the path's log-odds, less the global ones, to the document's evidence, with
the document itself left out of its groups.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.scratch import materialize, small_batches

#: About so many labelled documents are fitted, those with the smallest hash of their id; all if there are fewer.
MAX_TRAIN = 20_000
L2 = 1e-2
STEPS = 25
EPS = 1e-3
FEATURES = ("log_words", "word_bytes", "symbols", "capitals", "digits", "shouts", "bars", "sentence_ends", "distinct", "stutter", "repeated_lines", "blank_lines")
_CAPITALS, _DIGITS, _SYMBOLS = bytes(range(65, 91)), b"0123456789", b"#*$%&|<>"


def features(data: bytes | None) -> tuple[float, ...]:
    """Style features, each about 0 to 1; all 0 for a text without words."""
    data = data or b""
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return (0.0,) * len(FEATURES)
    lines = data.split(b"\n")
    full = [x for x in lines if x and not x.isspace()]

    def share(chars: bytes) -> float:
        return (size - len(data.translate(None, chars))) / size

    ends = data.count(b".") + data.count(b"?") + data.count(b"!")
    return (
        min(1.0, float(np.log1p(n)) / 12),
        min(1.0, size / n / 40),
        share(_SYMBOLS),
        share(_CAPITALS),
        share(_DIGITS),
        min(1.0, data.count(b"!!") / n),
        min(1.0, data.count(b" | ") / n),
        min(1.0, ends / n),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(full)) / len(full),
        1 - len(full) / len(lines),
    )


def _feature_rows(batches):
    for batch in batches:
        found = np.array([features(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        yield pa.record_batch([batch.column(0), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], ["row", *FEATURES])


def fit(x: np.ndarray, y: np.ndarray, l2: float = L2) -> np.ndarray:
    """Intercept and weights of a ridge-penalised logistic regression (Newton steps)."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    penalty = np.full(len(w), l2 * max(1.0, len(y) / 1000))
    penalty[0] = 1e-6
    for _ in range(STEPS):
        z = np.clip(x @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: str) -> float:
    """Prior observations of the shrinkage toward column ``rate``, by moments over ``groups``
    (good, n): spread of the groups' rates beyond what sampling explains."""
    own = F.col("good") / F.col("n")
    r = groups.where("n > 1").agg(
        F.sum(F.col("n") * (own - F.col(rate)) ** 2).alias("spread"),
        F.sum(F.col(rate) * (1 - F.col(rate))).alias("noise"),
        F.sum("n").alias("n"),
        F.sum(F.col(rate) * (1 - F.col(rate)) * F.col("n")).alias("scale"),
    ).first()
    if not r["n"]:
        return 10.0
    between = max((r["spread"] - r["noise"]) / r["n"], 0.0)
    within = r["scale"] / r["n"]
    return float(min(1e4, max(1.0, within / between - 1))) if between > 0 else 1e4


def majority_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(lid, y): one label, 0 or 1, for each id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    return known.select("lid", (F.col("y") >= 0.5).cast("double").alias("y"))


def training_sample(labelled: DataFrame, bound: int) -> DataFrame:
    """(y, features) of about ``bound`` rows, the same in every run: those whose id's hash is
    below the share that is wanted.  No task sends more than its part of them to the driver."""
    n = labelled.count()
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = labelled if n <= bound else labelled.where(drawn < bound / n)
    return rows.select("y", *FEATURES)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, evidence, host_rate, path_rate, score, kept) for every row of ``docs``.

    ``host`` and ``path`` default to the columns source and lang.  NULL hosts (and
    paths within a host) form one group.  Several labels of an id are averaged,
    half counts as good; NULL labels and labels without a document are ignored.
    Without labels evidence is 0 and every document is kept.  Texts without words
    have zero features.  Repeated rows and NULL ids stay; an empty table gives an
    empty result.
    """
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.struct(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path")).alias("row"), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"{f} double" for f in FEATURES)
    measured = rows.mapInArrow(_feature_rows, f"row struct<id:{kind},host:string,path:string>, {fields}")
    known = majority_labels(labels, id_col, label_col)
    measured = measured.select("row.id", "row.host", "row.path", *FEATURES).join(known, F.col("id") == F.col("lid"), "left").drop("lid")
    measured = materialize(measured, "quality-features")
    local = training_sample(measured.where("y IS NOT NULL"), max_train).toPandas()
    weights = fit(local[list(FEATURES)].to_numpy(np.float64), local["y"].to_numpy(np.float64))
    evidence = sum((F.lit(float(w)) * F.col(f) for w, f in zip(weights[1:], FEATURES, strict=True)), F.lit(float(weights[0])))
    scored = measured.select("id", "host", "path", "y", evidence.alias("evidence"))
    scored = scored.withColumn("p", F.coalesce("y", 1 / (1 + F.exp(-F.col("evidence")))))

    paths = materialize(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").cast("double").alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    rate = total["good"] / total["n"] if total["n"] else 0.5
    host_k = _strength(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n"), F.lit(rate).alias("rate")), "rate")
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    shrunk = (F.col("host_good") + host_k * rate) / (F.col("host_n") + host_k)
    path_k = _strength(both.select("good", "n", shrunk.alias("rate")), "rate")
    sites = materialize(both.select(F.col("host").alias("h"), F.col("path").alias("q"), "good", "n", "host_good", "host_n"), "quality-sites")

    found = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    host_rate = (F.col("host_good") - F.col("p") + host_k * rate) / (F.col("host_n") - 1 + host_k)
    path_rate = (F.col("good") - F.col("p") + path_k * F.col("host_rate")) / (F.col("n") - 1 + path_k)
    found = found.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    final = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.lit(rate))
    return found.select("id", "evidence", "host_rate", "path_rate", final.alias("score"), (final >= 0).alias("kept"))
