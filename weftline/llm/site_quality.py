"""Quality scores by hierarchical empirical Bayes.

A logistic classifier of text measurements gives each document a probability of good quality. Hosts and paths of hosts
get posterior means of it: a host is shrunk toward the global mean, and a path toward what the other paths of its host say (toward the
global mean where there are none), by strengths that are estimated from the data (method of moments), so sites with few documents
stay near the prior above them. A document's score adds to its own log-odds what the posterior of its path, without the document, differs
from the global mean. Path and prior have no document in common, so no document's evidence counts twice.

A site is a key such as ``example.org/blog/1``: what is before the first ``/`` is the host, the first part after it the path (with
``://`` and what is before it left out). A key without a ``/`` is a host with one path.

The sums for sites come from one grouped aggregation with partial sums, so a host with a third of all rows costs no
more than others. Labels are used of at most ``MAX_LABELLED`` documents (least hash of the id; none that is held
out), a documented bound of the fit; of more rows, which repeated ids give, those first in the order of hash, id and
measurements are used. Posteriors and scores cover all rows.

Edge cases: null texts count as empty; null keys are one site; repeated rows count each time; without labels of both
kinds the classifier gives 0.5 to all; very long texts are measured by string functions only; other columns are
ignored, whatever they are called; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WORD_GAPS, staged, text_of

MAX_LABELLED = 60_000
FOLDS = 5
FEATURES = ["length", "symbols", "pipes", "word_size", "repeats", "short_lines", "capitals", "stops", "variety"]
#: Odds of a kept document: below this probability of good quality it isn't kept.
KEEP = 0.5


def features(text: Column) -> list[Column]:
    """FEATURES of a text, each of about unit size."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    listed = F.split(text, WORD_GAPS)
    words = F.greatest(F.size(listed), F.lit(1)).cast("double")
    less = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    lines = F.split(text, "\n")
    return [
        F.log1p(words) / 5,
        F.log1p(1000 * less("#*$%&<>")) / 3,
        F.log1p(1000 * less("|")) / 3,
        n / words / 6,
        1 - F.size(F.array_distinct(lines)) / F.size(lines),
        F.log1p(F.size(lines) / words * 20),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 20,
        less(".,;:") * 20,
        F.log(words / F.size(F.array_distinct(listed))),
    ]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(rows: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale and weights of the classifier, from rows (doc_id, FEATURES) with a label."""
    own = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("__good"))
    own = own.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *FEATURES).join(F.broadcast(own), "doc_id")  # ``limit`` ids
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(limit).drop("doc_id").toArrow()
    x = np.stack([got.column(f).to_numpy() for f in FEATURES], 1) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got.column("__good").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(1 + 2 * len(FEATURES))
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - center) / scale, -6, 6)
    z = np.column_stack([np.ones(len(z)), z, z * z])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T * (p * (1 - p) + 1e-6) @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w


def probability(center: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Column:
    out = F.lit(float(w[0]))
    k = len(FEATURES)
    for i, f in enumerate(FEATURES):
        z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(f) - float(center[i])) / float(scale[i])))
        out = out + z * float(w[1 + i]) + z * z * float(w[1 + k + i])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), out))))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: str, n: str, around: str) -> float:
    """How many documents a prior weighs: by moments, the variance within over the variance between groups."""
    inner = F.col(around) * (1 - F.col(around))
    spread = F.pow(F.col(mean) - F.col(around), 2) * F.col(n)
    row = groups.agg(F.sum(spread).alias("s"), F.sum(inner).alias("v"), F.sum(inner * F.col(n)).alias("w"), F.count(F.lit(1)).alias("k"), F.sum(n).alias("n")).first()
    if not row["k"] or not row["n"] or not row["v"]:
        return 1.0
    within = row["w"] / row["n"]
    between = max((row["s"] - row["v"]) / row["n"], 1e-4 * within)  # what is left of the spread besides chance
    return float(min(max(within / between, 1.0), 1e4))


def host_of(site: Column) -> Column:
    return F.regexp_extract(F.coalesce(site.cast("string"), F.lit("")), "^(?:[^/]*://)?([^/]*)", 1)


def path_of(site: Column) -> Column:
    return F.regexp_extract(F.coalesce(site.cast("string"), F.lit("")), "^(?:[^/]*://)?[^/]*/([^/?#]*)", 1)


def posteriors(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Of rows (host, path, own): (host, path, sum, n, host_sum, host_n, host_posterior, prior, path_posterior) of each path, the global mean, and the
    strengths of it and of a host's posterior."""
    paths = staged(rows.groupBy("host", "path").agg(F.sum("own").alias("sum"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("sum").alias("host_sum"), F.sum("n").alias("host_n"))
    whole = paths.agg(F.sum("sum"), F.sum("n")).first()
    mean = float(whole[0] / whole[1]) if whole[1] else 0.5
    k_host = strength(hosts.select((F.col("host_sum") / F.col("host_n")).alias("mean"), F.col("host_n").alias("n"), F.lit(mean).alias("around")), "mean", "n", "around")
    hosts = hosts.withColumn("host_posterior", (F.col("host_sum") + k_host * mean) / (F.col("host_n") + k_host))
    rest = (F.col("host_sum") - F.col("sum") + k_host * mean) / (F.col("host_n") - F.col("n") + k_host)  # the host's other paths
    sites = paths.join(hosts, "host").withColumn("prior", rest)
    k_path = strength(sites.select((F.col("sum") / F.col("n")).alias("mean"), "n", F.col("prior").alias("around")), "mean", "n", "around")
    sites = sites.withColumn("path_posterior", (F.col("sum") + k_path * F.col("prior")) / (F.col("n") + k_path))
    return staged(sites, "sites"), mean, k_host, k_path


def score(docs: DataFrame, labels: DataFrame, site_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, host_posterior, path_posterior, score, predicted, kept) for every row of ``docs``."""
    site = F.col(site_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), host_of(site).alias("host"), path_of(site).alias("path"), text_of(text_col).alias("text"))
    rows = staged(rows.select("doc_id", "host", "path", *[c.alias(n) for n, c in zip(FEATURES, features(F.col("text")), strict=True)]), "measured")
    p = probability(*fit(rows, labels.select("doc_id", "quality")))
    rows = rows.select("doc_id", "host", "path", p.alias("own"))
    sites, mean, k_host, k_path = posteriors(rows)
    path = (F.col("sum") - F.col("own") + k_path * F.col("prior")) / (F.col("n") - 1 + k_path)
    both = logit(F.col("own")) + logit(path) - logit(F.lit(mean))
    out = rows.join(sites, ["host", "path"]).withColumn("score", 1 / (1 + F.exp(-both)))
    return out.select(
        F.col("doc_id").alias(id_col), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "host_posterior", "path_posterior",
        "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), (F.col("score") >= KEEP).alias("kept"),
    )
