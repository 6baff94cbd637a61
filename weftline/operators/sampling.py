"""Reproducible samples and evaluation of ranked results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def allocation(sizes: DataFrame, n: int) -> DataFrame:
    """(stratum, size, take): ``n`` shared in proportion, the rest to the largest remainders, never more than there is.

    Strata are documents or groups: a short table."""
    total = F.sum("size").over(W.partitionBy())
    exact = F.col("size") * F.lit(n) / total
    rows = sizes.withColumn("floor", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    left = F.lit(n) - F.sum("floor").over(W.partitionBy())
    order = F.row_number().over(W.orderBy(F.desc("rest"), F.desc("size"), "stratum"))
    return rows.withColumn("take", F.least(F.col("size"), F.col("floor") + F.when(order <= left, 1).otherwise(0))).select("stratum", "size", "take")


def stratified(rows: DataFrame, stratum: str, n: int, seed: int, key: str = "id") -> DataFrame:
    """A sample with the same rows for the same seed: in each stratum those with the least hash. Hashes are ranked within
    a stratum after each partition has dropped what can't be among the least (row_number with a limit is pushed down)."""
    sizes = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    take = allocation(sizes, n).select(F.col("stratum").alias(stratum), "take")
    order = W.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    ranked = rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n)
    return ranked.join(take, stratum).filter(F.col("__r") <= F.col("take")).drop("__r", "take")


def by_ids(rows: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of a list of ids in its order; an empty list selects nothing."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(ids))], "pos long, id string")
    return rows.join(listed, "id").orderBy("pos")


def selection(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, reason): why an asked row isn't taken; null where it is."""
    found = asked.select("id").join(rows.select("id", "full_text", "summary_status", F.lit(True).alias("there")), "id", "left")
    words = F.size(F.split(F.trim("full_text"), r"\s+"))
    reason = F.when(F.col("there").isNull(), "not found").when(F.coalesce(F.trim("full_text"), F.lit("")) == "", "no text").when(words < 25, "heading only").when(F.col("summary_status") == "approved", "approved")
    return found.select("id", reason.alias("reason"))


def evaluation(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, expected_at, forbidden, passed): of results (q, position, id) and questions (q, expect, forbid, top_n), where expect
    and forbid are arrays of id prefixes."""
    both = questions.join(results, "q", "left")
    starts = lambda prefixes: F.exists(prefixes, lambda p: F.startswith(F.col("id"), p))
    inside = F.col("position") <= F.col("top_n")
    out = both.groupBy("q").agg(F.min(F.when(inside & starts("expect"), F.col("position"))).alias("expected_at"), F.coalesce(F.bool_or(inside & starts("forbid")), F.lit(False)).alias("forbidden"))
    return out.withColumn("passed", F.col("expected_at").isNotNull() & ~F.col("forbidden"))


def margin(rows: list[tuple[str, float]], expect: list[str], top_n: int, steps: int = 60) -> float:
    """How much less the best expected row's score could be with the row still among the first ``top_n``; negative if it has
    to be more. Rows (id, score) are one page of results. By bisection, as ranks needn't be plain sorts of scores."""
    hits = [i for i, (x, _) in enumerate(rows) if any(x.startswith(p) for p in expect)]
    if not hits:
        return float("-inf")
    best = max(hits, key=lambda i: rows[i][1])

    def there(delta: float) -> bool:
        own = rows[best][1] - delta
        return sum(s > own for i, (_, s) in enumerate(rows) if i != best) < top_n

    low, high = -1.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if there(mid) else (low, mid)
    return low


def funnel(steps: DataFrame) -> DataFrame:
    """(furthest, sessions): sessions by the furthest step that they reached."""
    furthest = steps.groupBy("session").agg(F.max("step").alias("furthest"))
    return furthest.groupBy("furthest").agg(F.count(F.lit(1)).alias("sessions"))


def buckets(reasons: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(bucket, n): reasons by the patterns that they match, one reason in as many as match, else in other."""
    hits = F.array_compact(F.array(*[F.when(F.lower("reason").rlike(p), name) for name, p in patterns.items()]))
    return reasons.select(F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("other")))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def tally(verdicts: DataFrame, arm: Column) -> DataFrame:
    """(arm, grp, n, correct_rate): of verdicts (grp, verdict) for each group and all (grp null)."""
    return verdicts.withColumn("arm", arm).groupingSets([["arm"], ["arm", "grp"]], "arm", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("verdict") == "correct", 1.0).otherwise(0.0)).alias("correct_rate"))


def spend(calls: DataFrame, caps: DataFrame) -> DataFrame:
    """(reg, stage, spent, cap, exceeded): cost of calls (reg, stage, cost) against caps (reg, cap)."""
    own = calls.groupBy("reg", "stage").agg(F.sum("cost").alias("spent"))
    total = F.sum("spent").over(W.partitionBy("reg"))
    return own.withColumn("total", total).join(caps, "reg", "left").withColumn("exceeded", F.coalesce(F.col("total") > F.col("cap") + 1e-9, F.lit(False)))


def sorted_digests(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, checksum): the MD5 of each group's keys, sorted and joined by commas. Rows stream through in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums = [], []
        for b in batches:
            for name, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not names or names[-1] != name:
                    names.append(name)
                    sums.append(hashlib.md5(k.encode()))
                else:
                    sums[-1].update(b"," + k.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([s.hexdigest() for s in sums], pa.string())], names=[group, "checksum"])

    ordered = rows.select(F.col(group).cast("string"), F.col(key).cast("string")).filter(F.col(key).isNotNull()).repartition(group).sortWithinPartitions(group, key)
    return ordered.mapInArrow(run, f"{group} string, checksum string")


def capped(requests: DataFrame, who: str, number: str, when: str, cap: int = 5, hours: int = 24) -> DataFrame:
    """(who, number, when, accepted): a user's requests in the order of time, accepted if fewer than ``cap`` accepted ones were in the ``hours`` before
    (one exactly so old counts); of a repeated number the first counts. Decisions of a user depend on those before, so they are one task's rows,
    read a batch at a time."""
    span = hours * 3_600_000_000
    rows = requests.filter(F.col(when).isNotNull()).groupBy(who, number).agg(F.min(when).alias(when))
    rows = rows.select(who, number, when, F.unix_micros(F.col(when).cast("timestamp")).alias("__at"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, taken = object(), []
        for batch in batches:
            good = []
            for user, at in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if user != here:
                    here, taken = user, []
                taken = [t for t in taken if t >= at - span]
                good.append(len(taken) < cap)
                if good[-1]:
                    taken.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(good)], names=[who, number, when, "accepted"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (who, number, when))
    return rows.repartition(who).sortWithinPartitions(who, "__at", number).mapInArrow(decide, f"{kinds}, accepted boolean")
