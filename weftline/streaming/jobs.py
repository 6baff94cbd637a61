"""Streaming forms of what is stateful or incremental. Each takes a streaming (or batch) DataFrame of events.

Late rows: a row older than the watermark is dropped; ``delay`` says how old. With the same input and no late rows the
batch operators give the same results, and tests compare both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions import values as V


def rate(events: DataFrame, who: str, when: str, length: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """(start, who, n): events of each user in sliding windows."""
    return events.withWatermark(when, delay).groupBy(F.window(when, length, slide).alias("w"), who).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), who, "n")


def daily(events: DataFrame, when: str, keys: list[str], delay: str = "2 days", zone: str = V.ZONE) -> DataFrame:
    """(day, keys..., n, latest): a row for each closed hour with events, marked with the day of the zone. Days of a zone aren't windows of one
    length (clocks change), hours are parts of exactly one: the sums of ``n`` by day and keys are the counts of the day."""
    marked = events.withWatermark(when, delay)
    return marked.groupBy(F.window(when, "1 hour").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("latest")).select(V.civil_day(F.col("w.start"), zone).alias("day"), *keys, "n", "latest")


def paired(left: DataFrame, right: DataFrame, key: str, when: str, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """(key, left_at, right_at): pairs within ``hours`` of a stream-stream join with state bounded on both sides."""
    a = left.select(F.col(key), F.col(when).alias("left_at")).withWatermark("left_at", delay)
    b = right.select(F.col(key).alias("other"), F.col(when).alias("right_at")).withWatermark("right_at", delay)
    inside = (F.col(key) == F.col("other")) & (F.col("right_at") >= F.col("left_at")) & (F.col("right_at") < F.col("left_at") + F.expr(f"interval {hours} hours"))
    return a.join(b, inside).select(key, "left_at", "right_at")


def sessions(steps: DataFrame, who: str, when: str, step: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(who, start, end, furthest, n): the furthest step of each session."""
    return steps.withWatermark(when, delay).groupBy(F.session_window(when, gap).alias("w"), who).agg(F.max(step).alias("furthest"), F.count(F.lit(1)).alias("n")).select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "furthest", "n")


def distinct_events(events: DataFrame, key: str, when: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(when, delay).dropDuplicatesWithinWatermark([key])


def _decided(rows: list[tuple[int, int]], taken: list[int], cap: int, span: int) -> tuple[list[tuple[int, int, bool]], list[int]]:
    """Decisions on (time, id) in their order, given the times of accepted ones: accepted if fewer than ``cap`` were within ``span`` before."""
    out = []
    for at, number in sorted(rows):
        taken = [t for t in taken if t >= at - span]
        good = len(taken) < cap
        taken = [*taken, at] if good else taken
        out.append((at, number, good))
    return out, taken


def capped(requests: DataFrame, who: str, number: str, when: str, cap: int = 5, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """(who, number, when, accepted): of each user's requests those are accepted before which fewer than ``cap`` were in the last ``hours``; one
    that is exactly ``hours`` old still counts, refused ones don't.

    Requests wait until the watermark is behind them and are then decided in the order of time and number, so the order in which they come
    doesn't matter as long as none is later than ``delay`` (such are dropped), and a repeated number counts once. A user's state is what waits,
    ``cap`` times at most, and is removed when the last of these is out of the interval."""
    span = hours * 3_600_000_000
    names = {who: requests.schema[who].dataType.simpleString(), number: "bigint", when: "timestamp"}
    out = ", ".join(f"{name} {kind}" for name, kind in names.items()) + ", accepted boolean"

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, times, taken = (list(x) for x in state.get) if state.exists else ([], [], [])
        waiting = dict(zip(numbers, times))
        for rows in batches:
            for n, at in zip(rows[number], rows[when]):
                waiting.setdefault(int(n), int(pd.Timestamp(at).value // 1000))
        mark = state.getCurrentWatermarkMs() * 1000
        final = [(at, n) for n, at in waiting.items() if at < mark]
        found, taken = _decided(final, taken, cap, span)
        for _, n in final:
            del waiting[n]
        taken = [t for t in taken if t >= mark - span]
        if waiting or taken:
            state.update((list(waiting), list(waiting.values()), taken))
            due = min(waiting.values()) if waiting else taken[-1] + span
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame({who: [key[0]] * len(found), number: [n for _, n, _ in found], when: pd.to_datetime([at for at, _, _ in found], unit="us"), "accepted": [good for *_, good in found]})

    rows = requests.select(who, F.col(number).cast("bigint").alias(number), when).withWatermark(when, delay)
    return rows.groupBy(who).applyInPandasWithState(decide, out, "numbers array<bigint>, times array<bigint>, taken array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def rewrite_batches(apply: Callable[[DataFrame | None, DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table at ``path``: each batch writes version n + 1 from version n and the batch.

    A version is a folder of its own, so a batch that is run again after a failure writes the same version again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        apply(old, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return run


def available_now(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over all that is there and stops; Parquet files at ``sink``."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
