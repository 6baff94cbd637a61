import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.operators import changes, sampling
from weftline.streaming import jobs


def events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(minutes=17 * i), "click" if i % 4 else "purchase", i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, step int")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(spark, tmp_path, name, df, mode="append"):
    q = jobs.available_now(df, str(tmp_path / name), str(tmp_path / f"{name}-state"), mode)
    q.awaitTermination(120)
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def test_pairs_equal_the_batch_join(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    split = lambda e: (e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"))
    got = run(spark, tmp_path, "pairs", jobs.paired(*split(stream), "user_id", "ts", 5))
    a, b = split(batch)
    want = changes.first_after(a.select("event_id", "user_id", "ts"), b.select("user_id", "ts"), "user_id", "ts", "ts", 5, "r")
    first = got.groupBy("user_id", "left_at").agg(F.min("right_at").alias("r"))
    assert first.count() == want.filter("r is not null").count() > 50
    assert first.join(want, (first.left_at == want.ts) & (first.user_id == want.user_id) & (first.r == want.r)).count() == first.count()


def test_windows_close_behind_the_watermark(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = {(r.start, r.user_id): r.n for r in run(spark, tmp_path, "rate", jobs.rate(stream, "user_id", "ts", "1 hour", "30 minutes")).collect()}
    want = {(r.start, r.user_id): r.n for r in batch.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "user_id").count().select(F.col("w.start").alias("start"), "user_id", F.col("count").alias("n")).collect()}
    assert got.items() <= want.items() and len(got) > 0.9 * len(want)


def test_sessions(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    got = run(spark, tmp_path, "sessions", jobs.sessions(stream, "user_id", "ts", "step", "10 minutes"))
    assert got.agg(F.max("furthest")).first()[0] == 4


def test_versions_of_a_table(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    write = jobs.rewrite_batches(lambda old, new: changes.upsert(old, new, ["k"]) if old is not None else new, str(tmp_path / "t"))
    write(rows((1, "a"), (2, "b")), 0)
    write(rows((2, "c")), 1)
    write(rows((2, "c")), 1)
    assert sorted(spark.read.parquet(str(tmp_path / "t/v1")).collect()) == [(1, "a"), (2, "c")]


def test_hours_add_up_to_days(spark, tmp_path):
    rows = [(i, i % 2, dt.datetime(2024, 3, 9, 20) + dt.timedelta(minutes=13 * i)) for i in range(500)]  # over a change of the clock
    batch = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    hours = run(spark, tmp_path, "days", jobs.daily(stream, "ts", ["user_id"], "1 hour"))
    got = {(r.day, r.user_id): r.n for r in hours.groupBy("day", "user_id").agg(F.sum("n").alias("n")).collect()}
    want = {(r.day, r.user_id): r.n for r in batch.groupBy(jobs.V.civil_day(F.col("ts")).alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    last = max(d for d, _ in want)
    assert {k: n for k, n in got.items() if k[0] < last} == {k: n for k, n in want.items() if k[0] < last} and len({d for d, _ in want}) == 6


def test_each_event_once(spark, tmp_path):
    batch, _ = events(spark, tmp_path)
    twice = batch.unionByName(batch.filter("event_id % 3 = 0"))
    twice.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "twice"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "twice"))
    got = run(spark, tmp_path, "once", jobs.distinct_events(stream, "event_id", "ts"))
    assert sorted(r.event_id for r in got.collect()) == list(range(400))


def brute_caps(rows, cap, hours):
    """Decisions on (id, user, time), each against all accepted ones before."""
    accepted, out = {}, {}
    for i, user, at in sorted({r[0]: r for r in reversed(rows)}.values(), key=lambda r: (r[2], r[0])):
        held = [t for t in accepted.get(user, []) if t >= at - dt.timedelta(hours=hours)]
        out[i] = len(held) < cap
        if out[i]:
            accepted.setdefault(user, []).append(at)
    return out


def test_caps_equal_the_batch_over_a_restart(spark, tmp_path):
    r = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"u{i % 4}", start + dt.timedelta(minutes=r.choice([0, 30, 60]) + 40 * i)) for i in range(300)]
    rows += [(1000 + i, "edge", start + dt.timedelta(hours=24 * i)) for i in range(6)] + [(2000 + i, "over", start + dt.timedelta(hours=24 * i, seconds=i)) for i in range(6)]
    rows.sort(key=lambda x: x[2] + dt.timedelta(minutes=r.randrange(50)))  # late, but within the delay
    rows = [x for row in rows for x in ([row, row] if r.random() < 0.2 else [row])]
    schema = "id long, who string, at timestamp"
    want = brute_caps(rows, 3, 24)
    batch = sampling.capped(spark.createDataFrame(rows, schema), "who", "id", "at", 3)
    assert {x.id: x.accepted for x in batch.collect()} == want
    assert want[1001] and want[1005] and sum(not x for x in want.values()) > 50

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = jobs.capped(stream, "who", "id", "at", 3, 24, "2 hours")
    cut = [0, 60, 150, 151, 250, len(rows)]
    for k, (a, z) in enumerate(zip(cut, cut[1:])):
        spark.createDataFrame(rows[a:z], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 4):  # the second run goes on from the checkpoint of the first
            run(spark, tmp_path, "caps", job)
    got = [(x.id, x.accepted) for x in spark.read.parquet(str(tmp_path / "caps")).collect()]
    assert len(got) == len(dict(got)) > 200 and dict(got).items() <= want.items()
