"""Change logs, differences between versions, and guarded writes as table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V

REVIEWS = ["summary_approved", "summary_edited"]
TEXT_EVENTS = ["text_updated", "links_updated", "added", "removed", "transcription_corrected", "duplicate_removed", "source_version_changed"]
BY_EVENT = ["removed", "duplicate_removed", "transcription_corrected"]


#: Time bins of an interval.
BINS = 24


def first_after(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, hours: int, name: str) -> DataFrame:
    """Adds to each row of ``left`` the earliest time of ``right`` for the same key within [t, t + hours); null if there is none, or for
    a row without key or time.

    Both sides become one stream, sorted by time within a key and a bin of a ``BINS``-th of the interval: the next time in the bin comes
    from one pass backwards, the first time of a later bin from a table of bins. No pair of rows is made, and a key that holds
    most rows is spread over its bins."""
    width = max(1, hours * 3_600_000_000 // BINS)
    bin_of = F.floor(F.unix_micros("__time") / width)
    whole = F.struct(*[F.col(c) for c in left.columns])
    asked = left.select(F.col(key).alias("__key"), F.col(left_time).cast("timestamp").alias("__time"), whole.alias("__row"), F.lit(1).alias("__side"))
    times = right.select(F.col(key).alias("__key"), F.col(right_time).cast("timestamp").alias("__time")).filter("__key is not null and __time is not null")
    times = times.select("*", F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), F.lit(0).alias("__side"))
    both = asked.filter("__key is not null and __time is not null").unionByName(times).withColumn("__bin", bin_of)

    backwards = W.partitionBy("__key", "__bin").orderBy(F.desc("__time"), "__side")  # of equal times those of ``right`` first
    near = F.last(F.when(F.col("__side") == 0, F.col("__time")), ignorenulls=True).over(backwards.rowsBetween(W.unboundedPreceding, 0))
    first = both.groupBy("__key", "__bin").agg(F.min(F.when(F.col("__side") == 0, F.col("__time"))).alias("__first"))
    later = F.last("__first", ignorenulls=True).over(W.partitionBy("__key").orderBy(F.desc("__bin")).rowsBetween(W.unboundedPreceding, -1))
    bins = first.select("__key", "__bin", later.alias("__later"))
    found = both.withColumn("__near", near).filter("__side = 1").join(bins, ["__key", "__bin"])
    time = F.coalesce("__near", "__later")
    inside = F.when(time < F.col("__time") + F.expr(f"interval {hours} hours"), time)
    out = found.select("__row.*", inside.cast(right.schema[right_time].dataType).alias(name))
    without = left.filter(F.col(key).isNull() | F.col(left_time).isNull()).withColumn(name, F.lit(None).cast(right.schema[right_time].dataType))
    return out.unionByName(without)


def classified(log: DataFrame, status: DataFrame | None = None, hours: int = 24) -> DataFrame:
    """(change_id, node_id, reg_key, created_at, change_type): the log with rewrites classed by what became of them.

    A rewrite takes the first review of its node within ``hours``; reviews so taken aren't events of their own."""
    columns = ["change_id", "node_id", "reg_key", "created_at", "change_type"]
    reviews = log.filter(F.col("change_type").isin(REVIEWS))
    rewrites = first_after(log.filter("change_type = 'summary_regenerated' and node_id is not null").select(*columns), reviews, "node_id", "created_at", "created_at", hours, "reviewed_at")
    taken = rewrites.filter("reviewed_at is not null").select("node_id", F.col("reviewed_at").alias("created_at")).distinct()
    edited = reviews.filter("change_type = 'summary_edited'").select("node_id", F.col("created_at").alias("reviewed_at")).distinct().withColumn("edited", F.lit(True))
    rewrites = rewrites.join(edited, ["node_id", "reviewed_at"], "left")
    state = F.lit(None).cast("string")
    if status is not None:
        rewrites = rewrites.join(status.select(F.col("id").alias("node_id"), "summary_status"), "node_id", "left")
        state = F.col("summary_status")
    outcome = F.when(F.col("reviewed_at").isNotNull(), F.when(F.col("edited"), "summary_rewritten_corrected").otherwise("summary_rewritten_reviewed")).when(state == "pending", "summary_rewritten_pending").otherwise("summary_rewritten_reviewed_later")
    rewrites = rewrites.withColumn("change_type", outcome).select(*columns)
    texts = log.filter(F.col("change_type").isin(TEXT_EVENTS)).select(*columns)
    return texts.unionByName(reviews.join(taken, ["node_id", "created_at"], "left_anti").select(*columns)).unionByName(rewrites)


def daily_counts(events: DataFrame, staged: DataFrame | None = None, zone: str = V.ZONE) -> DataFrame:
    """(day, reg_key, change_type, provision_count, latest): days of the zone; some types count events, the others nodes.

    ``staged``: keys (reg_key) that aren't released yet."""
    key = F.coalesce("reg_key", V.document_key(F.col("node_id")))
    rows = events.withColumn("reg_key", key)
    if staged is not None:
        rows = rows.join(staged.select("reg_key"), "reg_key", "left_anti")
    counted = F.when(F.col("change_type").isin(BY_EVENT), F.col("change_id").cast("string")).otherwise(F.coalesce("node_id", F.col("change_id").cast("string")))
    return rows.groupBy(V.civil_day(F.col("created_at"), zone).alias("day"), "reg_key", "change_type").agg(F.countDistinct(counted).alias("provision_count"), F.max("created_at").alias("latest"))


#: Counters of a line, and the types that add to each.
COUNTERS = {
    "text_updated": ["text_updated"], "links_updated": ["links_updated"], "added": ["added"], "removed": ["removed"], "source_version_changed": ["source_version_changed"],
    "transcription_corrected": ["transcription_corrected"], "duplicate_removed": ["duplicate_removed"], "reviewed": ["summary_approved", "summary_edited"], "corrected": ["summary_edited"],
    "rewritten_reviewed": ["summary_rewritten_reviewed", "summary_rewritten_corrected"], "rewritten_corrected": ["summary_rewritten_corrected"],
    "rewritten_reviewed_later": ["summary_rewritten_reviewed_later"], "rewritten_pending": ["summary_rewritten_pending", "summary_regenerated"],
}


def lines(counts: DataFrame) -> DataFrame:
    """A line for each day and document with a counter for each kind of change; types without one are dropped, and lines of zeros."""
    sums = [F.coalesce(F.sum(F.when(F.col("change_type").isin(kinds), F.col("provision_count"))), F.lit(0)).alias(name) for name, kinds in COUNTERS.items()]
    out = counts.groupBy("day", "reg_key").agg(*sums, F.max("latest").alias("latest"))
    total = sum((F.col(c) for c in COUNTERS if c not in ("corrected", "rewritten_corrected")), F.lit(0))
    return out.filter(total > 0)


def snapshot_json(counts: DataFrame) -> DataFrame:
    """One row: the counts as a JSON array, latest first. Counts are small: days x documents x types of a public page."""
    row = F.struct((-F.col("latest").cast("double")).alias("o"), F.struct("day", "reg_key", "change_type", "provision_count", "latest").alias("r"))
    return counts.agg(F.to_json(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"])).alias("rows"), F.count(F.lit(1)).alias("n"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): identical, changed, markup (same letters and digits), new or obsolete, for rows (id, full_text)."""
    a, b = old.select("id", F.col("full_text").alias("was")), new.select("id", F.col("full_text").alias("now"))
    both = a.withColumn("old", F.lit(True)).join(b.withColumn("new", F.lit(True)), "id", "full_outer")
    same_letters = T.letters_digits(F.col("was")).eqNullSafe(T.letters_digits(F.col("now")))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "obsolete").when(F.col("was").eqNullSafe(F.col("now")), "identical").when(same_letters, "markup").otherwise("changed")
    return both.select("id", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in; of rows of ``new`` with equal keys the last by seq wins (column dropped)."""
    if "seq" in new.columns:
        rest = [c for c in new.columns if c not in (*keys, "seq")]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("__r")).select(*keys, "__r.*")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def first_write(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those of ``new`` whose keys it hasn't: what was written first stays."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def compare_and_set(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """``rows`` with values set where a condition holds, and matched, whether it did."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumn("matched", hit).withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def rehashed(chunks: DataFrame, changes_json: DataFrame) -> DataFrame:
    """Chunk hashes replaced by those of a JSON record set (id, chunk_index, old, new), only where the old hash is the one held."""
    kind = "array<struct<id: string, chunk_index: int, old: string, new: string>>"
    asked = changes_json.select(F.inline(F.from_json("changes", kind))).withColumnRenamed("old", "text_hash")
    return chunks.join(asked, ["id", "chunk_index", "text_hash"], "left").withColumn("text_hash", F.coalesce("new", "text_hash")).drop("new")


def embedding_plan(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(id, n_chunks, embed): a node is embedded again if any chunk's hash differs or is missing, or it has surplus chunks."""
    both = wanted.select("id", "chunk_index", F.col("text_hash").alias("w")).join(held.select("id", "chunk_index", F.col("text_hash").alias("h")), ["id", "chunk_index"], "full_outer")
    return both.groupBy("id").agg(F.count("w").alias("n_chunks"), F.bool_or(~F.col("w").eqNullSafe(F.col("h"))).alias("embed")).filter("n_chunks > 0")


def rehash_plan(current: DataFrame, legacy: DataFrame, held: DataFrame) -> DataFrame:
    """(id, chunk_index, state): current, legacy (rewrite the hash) or stale (embed), by which rule's hash is held."""
    rows = held.join(current.select("id", "chunk_index", F.col("text_hash").alias("c")), ["id", "chunk_index"], "left").join(legacy.select("id", "chunk_index", F.col("text_hash").alias("l")), ["id", "chunk_index"], "left")
    state = F.when(F.col("text_hash") == F.col("c"), "current").when(F.col("text_hash") == F.col("l"), "legacy").otherwise("stale")
    return rows.select("id", "chunk_index", state.alias("state"))


def ledger_check(files: DataFrame, rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """(version, problem): versions of one side only, or of different content; ``allowed`` (version) are left out."""
    both = files.select("version", F.col("content").alias("f"), F.lit(True).alias("in_files")).join(rows.select("version", F.col("content").alias("r"), F.lit(True).alias("in_rows")), "version", "full_outer")
    problem = F.when(F.col("in_rows").isNull(), "not applied").when(F.col("in_files").isNull(), "no file").when(~F.col("f").eqNullSafe(F.col("r")), "differs")
    return both.withColumn("problem", problem).filter("problem is not null").join(allowed.select("version"), "version", "left_anti").select("version", "problem")


def freshness(held: DataFrame, live: DataFrame) -> DataFrame:
    """(key, status): ok, changed, error (no live version) or blocked, from held and live versions (key, version[, error])."""
    both = held.select("key", F.col("version").alias("held")).join(live.select("key", F.col("version").alias("live"), "error"), "key", "left")
    status = F.when(F.col("error").rlike("(?i)403|captcha|blocked"), "blocked").when(F.col("error").isNotNull() | F.col("live").isNull(), "error").when(F.col("held").eqNullSafe(F.col("live")), "ok").otherwise("changed")
    return both.select("key", status.alias("status"))


def link_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, href, change): links of one version more often than of the other, as multisets of (id, href)."""
    gone, come = old.select("id", "href").exceptAll(new.select("id", "href")), new.select("id", "href").exceptAll(old.select("id", "href"))
    return gone.withColumn("change", F.lit("removed")).unionByName(come.withColumn("change", F.lit("added")))
