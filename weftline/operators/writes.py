"""Writes that keep a history: each returns the table after it and the log rows that it causes.

There is no table format with MERGE here: a table is rewritten from itself and its changes, into a new folder, and the
pointer to the current folder is one small file that is written last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import changes


def summaries(rows: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Puts summaries (id, summary, model) in. The first one ever is kept as the original; a review starts anew; only a
    rewrite, not a first summary, is logged."""
    joined = rows.join(new.select("id", F.col("summary").alias("__new"), F.col("model").alias("__model")), "id", "left")
    has = F.col("__new").isNotNull()
    log = joined.filter(has & F.col("ai_summary").isNotNull() & ~F.col("ai_summary").eqNullSafe(F.col("__new"))).select(F.col("id").alias("node_id"), now.alias("created_at"), F.lit("summary_regenerated").alias("change_type"))
    put = {
        "summary_original": F.coalesce("summary_original", "__new"), "ai_summary": F.col("__new"), "summary_model": F.col("__model"), "summary_generated_at": now,
        "summary_status": F.lit("pending"), "reviewed_by": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp"),
    }
    after = joined.withColumns({c: F.when(has, v).otherwise(F.col(c)) for c, v in put.items()})
    return after.select(*rows.columns), log


def gate(new: DataFrame, most_words: int = 150) -> tuple[DataFrame, DataFrame]:
    """(id, summary, still_long) that may be written, and (id, reason) that may not: hedging or cut_off.

    ``new``: id, summary, and where there are any: stop_reason of the answer, rehedged (the answer when asked not to say what is absent),
    shorter (the answer when asked for fewer words). A hedging answer is replaced by rehedged, or refused. A cut-off one (also one
    whose stop_reason is max_tokens) is replaced by shorter if that is whole and doesn't hedge, or refused. One of more than
    ``most_words`` words takes shorter if it is whole, doesn't hedge and is shorter, and is written in any case. Tags are stripped before
    every test; a null or empty answer is cut off."""
    column = lambda name: F.col(name) if name in new.columns else F.lit(None).cast("string")
    clean = lambda c: F.coalesce(T.strip_wrapper(c), F.lit(""))
    rows = new.select("id", clean(F.col("summary")).alias("first"), column("stop_reason").alias("stop"), clean(column("rehedged")).alias("second"), clean(column("shorter")).alias("shorter"))
    rows = rows.withColumn("hedged", T.hedges(F.col("first"))).withColumn("text", F.when(F.col("hedged"), F.col("second")).otherwise(F.col("first")))
    refused = F.col("hedged") & ((F.col("second") == "") | T.hedges(F.col("second")))
    cut = T.looks_cut_off(F.col("text")) | (~F.col("hedged") & F.col("stop").eqNullSafe("max_tokens"))
    good = (F.col("shorter") != "") & ~T.looks_cut_off(F.col("shorter")) & ~T.hedges(F.col("shorter"))
    long = T.word_count(F.col("text")) > most_words
    better = good & (T.word_count(F.col("shorter")) < T.word_count(F.col("text")))
    reason = F.when(refused, "hedging").when(cut & ~good, "cut_off")
    text = F.when(cut | (long & better), F.col("shorter")).otherwise(F.col("text"))
    judged = rows.select("id", reason.alias("reason"), text.alias("summary"), (~cut & long & (T.word_count(text) > most_words)).alias("still_long"))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").select("id", "reason")


def verdicts(rows: DataFrame, given: DataFrame, reviewer: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Applies verdicts (id, verdict, summary): approve and correct take effect on pending rows only, flag leaves them."""
    joined = rows.join(given.select("id", F.col("verdict").alias("__verdict"), F.col("summary").alias("__new")), "id", "left")
    status = F.when(F.col("__verdict") == "approve", "approved").when(F.col("__verdict") == "correct", "edited")
    hit = (F.col("summary_status") == "pending") & status.isNotNull()
    put = {"ai_summary": F.when(F.col("__verdict") == "correct", F.col("__new")).otherwise(F.col("ai_summary")), "summary_status": status, "reviewed_by": F.lit(f"pipeline:{reviewer}"), "reviewed_at": now}
    done = changes.compare_and_set(joined, hit, put)
    log = done.filter("matched").select(F.col("id").alias("node_id"), now.alias("created_at"), F.concat(F.lit("summary_"), "summary_status").alias("change_type"))
    return done.select(*rows.columns), log


def redo(rows: DataFrame, given: DataFrame, now: Column) -> DataFrame:
    """Log rows of re-reviews whose summary differs from the one that is live."""
    both = rows.join(given.select("id", F.col("summary").alias("__new")), "id")
    return both.filter(~F.col("ai_summary").eqNullSafe(F.col("__new"))).select(F.col("id").alias("node_id"), now.alias("created_at"), F.lit("summary_edited").alias("change_type"))


def text_changes(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Log rows of a new version: text_updated, links_updated where only markup differs, added, removed."""
    kinds = {"changed": "text_updated", "markup": "links_updated", "new": "added", "obsolete": "removed"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    found = changes.difference(old, new).filter("change <> 'identical'")
    return found.select(F.col("id").alias("node_id"), now.alias("created_at"), table[F.col("change")].alias("change_type"))


def relabelled(log: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """The log with the type of the first rule whose condition holds."""
    kind = F.col("change_type")
    for test, name in reversed(rules):
        kind = F.when(F.coalesce(test, F.lit(False)), name).otherwise(kind)
    return log.withColumn("change_type", kind)


def demand(rows: DataFrame, good: Column, what: str) -> DataFrame:
    """``rows``, or an error if one of them breaks a condition."""
    if not rows.filter(~F.coalesce(good, F.lit(False))).isEmpty():
        raise ValueError(f"rows break: {what}")
    return rows


def finalized(log: DataFrame, held: DataFrame, imported: DataFrame, since: Column) -> DataFrame:
    """The log of an import: where the source's version (key, version) didn't change, its text changes since the start of the run
    were corrections of transcription, not of the rule."""
    same = held.join(imported.select("key", F.col("version").alias("now")), "key").filter(F.col("version").eqNullSafe(F.col("now"))).select(F.col("key").alias("reg_key")).withColumn("same", F.lit(True))
    joined = log.join(same, "reg_key", "left")
    fix = F.col("same") & (F.col("created_at") >= since) & F.col("change_type").isin("text_updated", "added", "removed")
    return joined.withColumn("change_type", F.when(fix, "transcription_corrected").otherwise(F.col("change_type"))).select(*log.columns)


def archive(rows: DataFrame, where: Column, path: str) -> int:
    """Writes rows to an archive and holds its count against the source's."""
    kept = rows.filter(where)
    kept.write.mode("errorifexists").parquet(path)
    n, there = kept.count(), rows.sparkSession.read.schema(kept.schema).parquet(path).count()
    if n != there:
        raise ValueError(f"{there} of {n} rows archived")
    return n


def without_surplus(held: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks of nodes (id, chunk_index) whose index is beyond the number that the node has now (id, n_chunks) go."""
    return held.join(counts.select("id", "n_chunks"), "id", "left").filter(F.col("n_chunks").isNull() | (F.col("chunk_index") < F.col("n_chunks"))).drop("n_chunks")


def refresh(build, root: str, spark: SparkSession) -> str:
    """Builds a table into a new folder under ``root`` and then points to it; if building fails, the old one stays current."""
    import uuid

    path = f"{root}/{uuid.uuid4().hex}"
    build().write.parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return path


def current(root: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(spark.read.schema("path string").json(f"{root}/current").first()["path"])


def log_query(spark: SparkSession, path: str, user: str, text: str, ids: list[str], top_score: float | None, ms: int) -> None:
    """Appends a search to the query log."""
    row = spark.createDataFrame([(user, text, ids, top_score, ms)], "user string, query string, result_ids array<string>, top_score double, latency_ms int")
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def dead_letters(rows: DataFrame, path: str) -> None:
    """Appends (id, reason) as JSON lines."""
    rows.select("id", "reason", F.current_timestamp().alias("at")).write.mode("append").json(path)


def report(rows: DataFrame, title: str, most: int = 200) -> str:
    """A Markdown table of a small aggregate; what is beyond ``most`` rows is said."""
    got = rows.limit(most + 1).collect()
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got[:most]]
    return "\n".join([f"# {title}", "", *head, *body, *(["", f"more than {most} rows"] if len(got) > most else [])]) + "\n"


def manifest_put(old: DataFrame, new: DataFrame) -> DataFrame:
    """A manifest (key, fields...) with the entries of ``new``; fields that it leaves null stay."""
    names = [c for c in old.columns if c != "key"]
    both = old.join(new.select("key", *[F.col(c).alias(f"__{c}") for c in names]), "key", "full_outer")
    return both.select("key", *[F.coalesce(f"__{c}", c).alias(c) for c in names])
