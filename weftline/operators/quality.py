"""Data-quality checks as a registry: each check is one aggregate row, the suite their union against baselines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import links, tree


@dataclass(frozen=True)
class Check:
    """severity: ERROR (any is a failure), GUARD (more than the baseline is), REVIEW or INFO (reported)."""

    name: str
    severity: str
    offenders: Callable[[DataFrame], DataFrame]
    baseline: int = 0
    condition: Column | None = None


def row_check(name: str, severity: str, condition: Column, baseline: int = 0) -> Check:
    """A check that each row decides by itself."""
    return Check(name, severity, lambda nodes: nodes.filter(condition).select("id"), baseline, condition)


def repeated_block(text: Column, n: int = 50, times: int = 3) -> Column:
    """The first ``n`` characters occur ``times`` times or more."""
    head = F.substring(text, 1, n)
    return (F.length(text) >= n) & ((F.length(text) - F.length(F.replace(text, head, F.lit("")))) / n >= times)


def duplicate_citations(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("reg_key", "citation").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n > 1").select("id")


def missing_targets(nodes: DataFrame) -> DataFrame:
    """Links to ids that don't exist, once each."""
    targets = links.link_targets(nodes).select("target").distinct()
    return targets.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select(F.col("target").alias("id"))


def registry() -> list[Check]:
    text, summary = F.col("full_text"), F.col("ai_summary")
    plain = T.strip_html_plain(text)
    return [
        row_check("empty_text", "ERROR", plain == ""),
        Check("orphan_parent", "ERROR", lambda n: tree.orphans(n).select("id")),
        Check("missing_link_target", "ERROR", missing_targets),
        row_check("self_parent", "ERROR", F.col("id") == F.col("parent_id")),
        Check("duplicate_citation", "GUARD", duplicate_citations),
        row_check("repeated_block", "GUARD", repeated_block(text)),
        row_check("summary_cut_off", "ERROR", (F.trim(summary) != "") & ~F.rtrim(summary).rlike(T.WHOLE)),
        row_check("summary_longer_than_text", "REVIEW", (F.length(plain) > 500) & (F.length(summary) > F.length(plain))),
        row_check("math_glyphs", "GUARD", text.rlike(r"[\x{1D400}-\x{1D7FF}]")),
        row_check("split_letters", "REVIEW", text.rlike(r"(?<!\w)(\p{L} ){4,}\p{L}(?!\w)")),
        row_check("markdown", "REVIEW", T.has_markdown(summary)),
        row_check("page_furniture", "GUARD", text.rlike(r"(?m)^\s*Page \d+ of \d+\s*$")),
        row_check("pending", "INFO", F.col("summary_status") == "pending"),
        row_check("rejected_visible", "INFO", (F.col("summary_status") == "rejected") & F.col("is_public")),
    ]


def suite(nodes: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """(name, severity, n, verdict) of every check. What rows decide by themselves is counted in one pass; other checks have plans of their own."""
    checks = checks or registry()
    local = [c for c in checks if c.condition is not None]
    out = None
    if local:
        counts = nodes.agg(*[F.count_if(c.condition).alias(f"c{i}") for i, c in enumerate(local)])
        pairs = F.array(*[F.struct(F.lit(c.name).alias("name"), F.col(f"c{i}").alias("n")) for i, c in enumerate(local)])
        out = counts.select(F.inline(pairs))
    for c in checks:
        if c.condition is None:
            row = c.offenders(nodes).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c.name).alias("name"), "n")
            out = row if out is None else out.unionByName(row)
    known = lambda value: F.coalesce(*[F.when(F.col("name") == c.name, F.lit(value(c))) for c in checks])
    severity, baseline = known(lambda c: c.severity), known(lambda c: c.baseline)
    verdict = F.when(F.col("n") <= baseline, "ok").when(severity.isin("ERROR", "GUARD"), "fail").otherwise("look")
    return out.select("name", severity.alias("severity"), "n", verdict.alias("verdict"))


def stale_pending(rows: DataFrame, now: Column, hours: int = 24, allowed: list[str] = ()) -> DataFrame:
    """Rows that wait for review since more than ``hours``; ids of the allow-list don't count."""
    old = F.coalesce("summary_generated_at", "updated_at") < now - F.expr(f"interval {hours} hours")
    return rows.filter((F.col("summary_status") == "pending") & old & ~F.col("id").isin(list(allowed)))


def approvals_without_stamp(rows: DataFrame) -> DataFrame:
    """Approved rows without a reviewer of the pipeline or a date: what the approval guard refuses."""
    stamped = F.col("reviewed_by").startswith("pipeline:") & F.col("reviewed_at").isNotNull()
    return rows.filter(F.col("summary_status").isin("approved", "edited") & ~F.coalesce(stamped, F.lit(False)))


def request_problems(rows: DataFrame) -> DataFrame:
    """Adds problems: names of the rules that a request (email, subject, body, source_url, jurisdiction) breaks."""
    rules = {
        "email": ~F.coalesce("email", F.lit("")).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "subject": ~F.length(F.trim(F.coalesce("subject", F.lit("")))).between(3, 200),
        "body": F.length(F.coalesce("body", F.lit(""))) > 4000,
        "source_url": F.coalesce("source_url", F.lit("")).rlike(".") & ~F.coalesce("source_url", F.lit("")).rlike(r"^https?://[^\s/]+\.[^\s/]+"),
        "jurisdiction": ~F.coalesce("jurisdiction", F.lit("")).isin("state", "federal", "county"),
    }
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()])))


def verdicts(raw: DataFrame, growth: float = 1.5) -> DataFrame:
    """(id, verdict, summary, problem): review answers (id, raw, before) parsed and held to their contract."""
    parsed = raw.withColumn("v", F.from_json(T.json_in(F.col("raw")), "verdict string, corrected_summary string, findings array<string>"))
    verdict, new = F.lower("v.verdict"), F.col("v.corrected_summary")
    problem = (
        F.when(F.col("v").isNull() | verdict.isNull(), "no verdict").when(~verdict.isin("approve", "correct", "flag"), "unknown verdict")
        .when((verdict == "correct") & (F.coalesce(F.trim(new), F.lit("")) == ""), "no correction")
        .when((verdict == "approve") & (F.size(F.coalesce("v.findings", F.array().cast("array<string>"))) > 0), "findings with approval")
        .when((verdict == "correct") & (F.length(new) > growth * F.length("before") + 200), "grew too much")
        .when((verdict == "correct") & T.looks_cut_off(new), "cut off").when((verdict == "correct") & T.has_markdown(new), "markdown")
    )
    return parsed.select("id", verdict.alias("verdict"), new.alias("summary"), problem.alias("problem"))
