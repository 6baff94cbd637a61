import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.functions import labels as L
from weftline.operators import context, writes


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")

ROW = "id string, ai_summary string, summary_original string, summary_model string, summary_generated_at timestamp, summary_status string, reviewed_by string, reviewed_at timestamp"


def rows(spark):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("a", "old", "first", "m", day, "approved", "pipeline:x", day), ("b", None, None, None, None, "pending", None, None), ("c", "same", "same", "m", day, "pending", None, None)], ROW)


def test_summary_writes(spark):
    new = spark.createDataFrame([("a", "new", "m2"), ("b", "fresh", "m2")], "id string, summary string, model string")
    after, log = writes.summaries(rows(spark), new, now())
    got = {r.id: r for r in after.collect()}
    assert (got["a"].ai_summary, got["a"].summary_original, got["a"].summary_status, got["a"].reviewed_by) == ("new", "first", "pending", None)
    assert (got["b"].summary_original, got["c"].ai_summary) == ("fresh", "same")
    assert [(r.node_id, r.change_type) for r in log.collect()] == [("a", "summary_regenerated")]


def test_gate(spark):
    long, short = "w " * 200 + ".", "w " * 90 + "."
    rows = [
        ("1", "<answer>Fine.</answer>", None, None, None), ("2", "It is not specified.", None, None, None), ("3", "and then", None, None, None), ("4", "", None, None, "Now whole."), ("5", long, None, None, None),
        ("6", "no date is given.", None, "A date.", None), ("7", "no date.", None, "unclear.", "x."), ("8", "Whole.", "max_tokens", None, "Shorter."), ("9", "Whole.", "max_tokens", None, "half of"),
        ("10", long, None, None, short), ("11", long, None, None, "w w not stated."), ("12", "unclear.", "max_tokens", "Fine then.", None), ("13", None, None, None, None), ("14", "It appears to be so.", None, None, None),
    ]
    good, bad = writes.gate(spark.createDataFrame(rows, "id string, summary string, stop_reason string, rehedged string, shorter string"))
    assert {r.id: (r.summary, r.still_long) for r in good.collect()} == {
        "1": ("Fine.", False), "4": ("Now whole.", False), "5": (long, True), "6": ("A date.", False), "8": ("Shorter.", False), "10": (short, False), "11": (long, True), "12": ("Fine then.", False), "14": ("It appears to be so.", False),
    }
    assert {r.id: r.reason for r in bad.collect()} == {"2": "hedging", "3": "cut_off", "7": "hedging", "9": "cut_off", "13": "cut_off"}
    only, _ = writes.gate(spark.createDataFrame([("1", "Fine.")], "id string, summary string"))
    assert only.count() == 1


def test_verdicts_touch_pending_rows_only(spark):
    given = spark.createDataFrame([("a", "correct", "x"), ("b", "flag", None), ("c", "correct", "better")], "id string, verdict string, summary string")
    after, log = writes.verdicts(rows(spark), given, "m", now())
    assert {r.id: (r.ai_summary, r.summary_status) for r in after.collect()} == {"a": ("old", "approved"), "b": (None, "pending"), "c": ("better", "edited")}
    assert [(r.node_id, r.change_type) for r in log.collect()] == [("c", "summary_edited")]


def test_failed_refresh_keeps_the_table(spark, tmp_path):
    root = str(tmp_path / "t")
    writes.refresh(lambda: spark.range(3), root, spark)
    with pytest.raises(ZeroDivisionError):
        writes.refresh(lambda: 1 / 0, root, spark)
    assert writes.current(root, spark).count() == 3


def test_archive_and_demand(spark, tmp_path):
    assert writes.archive(spark.range(10), F.col("id") < 4, str(tmp_path / "a")) == 4
    with pytest.raises(ValueError):
        writes.demand(spark.range(3), F.col("id") < 2, "small ids")


def test_manifest_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([("k", "a", "b"), ("l", "c", "d")], "key string, kind string, as_of string")
    new = spark.createDataFrame([("k", None, "z"), ("m", "q", None)], "key string, kind string, as_of string")
    assert {r.key: (r.kind, r.as_of) for r in writes.manifest_put(old, new).collect()} == {"k": ("a", "z"), "l": ("c", "d"), "m": ("q", None)}


def test_log_and_report(spark, tmp_path):
    writes.log_query(spark, str(tmp_path / "q"), "u", "tank", ["a", "b"], 0.5, 12)
    writes.log_query(spark, str(tmp_path / "q"), "u", "tank", [], None, 9)
    assert spark.read.parquet(str(tmp_path / "q")).filter("size(result_ids) = 2").count() == 1
    assert "| id |" in writes.report(spark.range(3), "Ids", 2) and "more than 2 rows" in writes.report(spark.range(3), "Ids", 2)


def test_labels(spark):
    df = spark.createDataFrame([("reg7",), ("gp03",), ("oooob",), ("reg10",), ("xyz9q",)], "k string")
    assert [r.n for r in df.select(L.display_name(F.col("k")).alias("n")).collect()] == ["Regulation 7", "General Permit GP03", "Subpart OOOOb", "Regulation 10", "XYZ9Q"]
    assert [r.k for r in df.orderBy(L.order_key(F.col("k"))).collect()] == ["reg7", "reg10", "gp03", "xyz9q", "oooob"]
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one("3162.2-10", L.number_key) == [3162, 2, 10]
    assert one("2024-02-30", L.public_day) is None and one("2024-02-29", L.public_day) == dt.date(2024, 2, 29)
    assert one("Rules effective January 5, 2024.", L.printed_effective_date) == dt.date(2024, 1, 5)
    pats = {"reg7": r"\breg(ulation)? 7\b", "gp03": r"\bgp03\b"}
    assert one("does GP03 change Regulation 7", lambda c: L.named_documents(c, pats)) == ["gp03", "reg7"]
    assert one("does GP03 change", lambda c: L.scope(c, pats)) == "gp03"
    assert one("general permit no. 3 or GP 10 or gp03", L.permit_numbers) == ["GP03", "GP10"]
    assert one("ECD test", lambda c: L.expanded(c, {"ECD": "enclosed device"})) == "ECD (enclosed device) test"


def test_context_blocks(spark):
    data = [("r", None, "Root", "R", "root text", 0), ("a", "r", "Part A", "A", "part text", 1), ("b", "a", "Scope", "A.1", "leaf text", 2)]
    nodes = spark.createDataFrame(data, "id string, parent_id string, title string, citation string, full_text string, sort_order long")
    leaf = nodes.filter("id = 'b'")
    assert context.ancestor_block(nodes, leaf).first().block == "R Root: root text\nA Part A: part text"
    assert context.ancestor_block(nodes, leaf, budget=25, least=10).first().block == "A Part A: part text"
    full, short = (context.descendant_block(nodes, nodes.filter("id = 'r'"), n).first() for n in (100, 1))
    assert (full.block, full.outline) == ("A. Part A: part text\n  A.1. Scope: leaf text", False)
    assert (short.block, short.outline) == ("A. Part A\n  A.1. Scope\n[2 provisions inside; bodies omitted for length]", True)
    untitled = nodes.withColumn("title", F.when(F.col("id") != "b", F.lit("")).otherwise(F.lit("leaf"))).withColumn("full_text", F.when(F.col("id") == "a", F.lit("<p>" + "one two " * 8 + "</p>")).otherwise(F.col("full_text")))
    pages = context.descendant_block(untitled, nodes.filter("id = 'r'"), 1, page_lines=2).orderBy("page").collect()
    assert [p.block for p in pages] == ["A. " + "one two " * 5 + "one two…\n  A.1. leaf", "[2 provisions inside; bodies omitted for length]"]
    assert context.descendant_block(untitled, nodes.filter("id = 'r'")).first().block.split("\n")[1] == "  A.1. leaf text"
    assert {r.id for r in context.prompts(nodes, nodes.select("id")).collect()} == {"r", "a"}


def test_prompts_strip_each_text_once_and_join_no_whole_ancestors(spark, monkeypatch):
    rows = [("r", None, "Root", "R", "<p>" + "Root text. " * 400 + "</p>", 0), ("s", None, None, "S", None, 1), ("a", "r", None, "A.", "word " * 30, 1), ("b", "r", "", None, "<b>b</b> " * 2999, 2), ("c", "a", "C \u00dc", "A.1", "c \u00fc one", 3), ("d", "b", "D", "D", "d " * 40, 1)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, title string, citation string, full_text string, sort_order long")
    stripped, carried = [], []
    strip, ancestors = context.T.strip_html, context.tree.ancestors
    monkeypatch.setattr(context.T, "strip_html", lambda c: stripped.append(1) or strip(c))
    monkeypatch.setattr(context.tree, "ancestors", lambda n, s, *a, **k: carried.extend(k.get("carry", ())) or ancestors(n, s, *a, **k))
    got = {(r.id, r.page): r.prompt for r in context.prompts(nodes, nodes.select("id")).collect()}
    assert stripped == [1] and carried == []
    assert set(got) == {("r", 0), ("a", 0), ("b", 0), ("d", 0)}
    word = "word " * 29 + "word"
    assert got["r", 0].endswith("Below:\nA. " + "word " * 11 + "word…\n  A.1. C \u00dc\nb. " + "b " * 11 + "b…\n  D. D\n[4 provisions inside; bodies omitted for length]")
    assert got["a", 0].startswith("Context:\nR Root: " + "Root text. " * 150) and got["a", 0].endswith("Provision:\nA.\n\nText:\n" + word + "\n\nBelow:\nA.1. c \u00fc one")
    assert len(got["a", 0]) < 2300 and got["d", 0].startswith("Context:\n: b b")
    skeleton, texts = nodes.select("id", "parent_id", "sort_order"), nodes.select("id", "citation", "title", "full_text")
    assert {(r.id, r.page): r.prompt for r in context.prompts(skeleton, nodes.select("id"), texts=texts).collect()} == got


def test_coverage_collapses_runs(spark):
    roots = spark.createDataFrame([("state", "Rules", n) for n in ("Regulation 3", "Regulation 4", "Regulation 7", "Code")], "jurisdiction_level string, heading string, name string")
    assert context.coverage(roots).first().names == ["Code", "Regulation 3–4", "Regulation 7"]


def test_cited_rows(spark):
    nodes = spark.createDataFrame([(f"s-{c}", "s") for c in "abcde"], "id string, parent_id string")
    rows = spark.createDataFrame([("s-e", "s", "see (a) through (c) and (e)")], "id string, parent_id string, full_text string")
    assert sorted(r.cited_id for r in context.cited_rows(rows, nodes).collect()) == ["s-a", "s-b", "s-c"]
