"""Small functions: each on the cases that its docstring names."""

import datetime as dt

from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import labels as L
from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import documents, hybrid, lexical, links, writes
from weftline.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_texts(spark):
    assert one(spark, "§ 60.5 (A)", T.jump_key) == "60.5(a)"
    assert one(spark, 'a <b>x</b> <MARK>y</mark> <i class="z">', T.only_marks) == "a x <MARK>y</mark> "
    assert one(spark, "# Head\n- **bold** and *it* and `code`\n2*3*4", T.strip_markdown) == "Head\nbold and it and code\n2*3*4"
    assert [one(spark, x, T.needs_citation) for x in ("by May", "in 2024", "5 ppm", "5 ppmv", "1,000 tons", "maybe", "a 50%")] == [True, True, True, False, True, False, True]
    assert [one(spark, n, lambda c: T.count_phrase(c, "row", "rows"), "long") for n in (0, 1, 12345)] == ["no rows", "1 row", "12,345 rows"]


def test_values(spark):
    assert one(spark, dt.date(2024, 2, 9), V.day_month_year, "date") == "9 February 2024"
    pairs = spark.createDataFrame([("a-1", "a-1-2"), ("a-1-2", "a-1"), ("a-1", "a-1"), ("a-1", "a-10"), ("a", "b")], "a string, b string")
    assert [r[0] for r in pairs.select(V.related(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]


def test_labels(spark):
    assert [one(spark, x, L.label_of) for x in ("sec-7-I-A-2", "sec-7-P-B", "other")] == ["I.A.2", "Part B", ""]
    rows = spark.createDataFrame([("rejected", None), ("approved", dt.datetime(2024, 1, 1, 3)), ("pending", None), (None, None)], "s string, t timestamp")
    assert [r[0] and tuple(r[0]) for r in rows.select(L.badge(F.col("s"), F.col("t"))).collect()] == [None, ("reviewed", dt.date(2023, 12, 31)), ("pending", None), ("pending", None)]
    seen = spark.createDataFrame([(True, True), (True, False), (False, False)], "p boolean, d boolean")
    assert [r[0] for r in seen.select(L.destination("visitor", F.col("p"), F.col("d"))).collect()] == ["reader", "preview", "signup"]
    assert seen.select(L.destination("subscriber", F.col("p"), F.col("d"))).first()[0] == "reader"
    assert [one(spark, x, lambda c: L.context_key(c, ["oooo", "jjjj"])) for x in ("sec-ooooa-1", "sec-jjjj-2", "sec-7-1", "x")] == ["ooooa", "jjjj", None, None]


def test_html(spark):
    assert H.clean('<p onclick="x" class="c">a &amp; b<script>no</script><a href="javascript:x">l</a><a href="#y">m</a><br/><h1>t</h1>') == '<p class="c">a &amp; b<a>l</a><a href="#y">m</a><br>t'
    assert one(spark, None, H.sanitized) is None
    linked = links.linked_html(F.lit('see I.A and <a href="#I.A">I.A</a> I.AB'), "I\\.A", "t")
    assert spark.range(1).select(linked).first()[0].startswith('see <a href="#t">')
    assert documents.table_html("C & D", [["H"], ["<x>"]]) == "<table><caption>C &amp; D</caption><tr><th>H</th></tr><tr><td>&lt;x&gt;</td></tr></table>"


def test_body_start(spark):
    rows = [("f", 1, i, t) for i, t in enumerate(["Contents", "PART A", "PART B", "PART A", "text", "Source: 60 FR", "body", "more"])] + [("g", 1, i, t) for i, t in enumerate(["PART A", "x"])]
    lines = spark.createDataFrame(rows, "file string, page int, line int, text string")
    got = [(r.file, r.text) for r in files.body_start(lines, "^PART A").orderBy("file", "line").collect()]
    assert got == [("f", "body"), ("f", "more"), ("g", "x")]


def test_stored_words_and_dead_letters(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A.1", "Tanks", "gas tank", "k", 1), ("b", "B.1", "Gas", "oil", "k", 2)], "id string, citation string, title string, full_text string, reg_key string, sort_order long")
    lexical.store(lexical.index(nodes), str(tmp_path / "w"), 3)
    held = spark.read.parquet(str(tmp_path / "w"))
    assert {r.id for r in lexical.matches(held, lexical.user_query("gas")).collect()} == {"a", "b"} and held.count() == lexical.index(nodes).count()
    for reason in ("x", "y"):
        writes.dead_letters(spark.createDataFrame([("a", reason)], "id string, reason string"), str(tmp_path / "dead"))
    assert sorted((r.id, r.reason) for r in spark.read.json(str(tmp_path / "dead")).collect()) == [("a", "x"), ("a", "y")]


def test_grouped_hits(spark):
    hits = spark.createDataFrame([(i, f"r{i}", "g" if i < 4 else "other") for i in range(1, 8)], "position int, id string, k string")
    got = {r.id: (r.shown, r.n_hidden) for r in hybrid.grouped(hits, F.col("k"), 2, 1).collect()}
    assert got == {"r1": (True, 1), "r2": (True, 1), "r3": (False, 1), "r4": (True, 3), "r5": (False, 3), "r6": (False, 3), "r7": (False, 3)}
