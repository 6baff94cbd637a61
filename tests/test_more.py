import pyspark.sql.functions as F

from weftline.functions import html as H
from weftline.functions import text as T
from weftline.operators import lexical, links
from weftline.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_lead(spark):
    r = one(spark, "Storage tanks. Owners must act.", T.lead)
    assert (r.lead, r.rest) == ("Storage tanks", "Owners must act.")
    assert one(spark, "owners must act.", T.lead).lead is None


def test_edits_of_form_only(spark):
    df = spark.createDataFrame([("a **b** c", "a b c"), ("a b", "a c")], "p string, q string")
    assert [r.y for r in df.select(T.markdown_only(F.col("p"), F.col("q")).alias("y")).collect()] == [True, False]
    df = spark.createDataFrame([("each volatile organic compound (VOC) here", "each VOC here"), ("a big tank (VOC)", "a VOC")], "p string, q string")
    assert [r.y for r in df.select(T.expansion_removed(F.col("p"), F.col("q")).alias("y")).collect()] == [True, False]


def test_phrases(spark):
    df = spark.createDataFrame([(0, 3, 1)], "a long, r long, c long")
    got = df.select(T.transcript_line({"added": F.col("a"), "reviewed": F.col("r"), "corrected": F.col("c")}).alias("x")).first().x
    assert got == "2 summaries checked, 1 summary corrected"
    assert one(spark, "SELECT 1 -- x\n /* y */ FROM  t", T.sql_text) == "select 1 from t"


def test_sanitized(spark):
    assert one(spark, '<p onclick="x" class="c">a<script>b</script><a href="javascript:1">c</a> &lt;d</p><img src=x>', H.sanitized) == '<p class="c">a<a>c</a> &lt;d</p>'


def test_places():
    assert H.letters("<b>A</b>-1") == ("a1", [3, 9])
    assert H.place_of("x <b>Ta</b>nk one", "tank") == 5 and H.place_of("x", "tank") == -1


def test_insert_and_difference(spark):
    df = spark.createDataFrame([("x <b>Ta</b>nk", "tank", "!", "same start A", "same start B")], "h string, w string, n string, p string, q string")
    r = df.select(H.inserted(F.col("h"), F.col("w"), F.col("n")).alias("i"), H.first_difference(F.col("p"), F.col("q"), 3).alias("d")).first()
    assert r.i == "x <b>!Ta</b>nk" and (r.d.was, r.d.now) == ("rt A", "rt B")


def test_linker(spark):
    html, n = links.linked_text('See II.B and II.B.9, <a href="#x">II.B</a> and XII.B or II.Bc', {"II.B": "s-II-B", "II.B.9": "s-9"})
    assert n == 2 and html.startswith('See <a href="#s-II-B">II.B</a> and <a href="#s-9">II.B.9</a>, <a href="#x">II.B</a> and XII.B or II.Bc')
    nodes = spark.createDataFrame([("n", "see II.B"), ("m", "none")], "id string, full_text string")
    found = spark.createDataFrame([("n", "II.B", "s-II-B"), ("n", "V", None)], "id string, label string, target string")
    assert {r.id: r.n_links for r in links.link_all(nodes, found).collect()} == {"n": 1, "m": 0}
    assert one(spark, 'a <a href="#x">b</a>', links.stripped) == "a b"


def test_jump_and_merge(spark):
    nodes = spark.createDataFrame([("b", "§ 7.10", "T", 2), ("a", "§ 7.1", "T", 1), ("c", "§ 8", "T", None)], "id string, citation string, title string, sort_order long")
    assert [r.id for r in lexical.jump(nodes, "§7.1").collect()] == ["a", "b"]
    p = lambda *ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, position int")
    assert [r.id for r in lexical.merged(p("x", "y"), p("y", "z")).orderBy("position").collect()] == ["x", "y", "z"]


def test_xml_tables_and_lists(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<R><TABLE><CAPTION>Table 1 - Limits</CAPTION><TR><TH>a</TH><TH>b</TH></TR><TR><TD>1</TD><TD>2</TD></TR></TABLE></R>")
    r = files.xml_tables(spark, str(tmp_path / "t.xml")).first()
    assert r.key == "table1limits" and r.rows == [["a", "b"], ["1", "2"]]
    (tmp_path / "q.sql").write_text("select * from (values ('a''b', 1), ('c', 2)) as t(x);")
    assert [r.value for r in files.values_list(spark, str(tmp_path / "q.sql")).collect()] == ["a'b", "c"]


def test_linked_methods_on_texts_with_citations_of_their_own(spark, tmp_path):
    import duckdb

    from weftline.plans import catalog, more  # noqa: F401

    texts = ["rules 2 and 1 of them", "a < b and c > d", "see Method 1 and EPA Methods 3B and 1, done", '<a href="#x">this and that</a>', "x and and 3B and C.F.R", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["linked_methods"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog.SQL["linked_methods"]).fetchall())


def test_outlines_make_no_group_a_document(spark):
    from weftline.operators import documents

    rows = [("d1", i, x) for i, x in enumerate(["Intro", "", "(a) one", "goes on", "(1) deep", "(b) two", "(1) again", "(2) next"])] + [("d2", 0, "plain"), ("d2", 1, "more")]
    df = documents.outlines(spark.createDataFrame(rows[::-1], "doc string, line int, text string"))
    got = sorted((r.doc, r.label_path, r.parent_path, r.text) for r in df.collect())
    want = [("d1", "", None, "Intro"), ("d1", "a", None, "one goes on"), ("d1", "a.1", "a", "deep"), ("d1", "b", None, "two"), ("d1", "b.1", "b", "again"), ("d1", "b.2", "b", "next"), ("d2", "", None, "plain more")]
    assert got == want and "InPandas" not in df._jdf.queryExecution().toString()
