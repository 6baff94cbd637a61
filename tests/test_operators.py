import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import changes, documents, hybrid, lexical, links, quality, sampling, tree, vector
from weftline.sources import files


def ts(h, m=0, s=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m, seconds=s)


def log(spark, rows):
    return spark.createDataFrame([(i, n, n.split("-")[1], t, k) for i, (n, t, k) in enumerate(rows)], "change_id long, node_id string, reg_key string, created_at timestamp, change_type string")


def test_pairs_inside_on_and_beyond_the_limit(spark):
    rows = log(spark, [("sec-a-1", ts(0), "summary_regenerated"), ("sec-a-1", ts(24), "summary_approved"), ("sec-a-2", ts(0), "summary_regenerated"), ("sec-a-2", ts(23, 59), "summary_edited"), ("sec-a-3", ts(1), "summary_regenerated"), ("sec-a-3", ts(1), "summary_approved")])
    got = {(r.node_id, r.change_type) for r in changes.classified(rows).collect()}
    assert got == {("sec-a-1", "summary_rewritten_reviewed_later"), ("sec-a-1", "summary_approved"), ("sec-a-2", "summary_rewritten_corrected"), ("sec-a-3", "summary_rewritten_reviewed")}


def test_pending_outcome_and_release_gate(spark):
    rows = log(spark, [("sec-a-1", ts(9), "summary_regenerated"), ("sec-b-1", ts(9), "added")])
    status = spark.createDataFrame([("sec-a-1", "pending")], "id string, summary_status string")
    counts = changes.daily_counts(changes.classified(rows, status), spark.createDataFrame([("b",)], "reg_key string")).collect()
    assert [(r.reg_key, r.change_type, r.provision_count) for r in counts] == [("a", "summary_rewritten_pending", 1)]


def test_difference(spark):
    old = spark.createDataFrame([("1", "a b"), ("2", "a"), ("3", "x")], "id string, full_text string")
    new = spark.createDataFrame([("1", "<b>a</b> b"), ("2", "c"), ("4", "y")], "id string, full_text string")
    assert dict(changes.difference(old, new).collect()) == {"1": "markup", "2": "changed", "3": "obsolete", "4": "new"}


def test_upsert_and_first_write(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert sorted(changes.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(changes.first_write(old, new.drop("seq").filter("v <> 'd'"), ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "e")]


def test_rehash_only_where_the_old_hash_is_held(spark):
    held = spark.createDataFrame([("a", 0, "h1"), ("b", 0, "h2")], "id string, chunk_index int, text_hash string")
    asked = spark.createDataFrame([('[{"id":"a","chunk_index":0,"old":"h1","new":"n"},{"id":"b","chunk_index":0,"old":"other","new":"n"}]',)], "changes string")
    assert {r.id: r.text_hash for r in changes.rehashed(held, asked).collect()} == {"a": "n", "b": "h2"}


def forest(spark):
    rows = [("r", None, "Root", "Root"), ("a", "r", "Part A", "A"), ("b", "a", "B.", "B."), ("c", "b", "Scope", "C"), ("x", "gone", "Lost", "X")]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, parent_id string, title string, citation string, sort_order long")


def test_breadcrumbs_skip_root_and_bare_numbering(spark):
    got = {r.id: r.path for r in tree.breadcrumbs(forest(spark)).collect()}
    assert got == {"r": None, "a": None, "b": "Part A", "c": "Part A", "x": None}


def test_cycles_end_and_long_chains_are_walked_to_their_ends(spark):
    ring = spark.createDataFrame([("p", "q", "P", "1", 1), ("q", "p", "Q", "2", 2)], "id string, parent_id string, title string, citation string, sort_order long")
    assert tree.ancestors(ring).agg(F.max("distance")).first()[0] == 1  # where the id comes back
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, f"T{i}", f"c{i}", i) for i in range(15)], "id string, parent_id string, title string, citation string, sort_order long")
    assert {r.id: r.depth for r in tree.depths(chain).collect()} == {f"n{i}": i for i in range(15)}
    some = tree.ancestors(chain, chain.filter("id in ('n3', 'n14')"), carry=("title",))
    assert sorted(tuple(r) for r in some.collect()) == sorted((f"n{i}", f"n{i - k}", k, f"T{i - k}") for i in (3, 14) for k in range(1, i + 1))
    assert tree.ancestors(chain, max_depth=4).agg(F.max("distance")).first()[0] == 4
    below = {r.id: (r.depth, r.position) for r in tree.descendants(chain, chain.filter("id = 'n2'")).collect()}
    assert below == {f"n{i}": (i - 2, i - 2) for i in range(3, 15)}


def test_orphans(spark):
    assert [r.id for r in tree.orphans(forest(spark)).collect()] == ["x"]


def test_descendants_are_in_reading_order(spark):
    got = tree.descendants(forest(spark), forest(spark).filter("id = 'r'"), 4).orderBy("position").collect()
    assert [(r.id, r.depth) for r in got] == [("a", 1), ("b", 2), ("c", 3)]


def test_user_query():
    q = lexical.user_query('tank or vessel "produced water" -gas')
    assert q.clauses == [[("tank",), ("vessel",)], [("produced", "water")]] and q.without == ["gas"]
    assert lexical.user_query("").clauses == []
    assert lexical.expanded_query("ECD testing of", {"ecd": "enclosed combustion device"}).clauses == [[("ecd",), ("enclosed", "combustion", "device")], [("testing",)]]


def nodes(spark):
    rows = [("sec-a-1", "A.1", "Tanks", "Produced water tank rules apply"), ("sec-a-2", "A.2", "Vessels", "Water produced in a vessel"), ("sec-b-1", "B.1", "Gas", "produced water and gas")]
    return spark.createDataFrame([(i, c, t, x, i.split("-")[1], k) for k, (i, c, t, x) in enumerate(rows)], "id string, citation string, title string, full_text string, reg_key string, sort_order long")


@pytest.mark.parametrize(("q", "want"), [("produced water", {"sec-a-1", "sec-a-2", "sec-b-1"}), ('"produced water"', {"sec-a-1", "sec-b-1"}), ("water -gas", {"sec-a-1", "sec-a-2"}), ("tank or vessel", {"sec-a-1", "sec-a-2"}), ("nothing", set()), ("", set())])
def test_matches(spark, q, want):
    assert {r.id for r in lexical.matches(lexical.index(nodes(spark)), lexical.user_query(q)).collect()} == want


def test_citation_hit_and_highlight(spark):
    got = lexical.search(nodes(spark), "b.1").collect()
    assert [r.id for r in got] == ["sec-b-1"]
    top = lexical.search(nodes(spark), "vessel").first()
    assert "<mark>vessel</mark>" in top.headline


def test_question_modes():
    q = hybrid.Question("what does the federal rule say here")
    assert q.long and q.federal and not q.state and not q.short and q.pool == 60
    assert hybrid.Question("tank").short and hybrid.Question("x", 0).n == 20


def test_fusion_needs_both_legs(spark):
    kw = spark.createDataFrame([("a", 1, 0.7), ("b", 2, None)], "id string, kw_rank int, kw_score float")
    sem = spark.createDataFrame([("a", 0.7, 1), ("c", 0.6, 2)], "id string, score float, sem_rank int")
    got = {r.id: (round(r.fused, 5), r.keyword_hit) for r in hybrid.fused(kw, sem, hybrid.Question("tank"), 0.02).collect()}
    assert got == {"a": (round(2 / 61, 5), True), "b": (round(1 / 62, 5), True), "c": (round(1 / 62, 5), False)}
    long = {r.id: round(r.fused, 4) for r in hybrid.fused(kw, sem, hybrid.Question("a b c d e f g"), 0.02).collect()}
    assert long == {"a": 0.32, "b": round(0.01 + 0.02 / 1.1, 4), "c": 0.2}


def test_list_completion(spark):
    hits = spark.createDataFrame([("z", 1), ("k1", 2), ("k3", 3)], "id string, position int")
    tab = spark.createDataFrame([("z", None, 1), ("p", None, 2), ("k1", "p", 3), ("k2", "p", 4), ("k3", "p", 5)], "id string, parent_id string, sort_order long")
    assert [r.id for r in hybrid.complete_lists(hits, tab).orderBy("position").collect()] == ["z", "p", "k1"]


def test_facets_and_routes(spark):
    df = spark.createDataFrame([("a flare at a well",), ("flare or tank",)], "q string")
    f = {"kind": {"flare": "flare", "tank": "tank"}}
    assert [r.f for r in df.select(hybrid.facets(F.col("q"), f).alias("f")).collect()] == [{"kind": "flare"}, {}]
    assert [r.k for r in df.select(hybrid.route(F.col("q"), [("wells", "well"), ("tanks", "tank")]).alias("k")).collect()] == ["wells", "tanks"]


def test_neighbours_exclude_the_family(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [1.0, 0.1], "x"), ("c", [0.9, 0.4], "y")], "id string, embedding array<float>, fam string")
    got = {(r.id, r.neighbor_id) for r in vector.neighbours(rows, 1, blocks=2, family="fam").collect()}
    assert got == {("a", "c"), ("b", "c"), ("c", "b")}


def slices(body, size, overlap):
    """What pieces have to be: windows that end at a space of their second half."""
    out, at = [], 0
    while at < len(body) and len(body) > size:
        window = body[at : at + size]
        if at + size < len(body) and " " in window[size // 2 :]:
            window = window[: window.rindex(" ")]
        out += [window.strip()] if window.strip() else []
        if at + len(window) >= len(body):
            break
        at = max(at + len(window) - overlap, at + 1)
    return out if len(body) > size else [body]


@pytest.mark.parametrize(("size", "overlap"), [(200, 20), (50, 10), (50, 40), (7, 6), (6000, 600)])
def test_pieces(spark, size, overlap):
    r = random.Random(size + overlap)
    bodies = ["short", "", "x" * 450, "word " * 400, " " * 300, *["".join(r.choice("abcde    \n") for _ in range(r.randint(1, 700))) for _ in range(20)]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = {r.i: r.p for r in df.select("i", documents.pieces(F.col("b"), size, overlap).alias("p")).collect()}
    for i, b in enumerate(bodies):
        assert got[i] == slices(b, size, overlap), i
    with pytest.raises(ValueError):
        documents.pieces(F.col("b"), 10, 10)


def test_chunk_headers_and_texts(spark):
    rows = [("sec-ooooa-1", None, "60.1", "Scope", "state", "<p>Body one</p>", "Sum.", "approved"), ("sec-7-B", "sec-ooooa-1", None, "T", "federal", "Text", "No.", "rejected"), ("other", None, "C", None, "county", "", None, "pending")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, citation string, title string, jurisdiction_level string, full_text string, ai_summary string, summary_status string").withColumn("reg_key", F.lit("k"))
    got = {r.id: r.text for r in documents.chunk_texts(nodes, "m").collect()}
    assert got == {
        "sec-ooooa-1": "Colorado regulation OOOOA: 60.1 — Scope\nSummary: Sum.\nText: Body one",
        "sec-7-B": "Federal regulation 7:  — T\nUnder 60.1: Body one\nText: Text", "other": "county: C —",
    }
    long = nodes.filter("id = 'other'").withColumn("ai_summary", F.lit("A sentence here. " * 60)).withColumn("full_text", F.lit("word " * 2000))
    texts = [r.text for r in documents.chunk_texts(long, "m").orderBy("chunk_index").collect()]
    assert len(texts) == 3 and len(texts[0].split("Summary: ")[1].split("\n")[0]) <= 600 and texts[2].endswith("A sentence here.") and "Text:" not in texts[2]


def test_outline_of_ambiguous_labels():
    text = ["A. First", "1. one", "a. alpha", "more", "b. beta", "2. two", "B. Second", "1. again"]
    got = documents.outline(pd.DataFrame({"doc": "d", "line": range(len(text)), "text": text}))
    assert got.label_path.tolist() == ["A", "A.1", "A.1.a", "A.1.b", "A.2", "B", "B.1"]
    assert got.text[2] == "alpha more"
    h = documents.outline(pd.DataFrame({"doc": "d", "line": range(10), "text": [f"({c}) x" for c in "abcdefghij"]}))
    assert h.label_path.tolist() == list("abcdefghij")


def test_layout_table():
    lines = ["Pollutant    Limit      Unit", "NOx          0.20       lb per", "                        million Btu", "CO           1.0        ppm"]
    assert documents.layout_table(lines) == [["Pollutant", "Limit", "Unit"], ["NOx", "0.20", "lb per million Btu"], ["CO", "1.0", "ppm"]]


def test_repeated_runs(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "b", "c", "x", "a", "b", "c", "y"])], "doc string, line long, text string")
    assert sorted(r.line for r in documents.repeated_runs(lines).collect()) == [4, 5, 6]


def test_deepest_target(spark):
    refs = spark.createDataFrame([("n", 0, "II.B.9", "a"), ("n", 1, "V", "a")], "id string, n int, label string, reg_key string")
    ids = spark.createDataFrame([("a", "II", "s-II"), ("a", "II.B", "s-II-B")], "reg_key string, label string, id string")
    assert {r.label: r.target for r in links.deepest_target(refs, ids).collect()} == {"II.B.9": "s-II-B", "V": None}


def test_quality_finds_planted_faults(spark):
    rows = [("sec-a-1", None, "A.1", "", "x" * 5), ("sec-a-2", "sec-gone", "A.1", "no stop", '<a href="#sec-nowhere">y</a>')]
    tab = spark.createDataFrame([(i, p, c, s, t, "a", "pending", False) for i, p, c, s, t in rows], "id string, parent_id string, citation string, ai_summary string, full_text string, reg_key string, summary_status string, is_public boolean")
    got = {r.name: r.n for r in quality.suite(tab).collect()}
    assert (got["orphan_parent"], got["missing_link_target"], got["duplicate_citation"], got["empty_text"], got["pending"]) == (1, 1, 1, 0, 2)


def test_verdict_contract(spark):
    raw = [("1", '{"verdict":"approve"}'), ("2", '{"verdict":"correct","corrected_summary":""}'), ("3", "nothing"), ("4", '```json\n{"verdict":"correct","corrected_summary":"Fine now."}\n```')]
    df = spark.createDataFrame([(a, b, "before") for a, b in raw], "id string, raw string, before string")
    assert {r.id: r.problem for r in quality.verdicts(df).collect()} == {"1": None, "2": "no correction", "3": "no verdict", "4": None}


def test_sample_is_reproducible_and_allocated(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("g"))
    a, b = (sorted(r.id for r in sampling.stratified(rows, "g", 10, 1).collect()) for _ in range(2))
    assert a == b and len(a) == 10
    assert sampling.by_ids(rows, []).count() == 0


def test_margin():
    rows = [("a-1", 0.9), ("b-1", 0.8), ("c-1", 0.5)]
    assert abs(sampling.margin(rows, ["b"], 2) - 0.3) < 1e-6
    assert sampling.margin(rows, ["c"], 2) < 0
    assert sampling.margin(rows, ["q"], 2) == float("-inf")


def test_evaluation(spark):
    res = spark.createDataFrame([("q", 1, "x-1"), ("q", 2, "y-1")], "q string, position int, id string")
    ask = spark.createDataFrame([("q", ["y"], ["z"], 2), ("p", ["y"], [], 2)], "q string, expect array<string>, forbid array<string>, top_n int")
    assert {r.q: (r.expected_at, r.passed) for r in sampling.evaluation(res, ask).collect()} == {"q": (2, True), "p": (None, False)}


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("CODE OF COUNTY REGULATIONS\nReg 7\n\nPART A\nbody one\n1\fCODE OF COUNTY REGULATIONS\nReg 7\n\nbody two\n2\n")
    kept = files.without_furniture(files.layout_lines(spark, str(tmp_path / "a.txt"))).orderBy("page", "line").collect()
    assert [r.text for r in kept if r.text] == ["PART A", "body one", "body two"]
    (tmp_path / "ids").write_text("b # x\n\na\nb\n")
    assert [(r.pos, r.id) for r in files.id_list(spark, str(tmp_path / "ids")).orderBy("pos").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "m.json").write_text('{"sources": {"k": {"kind": "rule", "ruleVersionId": "12", "permits": {"GP03": {"docid": "9"}}}}}')
    m = files.manifest(spark, str(tmp_path / "m.json")).first()
    assert (m.key, m.version_id, m.permits["GP03"].docid) == ("k", "12", "9")
    (tmp_path / "p.xml").write_text('<R><DIV8 N="1.1"><HEAD>H</HEAD><P>x</P><P>y</P></DIV8></R>')
    r = files.xml_rows(spark, str(tmp_path / "p.xml"), "DIV8", "_N string, HEAD string, P array<string>").first()
    assert (r._N, r.HEAD, r.P) == ("1.1", "H", ["x", "y"])


def test_neighbours_of_exact_copies_are_the_smallest_ids(spark):
    from weftline.operators import vector

    rows = [(f"v{i:02d}", [1.0, 2.0, 3.0]) for i in range(29, -1, -1)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").coalesce(1)
    for blocks in (None, 1, 3):
        got: dict = {}
        for r in vector.neighbours(df, k=3, blocks=blocks).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.neighbor_id)
        assert got == {i: [f"v{j:02d}" for j in range(4) if f"v{j:02d}" != i][:3] for i, _ in rows}


def test_anchored_table_with_wrapped_and_reprinted_lines():
    head = ["For each               You must              By", "unit                   meet                  (date)"]
    foot = ["Note: limits are", "   for new units", "   only as listed"]
    body = [
        "1. Boiler of more      a limit of            May 3", "than 10 MMBtu/hr       5 ppm and             2024", "                       no smoke",
        *foot, *head, "2. Turbine             keep records;         June 1", "                       report", *foot, "§ 60.5 Tank            a cover               now",
    ]
    got = documents.anchored_table([*head, *body])
    assert got[0] == ["For each unit", "You must meet", "By (date)"]
    assert got[1][:1] == ["1. Boiler of more than 10 MMBtu/hr Note: limits are for new units only as listed"] and got[1][1:] == ["a limit of 5 ppm and no smoke", "May 3 2024"]
    assert got[2:] == [["2. Turbine", "keep records; report", "June 1"], ["§ 60.5 Tank", "a cover", "now"]]
    plain = ["Pollutant    Limit", "NOx          5", "CO           7"]
    assert documents.anchored_table(plain) == documents.layout_table(plain) and documents.anchored_table([]) == [] == documents.anchored_table([" "])


def test_joined_rows():
    rows = [["Unit", "Limit"], ["Boiler of", "5 ppm"], ["more than 10", ""], ["", ""], ["Tank", "a cover,"], ["", "Sealed"], ["(a) first", ""], ["Dash-", "x"], ["ed", ""], ["New", ""]]
    assert documents.joined_rows(rows) == [["Unit", "Limit"], ["Boiler of more than 10", "5 ppm"], ["Tank", "a cover, Sealed"], ["(a) first", ""], ["Dash- ed", "x"], ["New", ""]]
    assert documents.joined_rows([["Head of", "x"], ["a", ""], ["b", "c"]]) == [["Head of", "x"], ["a", ""], ["b", "c"]]
