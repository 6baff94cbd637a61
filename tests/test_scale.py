"""Trees, levels and intervals: against brute force, on long chains, cycles, nulls and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import changes, tree

NODE = "id string, parent_id string, title string, citation string, sort_order long"


def random_forest(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if i < 3 else f"n{r.randrange(i)}" if r.random() < 0.9 else f"gone{i}"
        title = r.choice([f"T{i}", f"T{i}", f"c{i}", "", None])
        rows.append((f"n{i}", parent, title, f"c{i}", r.randrange(5)))
    return rows


def chain_up(rows, i):
    by = {r[0]: r for r in rows}
    out, at = [], by[i][1]
    while at in by:
        out.append(at)
        at = by[at][1]
    return out, by, at


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_against_brute_force(spark, seed):
    rows = random_forest(150, seed)
    nodes = spark.createDataFrame(rows, NODE)
    paths, groups, depths = ({r[0]: r[1] for r in df.collect()} for df in (tree.breadcrumbs(nodes), tree.top_groups(nodes), tree.depths(nodes)))
    for row in rows:
        up, by, end = chain_up(rows, row[0])
        name = lambda x: (x[2] or "").strip() or x[3]
        shown = [name(by[x]) for x in reversed(up) if by[x][1] is not None and (by[x][2] or "\0").strip() != by[x][3]]
        assert paths[row[0]] == (" › ".join(shown) or None)
        line = [row[0], *up]
        assert groups[row[0]] == (line[-2] if end is None and len(line) > 1 else None)
        assert depths[row[0]] == (len(up) if end is None else len(up) + 1)
    focus = ["n0", "n5", "n20"]
    got = {(r.focus_id, r.id): (r.depth, r.position) for r in tree.descendants(nodes, nodes.filter(F.col("id").isin(focus))).collect()}
    want = {}
    for f in focus:
        below = []
        for row in rows:
            up, by, _ = chain_up(rows, row[0])
            if f in up:
                way = [(by[x][4], x) for x in reversed([row[0], *up[: up.index(f)]])]
                below.append((way, row[0], up.index(f) + 1))
        want |= {(f, i): (d, k + 1) for k, (_, i, d) in enumerate(sorted(below))}
    assert got == want
    some = {(r.focus_id, r.id): r.depth for r in tree.descendants(nodes, nodes.filter("id = 'n0'"), 3).collect()}
    assert some == {k: v[0] for k, v in want.items() if k[0] == "n0" and v[0] <= 3}


def test_depth_starts_again_below_parts_and_appendices(spark):
    rows = [("sec-a-top-REG-a", None), ("sec-a-PART-B", "sec-a-top-REG-a"), ("x", "sec-a-PART-B"), ("y", "x"), ("sec-a-APPENDIX-C", "y"), ("z", "sec-a-APPENDIX-C"), ("w", "z"), ("o", "gone"), ("p", "o"), ("q", "sec-b-ATTACHMENT-1")]
    df = spark.createDataFrame(rows, "id string, parent_id string")
    want = {"sec-a-top-REG-a": 0, "sec-a-PART-B": 1, "x": 1, "y": 2, "sec-a-APPENDIX-C": 3, "z": 1, "w": 2, "o": 1, "p": 2, "q": 1}
    assert dict(tree.depths(df).collect()) == want
    assert dict(tree.depths(df, None).collect())["w"] == 6


def test_cycles_have_no_top(spark):
    rows = [("a", "b", "A", "1", 1), ("b", "c", "B", "2", 1), ("c", "a", "C", "3", 1), ("d", "a", "D", "4", 1), ("r", None, "R", "5", 1), ("s", "r", "S", "6", 1), ("t", "s", "T", "7", 1)]
    df = spark.createDataFrame(rows, NODE)
    assert dict(tree.depths(df).collect()) == {"a": None, "b": None, "c": None, "d": None, "r": 0, "s": 1, "t": 2}
    assert dict(tree.top_groups(df).collect()) == {"a": None, "b": None, "c": None, "d": None, "r": None, "s": "s", "t": "s"}
    assert dict(tree.breadcrumbs(df).collect())["t"] == "S"
    assert {(r.focus_id, r.id) for r in tree.descendants(df, df.filter("id in ('a', 'r')")).collect()} == {("r", "s"), ("r", "t")}


def test_a_chain_of_100_000_nodes(spark):
    chain = spark.range(100_000).selectExpr("concat('n', id) id", "if(id > 0, concat('n', id - 1), null) parent_id")
    assert tree.depths(chain).agg(F.max("depth"), F.count_distinct("depth")).first()[:] == (99_999, 100_000)


def test_walks_of_empty_tables(spark):
    none = spark.createDataFrame([], NODE)
    for run in (tree.breadcrumbs, tree.depths, tree.top_groups, lambda x: tree.descendants(x, x)):
        assert run(none).collect() == []


def brute_parents(rows):
    out = {}
    for g in {r[0] for r in rows}:
        seen = []
        for _, pos, level, key in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            out[key] = next((p for p, x in reversed(seen) if level is not None and x < level), None)
            if level is not None:
                seen.append((pos, level))
    return out


@pytest.mark.parametrize("top", [3, 1000])
def test_nearest_lower_of_any_level(spark, top):
    r = random.Random(top)
    groups = ["hot"] * 6 + ["a", "b", None]
    rows = [(r.choice(groups), i, r.choice([None, *range(top)]) if r.random() < 0.1 else r.randrange(top), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc string, pos long, level int, key long").repartition(7)
    assert {x.key: x.parent_pos for x in tree.nearest_lower(df).collect()} == brute_parents(rows)
    rising = [("d", i, (0, 10, 11, 12)[i], i) for i in range(4)]
    assert {x.key: x.parent_pos for x in tree.nearest_lower(spark.createDataFrame(rising, df.schema)).collect()} == {0: None, 1: 0, 2: 1, 3: 2}
    assert tree.nearest_lower(df.limit(0)).collect() == []


def test_numbered_keeps_rows_of_no_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5), ("a", 4)], "g string, x int")
    assert sorted(map(tuple, tree.numbered(df, "g", ["x"]).collect()), key=str) == sorted([(None, 1, 1), (None, 2, 2), ("a", 4, 1), ("a", 5, 2)], key=str)


def brute_after(left, right, hours):
    out = []
    for i, k, t in left:
        times = [s for key, s in right if key is not None and key == k and t is not None and s is not None and t <= s < t + hours * 3600]
        out.append((i, min(times) if times else None))
    return sorted(out)


@pytest.mark.parametrize("hours", [1, 24])
def test_first_after_against_brute_force(spark, hours):
    r = random.Random(hours)
    at = lambda: r.choice([None, r.randrange(0, 5 * 86400), r.randrange(0, 80) * 3600])
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    left, right = [(i, key(), at()) for i in range(600)], [(key(), at()) for _ in range(150)]
    left += [(1000, "x", 0), (1000, "x", 0), (1001, "edge", 0), (1002, "edge", 1)]
    right += [("x", 5), ("edge", hours * 3600)]
    a = spark.createDataFrame(left, "i int, k string, s long").selectExpr("i", "k", "timestamp_seconds(s) t")
    b = spark.createDataFrame(right, "k string, s long").selectExpr("k", "timestamp_seconds(s) u", "1 t")
    got = changes.first_after(a, b, "k", "t", "u", hours, "next").selectExpr("i", "unix_seconds(next)").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_after(left, right, hours), key=str)
    assert changes.first_after(a.limit(0), b, "k", "t", "u", hours, "next").collect() == []


def test_first_after_makes_no_pairs_of_a_hot_key(spark):
    rows = spark.range(200_000).selectExpr("id i", "'hot' k", "timestamp_seconds(id div 4) t")
    got = changes.first_after(rows, rows.filter("i % 2 = 0").select("k", "t"), "k", "t", "t", 24, "next")
    assert got.filter("next >= t").count() == 200_000
