"""Alignment by anchors against the plain diff, on long texts, and the kinds of differences."""

import difflib
import random
import time

import pytest

from weftline.operators import reconcile
from weftline.plans import catalog, more  # noqa: F401 - more puts its queries into the catalog's tables


def plain(a, b):
    return [(i, k, j, m) for tag, i, k, j, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]


def changed(words, r, rate):
    out = []
    for w in words:
        x = r.random()
        out += [] if x < rate / 3 else [w, f"new{r.randrange(99)}"] if x < 2 * rate / 3 else [w + "x"] if x < rate else [w]
    return out


def test_short_texts_get_the_plain_diff():
    r = random.Random(2)
    for _ in range(60):
        a = [r.choice("abcdefghij") for _ in range(r.randint(0, 60))]
        b = changed(a, r, r.choice([0, 0.1, 0.5]))
        assert reconcile.edits(a, b) == plain(a, b)


@pytest.mark.parametrize("tiny", [0, 5_000])
def test_stretches_are_those_of_the_plain_diff(monkeypatch, tiny):
    monkeypatch.setattr(reconcile, "TINY", tiny)
    r = random.Random(tiny)
    for k in range(300):
        words = [f"w{n}" for n in range(r.choice([1, 2, 3, 20, 200]))]
        a = [r.choice(words) for _ in range(r.randint(0, 120))]
        b = changed(a, r, r.choice([0.02, 0.3])) if k % 3 else [r.choice(words) for _ in range(r.randint(0, 120))]
        want = [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x[2]]
        assert reconcile.blocks(a, b) == want


def test_texts_of_500_words_cost_little():
    r = random.Random(3)
    common = [f"w{n}" for n in range(60)]
    pairs = [(a, changed(a, r, 0.1)) for a in ([r.choice(common) for _ in range(480)] for _ in range(40))]
    began = time.process_time()
    want = [plain(a, b) for a, b in pairs]
    middle = time.process_time()
    assert [reconcile.edits(a, b) for a, b in pairs] == want
    assert time.process_time() - middle < 0.6 * (middle - began)
    same = ["a"] * 5000
    assert reconcile.edits(same, list(same)) == []


@pytest.mark.parametrize("vocabulary", [40, 3000])
def test_long_alignments_are_right_and_nearly_as_short(monkeypatch, vocabulary):
    monkeypatch.setattr(reconcile, "PLAIN", 400)
    r = random.Random(vocabulary)
    for _ in range(8):
        a = [f"w{r.randrange(vocabulary)}" for _ in range(1500)]
        b = changed(a, r, 0.05)
        found = reconcile.blocks(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
        assert all(i + n <= k and j + n <= m for (i, j, n), (k, m, _) in zip(found, found[1:]))
        x = y = 0
        rebuilt = []
        for i, k, j, m in reconcile.edits(a, b):
            rebuilt += a[x:i] + b[j:m]
            x, y = k, m
        assert rebuilt + a[x:] == b
        size = lambda e: sum(k - i + m - j for i, k, j, m in e)
        assert size(reconcile.edits(a, b)) <= 1.3 * size(plain(a, b)) + 20


def long_pairs():
    r = random.Random(8)
    few, many = [f"w{n}" for n in range(3)], [f"w{n}" for n in range(400)]
    for words in (few, many):
        a = [r.choice(words) for _ in range(900)]
        yield from [(a, changed(a, r, 0.2)), (a, a[500:] + a[:500]), (a, [r.choice(words) for _ in range(700)])]
    again = many[:90] * 9
    yield from [(changed(again, r, 0.02), changed(again + again[:200], r, 0.02)), (changed(["a"] * 700, r, 0.05), changed(["a"] * 800, r, 0.05))]
    yield ["a", "b"] * 300, ["b", "b", "a"] * 300


def blocks_of_difflib(a, b):
    return [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x[2]]


@pytest.mark.parametrize("pairs", [0, 1, 30])
def test_long_texts_get_the_plain_diff(monkeypatch, pairs):
    monkeypatch.setattr(reconcile, "PAIRS", pairs, raising=False)
    for a, b in long_pairs():
        assert len(a) * len(b) > reconcile.PLAIN
        assert reconcile.blocks(a, b) == blocks_of_difflib(a, b)


@pytest.mark.parametrize("pairs", [0, 0.5, 1, 30])
def test_lengths_do_not_decide_the_edits(monkeypatch, pairs):
    monkeypatch.setattr(reconcile, "PAIRS", pairs, raising=False)
    r = random.Random(9)
    for k in range(400):
        words = [f"w{n}" for n in range(r.choice([1, 2, 5, 40]))]
        a = [r.choice(words) for _ in range(r.randint(0, 90))]
        b = changed(a * r.choice([1, 2]), r, r.choice([0.02, 0.3])) if k % 3 else [r.choice(words) for _ in range(r.randint(0, 90))]
        want = blocks_of_difflib(a, b)
        for plain_up_to in (0, 1_000, 10_000):
            monkeypatch.setattr(reconcile, "PLAIN", plain_up_to)
            assert reconcile.blocks(a, b) == want


def test_one_word_again_and_again_costs_little():
    r = random.Random(4)
    a = ["a"] * 20_000
    began = time.time()
    for x, y in [(changed(a, r, 0.001), changed(a, r, 0.01)), (a, a[1:] + ["b"]), (["a", "b"] * 10_000, ["b", "a", "a"] * 7_000)]:
        found = reconcile.blocks(x, y)
        assert found and all(x[i : i + n] == y[j : j + n] for i, j, n in found)
    assert time.time() - began < 60


def test_text_edits_of_long_documents(spark, tmp_path):
    r = random.Random(6)
    words = ["the", "and", "or", "of"]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (40, 600, 1500)] + ["of the rule and or " * 160 + "end", "", None, "no change"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for k, text in enumerate(texts[:4]):
        a, b = text.split(" "), text.replace(" the ", " thee ").replace(" and ", " an d ").split(" ")
        kinds = ["spacing" if "".join(a[i:j]) == "".join(b[x:y]) else "delete" if x == y else "insert" if i == j else "replace" for i, j, x, y in plain(a, b)]
        want += [(k, kind, kinds.count(kind)) for kind in set(kinds)]
    assert sorted(tuple(row) for row in catalog.QUERIES["text_edits"](spark, str(tmp_path)).collect()) == sorted(want)


def test_a_million_words():
    r = random.Random(1)
    a = [f"w{r.randrange(20_000)}" for _ in range(1_000_000)]
    b = changed(a, r, 0.001)
    began = time.time()
    found = reconcile.edits(a, b)
    assert 500 < len(found) < 3000 and time.time() - began < 120
    assert reconcile.edits(["a"] * 5000, ["b"] * 5000) == [(0, 5000, 0, 5000)]


def test_word_edits(spark):
    df = spark.createDataFrame([("The tank vents gas daily", "the tank vents no gas"), ("foot note", "footnote"), (None, "x"), ("same", "same")], "a string, b string")
    got = [[tuple(e) for e in r.e] for r in df.select(reconcile.word_edits(df.a, df.b).alias("e")).collect()]
    assert got == [[("insert", "", "no"), ("delete", "daily", "")], [("spacing", "foot note", "footnote")], [("insert", "", "x")], []]


def test_differences_with_tables(spark):
    corpus = [("d", 1, "p1", "Each owner must test the tank every year.", False), ("d", 2, "t1", "Pollutant Limit NOx 5 | CO 7", True), ("d", 3, "p2", "Where limits apply records are kept for two years.", False)]
    lines = [("d", 1, "Each owner must test the tank every"), ("d", 2, "year. Pollutant NOx CO Limit 5 7"), ("d", 3, "Where limits apply rec ords are kept for five years.")]
    kinds = "doc string, pos long, id string, text string, in_table boolean", "doc string, line long, text string"
    run = lambda a, b: [(r.doc, r.kind, r.owner, r.line, r.corpus, r.source) for r in reconcile.reconciled(spark.createDataFrame(a, kinds[0]), spark.createDataFrame(b, kinds[1])).orderBy("line", "kind").collect()]
    assert run(corpus, lines) == [
        ("d", "table_layout", "t1", 2, "Pollutant Limit NOx 5 CO 7", "Pollutant NOx CO Limit 5 7"), ("d", "extraction", "p2", 3, "two", "five"), ("d", "spacing", "p2", 3, "records", "rec ords"),
    ]
    wrong = [*lines[:1], ("d", 2, "year. Pollutant NOx CO Limit 6 7"), ("d", 3, "Where limits apply records are kept for two years.")]
    assert run(corpus, wrong) == [("d", "extraction", "t1", 2, "5", "6")]
    assert run(corpus[:1], []) == [("d", "extraction", "p1", None, corpus[0][3], "")]
    assert run([], lines[:1]) == [("d", "extraction", None, 1, "", lines[0][2])]
