"""Stems and structured queries."""

import itertools
import random

import pytest

from weftline.functions.stems import opening, stem
from weftline.operators import lexical

#: Pairs that the algorithm's publication gives.
PAIRS = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size,
hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc, digitizer digit,
conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope,
callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good,
revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend,
adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll"""


def test_published_pairs():
    for pair in PAIRS.replace("\n", " ").split(","):
        word, want = pair.split()
        assert stem(word) == want, word


def test_words_that_stay():
    assert [stem(w) for w in ("", "a", "is", "25a", "méthodes", "by", "Rules")] == ["", "a", "is", "25a", "méthodes", "by", "Rules"]
    assert stem("rules") == stem("rule") == stem("ruling") == "rule"


def nodes(spark, texts):
    rows = [(f"n{i}", f"C.{i}", f"Title {i}", t, "k", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, citation string, title string, full_text string, reg_key string, sort_order long")


def test_search_by_stem(spark):
    df = nodes(spark, ["The rules apply to operators", "One rule for each operation", "Ruled paper", "nothing"])
    assert {r.id for r in lexical.search(df, "rule").collect()} == {"n1"}
    got = {r.id: r.headline for r in lexical.search(df, "rule operated", by_stem=True).collect()}
    assert got == {"n0": "The <mark>rules</mark> apply to <mark>operators</mark>", "n1": "One <mark>rule</mark> for each <mark>operation</mark>"}
    assert {r.id for r in lexical.search(df, "ruling -papers", by_stem=True).collect()} == {"n0", "n1"}
    held = lexical.stemmed(lexical.index(df))
    assert {r.id for r in lexical.search(df, "rules", table=held, by_stem=True).collect()} == {"n0", "n1", "n2"}


W = lambda t: lexical.Tree("word", t)
T = lambda kind, *parts, distance=1: lexical.Tree(kind, parts=parts, distance=distance)


@pytest.mark.parametrize(("text", "tree"), [
    ("a", W("a")), ("A & b | c", T("or", T("and", W("a"), W("b")), W("c"))), ("a & (b | c)", T("and", W("a"), T("or", W("b"), W("c")))), ("!a <-> b", T("near", T("not", W("a")), W("b"))),
    ("a <-> b <3> c", T("near", T("near", W("a"), W("b")), W("c"), distance=3)), ("!(a & !b)", T("not", T("and", W("a"), T("not", W("b"))))), ("'two words' & x", T("and", T("near", W("two"), W("words")), W("x"))),
    ("co-op", T("near", W("co"), W("op"))), ("a & b & c", T("and", W("a"), W("b"), W("c"))), ("a <0> b", T("near", W("a"), W("b"), distance=0)),
])
def test_trees(text, tree):
    assert lexical.parse(text) == tree


@pytest.mark.parametrize("text", ["", "a b", "a &", "& a", "(a", "a)", "a | | b", "!", "a <-> ", "a < b", "()", "---", "'open"])
def test_syntax_errors_fall_to_the_user_grammar(text):
    with pytest.raises(lexical.QuerySyntax):
        lexical.parse(text)
    assert lexical.read_query(text) == lexical.user_query(text)


def brute(tree, words):
    """Places where a part ends, by looking at every place; or whether it matches at all."""
    n = len(words)

    def at(t, p):
        if t.kind == "word":
            return 0 <= p < n and words[p] == t.text
        if t.kind == "not":
            return not at(t.parts[0], p)
        if t.kind == "near":
            return at(t.parts[0], p - t.distance) and at(t.parts[1], p)
        return (all if t.kind == "and" else any)(at(x, p) for x in t.parts)

    def holds(t):
        if t.kind in ("word", "near"):
            return any(at(t, p) for p in range(-10, n + 10))
        if t.kind == "not":
            return not holds(t.parts[0])
        return (all if t.kind == "and" else any)(holds(x) for x in t.parts)

    return holds(tree)


def test_trees_against_looking_at_every_place(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(60)]
    df = nodes(spark, texts).selectExpr("id", "'' citation", "'' title", "full_text")
    table = lexical.index(df).cache()

    def random_tree(depth):
        kind = r.choice(["word", "and", "or", "not", "near", "near"]) if depth else "word"
        if kind == "word":
            return W(r.choice("abc"))
        if kind == "not":
            return T("not", random_tree(depth - 1))
        return T(kind, random_tree(depth - 1), random_tree(depth - 1), distance=r.choice([1, 1, 2, 3]) if kind == "near" else 1)

    for tree in itertools.chain([random_tree(r.choice([1, 2, 3])) for _ in range(12)], [lexical.parse("!a <-> b"), lexical.parse("a <-> !b"), lexical.parse("(a | b) <2> (c & c)"), lexical.parse("!(a <-> b) & a")]):
        got = {x.id for x in lexical.tree_matches(table, tree).collect()}
        named = {w for w, _ in tree.words()}
        assert got == {f"n{i}" for i, t in enumerate(texts) if named & set(t.split()) and brute(tree, t.split())}, tree


def test_found_by_takes_either_grammar(spark):
    table = lexical.index(nodes(spark, ["gas tank", "gas vessel", "tank vessel"]))
    ids = lambda q: {r.id for r in lexical.found_by(table, q).collect()}
    assert ids("gas & !tank") == {"n1"} and ids("gas -tank") == {"n1"} and ids("gas tank") == {"n0"} and ids("") == set()


def test_every_word_begins_as_its_stem_says():
    rng = random.Random(1)
    ends = ["ational", "tional", "enci", "izer", "abli", "alli", "entli", "eli", "ousli", "ization", "ator", "iveness", "biliti", "icate", "ful", "ness", "ement", "ion", "ies", "sses", "ing", "ed", "eed", "y", "e", "ll", ""]
    words = ["".join(rng.choice("abeilosty") for _ in range(rng.randint(1, 5))) + rng.choice(ends) + rng.choice(ends) for _ in range(50_000)]
    assert all(w.startswith(opening(stem(w))) for w in words)


def test_search_by_stem_makes_no_rows_of_other_words(spark):
    df = nodes(spark, ["The rules apply to operators", "One rule for each operation", "Ruled paper", "nothing", "rumours open"])
    kept = lexical.kept_words(df, ["rule", "oper"], by_stem=True).collect()
    assert {r.id: sorted((x.pos, x.word) for x in r.hits) for r in kept} == {"n0": [(5, "rule"), (8, "oper")], "n1": [(5, "rule"), (8, "oper")], "n2": [(4, "rule")]}
