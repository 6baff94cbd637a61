import datetime as dt
import re

import pytest

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import links


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_strip(spark):
    assert one(spark, '(<a href="#x">Subpart Z</a>)<td>b</td>&nbsp;c', T.strip_html) == "(Subpart Z) b c"
    assert one(spark, '(<a href="#x">Subpart Z</a>)', T.strip_html_plain) == "( Subpart Z )"
    assert one(spark, None, T.strip_html) == ""
    assert one(spark, "10<sup>3</sup>", T.strip_for_prompt) == "10^(3)"


def test_letters_ignore_markup(spark):
    assert one(spark, "A <b>1</b>-b", T.letters_digits) == one(spark, "a1 B", T.letters_digits) == "a1b"


def test_without_citation(spark):
    f = lambda c: T.without_citation(c, F.lit("II.B.2"))
    assert one(spark, "II.B.2. Tanks", f) == "Tanks"
    assert one(spark, "II.B.21 Tanks", f) == "II.B.21 Tanks"


def test_sentences_and_cuts(spark):
    assert one(spark, "See e.g. Part A. Then stop. Now", T.sentences) == ["See e.g. Part A.", "Then stop.", "Now"]
    assert one(spark, "One two. Three four five", lambda c: T.cap_at_sentence(c, 12)) == "One two."
    assert one(spark, "aaa bbb ccc", lambda c: T.cap_at_sentence(c, 8)) == "aaa bbb"
    assert one(spark, "", T.word_count) == 0
    assert one(spark, "a, b c d e", lambda c: T.cut_words(c, 3)) == "a…"


def test_labels(spark):
    assert one(spark, 1994, T.roman, "int") == "MCMXCIV"
    assert one(spark, 4000, T.roman, "int") is None
    assert one(spark, "xiv", T.from_roman) == 14
    assert one(spark, "iiii", T.from_roman) is None
    assert [one(spark, x, T.base26_next) for x in ("a", "z", "az", "zz", "A")] == ["b", "aa", "ba", None, None]


def test_sequences(spark):
    df = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["c", "a"], ["a", "b", "c"])], "s array<string>, l array<string>")
    assert [r.y for r in df.select(T.is_subsequence(F.col("s"), F.col("l")).alias("y")).collect()] == [True, False]
    assert one(spark, "volatile organic compound", T.initials) == "VOC"


def test_json_in(spark):
    assert one(spark, 'so: ```json\n{"a": 1}\n```', T.json_in) == '{"a": 1}'
    assert one(spark, "none", T.json_in) is None


def test_ids_and_days(spark):
    assert one(spark, "sec-reg7-II-B", V.document_key) == "reg7"
    assert one(spark, "x", V.document_key) is None
    assert one(spark, dt.datetime(2024, 7, 1, 5, 30), V.civil_day, "timestamp") == dt.date(2024, 6, 30)
    assert one(spark, dt.date(2026, 9, 5), V.ap_date, "date") == "Sept. 5, 2026"
    assert one(spark, "13/45/2020", V.us_date) is None


def test_safe_id(spark):
    assert one(spark, "abc", T.safe_id) == "abc"
    a, b = one(spark, "a b", T.safe_id), one(spark, "a.b", T.safe_id)
    assert a != b and a.startswith("a_b-")


METHODS = ["method-1", "method-2", "method-2a", "method-2d", "method-3", "method-3a", "method-3b", "method-4", "method-5", "method-9", "method-18", "method-21", "method-22", "method-25a", "ps-8"]
#: Text, its citations, and (where it differs) the printed texts of the anchors.
CITED = [
    ("Use Method 21 here.", ["21"], ["Method 21"]),
    ("per EPA Method 21 (2017) by Reference Method 9, by Test Method 5 of", ["21", "9", "5"], ["EPA Method 21", "Reference Method 9", "Test Method 5"]),
    ("Method 25A tests; Method 21A isn't one; Method 21AB neither", ["25a"], ["Method 25A"]),
    ("Methods 1, 2, 3, and 4 apply", ["1", "2", "3", "4"], ["Methods 1", "2", "3", "4"]),
    ("Method 3, 3A, or 3B of 40 CFR part 60", ["3", "3a", "3b"], ["Method 3", "3A", "3B"]),
    ("EPA Method 18, 25, or 25A", ["18", "25a"], ["EPA Method 18", "25A"]),
    ("Methods 1 through 4 and 5", ["1", "4"], ["Methods 1", "4"]),
    ("Methods 9 through 4; EPA Methods 1–4 and so on", ["9", "4", "1", "4"], ["Methods 9", "4", "EPA Methods 1", "4"]),
    ("Method 318-95 and Method 303-91", [], []),
    ("Method 22, 40 CFR part 60; Methods 2A and 2D, 40 C.F.R. 60", ["22", "2a", "2d"], ["Method 22", "Methods 2A", "2D"]),
    ('<a href="https://x">Method 21</a> and <span class="xref" data-x="y">B. Method 21</span>, Method 22', ["22"], ["Method 22"]),
    ("<table><caption>Method 21</caption><tr><td>Method 22</td></tr></table>", ["22"], ["Method 22"]),
    ('<div class="doc-table-caption">Table 2 Method 21</div>Methods 1,<b> 2</b>', ["1"], ["Methods 1"]),
    ("the method 21 approach; Methods of compliance; NIOSH Method 7400; SubMethod 21", [], []),
    ("under Performance Specification 8 or 9", ["ps-8"], ["Performance Specification 8"]),
    ("&lt;Method 21&gt; &amp; Method 22", ["21", "22"], ["Method 21", "Method 22"]),
]


@pytest.mark.parametrize(("text", "want", "printed"), CITED)
def test_methods(spark, text, want, printed):
    slugs = [w if w.startswith("ps-") else f"method-{w}" for w in want]
    assert one(spark, text, lambda c: links.methods(c, METHODS)) == slugs
    html, made = links.link_methods(text, set(METHODS))
    assert made == slugs and re.findall(r'<a class="xref-method" href="/test-methods/([^"]+)">(.*?)</a>', html) == list(zip(slugs, printed))
    assert re.sub(r'<a class="xref-method"[^>]*>(.*?)</a>', r"\1", html) == text and links.link_methods(html, set(METHODS)) == (html, [])


def test_methods_without_a_list_of_known_ones(spark):
    assert one(spark, "Methods 18A through 18C, Method 318-95, Method 7400", links.methods) == ["method-18a", "method-18c", "method-7400"]
    assert one(spark, None, links.methods) is None
    assert links.link_methods("<p>Method 21. See Method 21</p>", {"method-21"}, "Method 21.")[0] == '<p>Method 21. See <a class="xref-method" href="/test-methods/method-21">Method 21</a></p>'


@pytest.mark.parametrize(("text", "cut"), [("Whole.", False), ("Whole?*", False), ('Said "so"', False), ("(see A)", False), ("[cut]", False), ("ends in a list:", True), ("or a clause;", True), ("in the", True), ("A.**", True), ("Whole. \n", False), ("", True), (None, True)])
def test_whole_answers(spark, text, cut):
    assert one(spark, text, T.looks_cut_off) is cut


def test_wrapper_tags_and_hedging(spark):
    assert one(spark, "</ answer >A rule.< SUMMARY>\n", T.strip_wrapper) == "A rule."
    assert one(spark, "<Answer>A rule.</summary >", T.strip_wrapper) == "A rule."
    assert [one(spark, x, T.hedges) for x in ("It is Not Specified here", "It appears to apply", "no date", None)] == [True, False, True, False]


@pytest.mark.parametrize(("text", "n", "want"), [
    ("One two. Three four", 8, "One two."), ("One two. Three", 7, "One"), ('He said "no." Then', 13, 'He said "no."'), ("aaaa. bbbbbb.", 12, "aaaa."), ("One. Two three.", 14, "One."),
    ("a list; of things", 9, "a list;"), ("abcdefgh", 4, "abcd"), ("  fits  ", 4, "fits"), (None, 4, ""), ("Sec. 3.1 is here now", 9, "Sec."), ("One.\nTwo. More", 9, "One.\nTwo."),
])
def test_cap_at_sentence(spark, text, n, want):
    assert one(spark, text, lambda c: T.cap_at_sentence(c, n)) == want
