"""Text functions as Column expressions. Each treats null as null unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "<[^>]+>"
LINK = r"(?is)<(a|span)\b[^>]*>(.*?)</\1>"
NBSP = " "


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def entities(c: Column) -> Column:
    """Non-breaking spaces and ampersands as plain characters."""
    return F.replace(F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit(NBSP), F.lit(" ")), F.lit("&amp;"), F.lit("&"))


def strip_html(html: Column) -> Column:
    """Text for embedding and hashing: links are unwrapped in place, any other tag is a space. Null counts as empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), LINK, "$2")
    return collapse(F.replace(F.replace(F.regexp_replace(text, TAG, " "), F.lit("&nbsp;"), F.lit(" ")), F.lit(NBSP), F.lit(" ")))


def strip_html_plain(html: Column) -> Column:
    """The older rule: every tag is a space."""
    return collapse(F.replace(F.replace(F.regexp_replace(F.coalesce(html, F.lit("")), TAG, " "), F.lit("&nbsp;"), F.lit(" ")), F.lit(NBSP), F.lit(" ")))


def strip_for_prompt(html: Column) -> Column:
    """As strip_html_plain, with superscripts as ^(...) and table cells parted by bars, rows by lines."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<sup>(.*?)</sup>", r"^\($1\)")
    text = F.regexp_replace(text, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | ")
    text = F.regexp_replace(text, r"(?i)</tr>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, TAG, " "), r"[ \t]+", " "))


def snippet(html: Column, n: int) -> Column:
    """Plain text, cut to ``n`` characters with an ellipsis."""
    text = strip_html_plain(html)
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def letters_digits(html: Column) -> Column:
    """What tells a change of text from one of markup: no tags, lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(html, TAG, "")), "[^a-z0-9]", "")


def alnum(c: Column) -> Column:
    """Lower case, letters and digits of any script."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def label(c: Column) -> Column:
    """A citation label: entities folded, spaces collapsed."""
    return collapse(entities(c))


def jump_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[§\s]", "")


def without_citation(text: Column, citation: Column) -> Column:
    """The text without the citation that it opens with, unless a digit or letter follows at once."""
    cut = F.length(citation)
    after = F.substring(text, cut + 1, F.length(text))
    opens = F.startswith(text, citation) & (citation != "") & ~F.substring(after, 1, 1).rlike(r"[0-9A-Za-z]")
    return F.when(opens, F.ltrim(F.regexp_replace(after, r"^[\s.:—-]+", ""))).otherwise(text)


def heading_only(text: Column, title: Column, citation: Column) -> Column:
    return (label(F.regexp_replace(text, TAG, "")) == label(title)) | (label(F.regexp_replace(text, TAG, "")) == label(citation))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def only_marks(html: Column) -> Column:
    """Every tag but <mark> and </mark> goes."""
    return F.regexp_replace(html, "(?i)<(?!/?mark>)[^>]*>", "")


def has_markdown(c: Column) -> Column:
    return c.rlike(r"(?m)(\*\*[^*\n]+\*\*|(?<![\w*])\*[^*\s][^*\n]*\*(?![\w*])|`[^`\n]+`|^#{1,6}\s|^\s*[-*+]\s|^\s*\d+\.\s)")


def strip_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"\*\*([^*\n]+)\*\*", "$1")
    c = F.regexp_replace(c, r"(?<![\w*])\*([^*\s][^*\n]*)\*(?![\w*])", "$1")
    c = F.regexp_replace(c, r"`([^`\n]+)`", "$1")
    return F.regexp_replace(c, r"(?m)^(#{1,6}\s+|\s*[-*+]\s+)", "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n[ \t]*\n"), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Sentences: cut after terminal punctuation before a capital, but not after the usual abbreviations."""
    guarded = F.regexp_replace(c, r"\b(e\.g|i\.e|U\.S|No|Sec|Inc|vs|Dr|Mr|Ms|St)\.", "$1\u0001")
    cut = F.split(guarded, r"(?<=[.!?])\s+(?=[\"'(]?\p{Lu})")
    return F.filter(F.transform(cut, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def first_sentence(c: Column) -> Column:
    return F.get(sentences(c), F.lit(0))


def word_count(c: Column) -> Column:
    """Words of a text; 0 for blank."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def cut_words(sentence: Column, n: int) -> Column:
    """A sentence of more than ``n`` words is cut at its last clause end within them, else at the word."""
    head = F.array_join(F.slice(F.split(sentence, " "), 1, n), " ")
    clause = F.regexp_extract(head, r"^(.*)[,;:]", 1)
    return F.when(word_count(sentence) <= n, sentence).otherwise(F.concat(F.when(clause != "", clause).otherwise(head), F.lit("…")))


def overview(summary: Column, n_sentences: int, max_words: int) -> Column:
    """struct<overview, rest, cut>: the first sentences of the first paragraph within ``max_words``, and the others."""
    parts = paragraphs(summary)
    lead = F.slice(sentences(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), 1, n_sentences)
    text = F.array_join(lead, " ")
    long = word_count(text) > max_words
    return F.struct(F.when(long, cut_words(text, max_words)).otherwise(text).alias("overview"), F.slice(parts, F.lit(2), F.size(parts)).alias("rest"), long.alias("cut"))


#: Where a sentence and a clause may end.
SENTENCE_ENDS = [r"[.!?]['\")\]]", r"[.!?]"]
CLAUSE_END = r"[;:]"


def cap_at_sentence(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut back to the last sentence end within them, else clause end, else word."""
    text = F.trim(F.coalesce(c, F.lit("")))
    window = F.substring(text, 1, n + 1)  # one character more shows whether an end is one

    def before(mark: str, size: int) -> Column:
        return F.regexp_extract(window, rf"(?s)^(.{{0,{max(0, n - size)}}}{mark})(?=\s|$)", 1)

    quoted, bare = before(SENTENCE_ENDS[0], 2), before(SENTENCE_ENDS[1], 1)
    by_sentence = F.when(F.length(quoted) > F.length(bare), quoted).otherwise(bare)
    by_clause, by_word = before(CLAUSE_END, 1), F.regexp_extract(window, r"(?s)^(.*) ", 1)
    cut = F.when(by_sentence != "", by_sentence).when(by_clause != "", by_clause).when(by_word != "", by_word).otherwise(F.substring(text, 1, n))
    return F.when(F.length(text) <= n, text).otherwise(F.trim(cut))


def honest_cut(c: Column, n: int, mark: str = " [cut]") -> Column:
    """struct<text, cut>: at most ``n`` characters, to a sentence end beyond 60 % of them, else to a word, with a mark."""
    window = F.substring(c, 1, n)
    by_sentence = F.regexp_extract(window, r"(?s)^(.*[.!?])(?=\s)", 1)
    by_word = F.regexp_extract(window, r"(?s)^(.*)\s", 1)
    cut = F.when(F.length(by_sentence) >= int(0.6 * n), by_sentence).when(by_word != "", by_word).otherwise(window)
    long = F.length(c) > n
    return F.struct(F.when(long, F.concat(F.rtrim(cut), F.lit(mark))).otherwise(c).alias("text"), long.alias("cut"))


#: Tags that answers leak, phrases that say a text is silent about something, and what a whole answer ends in.
WRAPPER = r"(?i)</?\s*(?:answer|summary)\s*>"
HEDGING = r"(?i)(the text does not|does not show|not stated|not specified|unclear|no date)"
WHOLE = r"[.!?)\"\]]\*?\z"


def strip_wrapper(c: Column) -> Column:
    """Without answer or summary tags around."""
    return F.trim(F.regexp_replace(c, WRAPPER, ""), F.lit(" \t\r\n"))


def hedges(c: Column) -> Column:
    """Says that something is absent from the text."""
    return F.coalesce(c, F.lit("")).rlike(HEDGING)


def looks_cut_off(c: Column) -> Column:
    """Doesn't end as a whole answer does: in a full stop or the like, which a footnote mark may follow. Null and blank texts are cut off."""
    return ~F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+\z", "").rlike(WHOLE)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_id(c: Column, n: int = 64) -> Column:
    """Letters, digits, _ and - only, at most ``n``; what had to be changed or cut gets a hash at its end."""
    clean = F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    same = (clean == c) & (F.length(c) <= n)
    return F.when(same, c).otherwise(F.concat(F.substring(clean, 1, n - 9), F.lit("-"), F.substring(F.sha1(c.cast("binary")), 1, 8)))


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def is_subsequence(short: Column, long: Column) -> Column:
    """True if the items of an array occur in another in their order."""
    left = F.aggregate(long, short, lambda rest, x: F.when((F.size(rest) > 0) & (F.get(rest, F.lit(0)) == x), F.slice(rest, F.lit(2), F.size(rest))).otherwise(rest))
    return F.size(left) == 0


def roman(n: Column) -> Column:
    """Roman numeral in capitals of 1 to 3999; null beyond."""
    digits = [("M", "", ""), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X")]
    out = []
    for (one, five, ten), unit in zip(digits, (1000, 100, 10, 1), strict=True):
        forms = [one * k if k < 4 else one + five if k == 4 else five + one * (k - 5) if k < 9 else one + ten for k in range(10)]
        out.append(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.floor(n / unit) % 10 + 1).cast("int")))
    return F.when((n > 0) & (n < 4000), F.concat(*out))


def from_roman(c: Column) -> Column:
    """Number of a roman numeral; null if it isn't one."""
    values = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    digits = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: values[x])
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))
    total = F.aggregate(F.reverse(digits), zero, lambda a, d: F.struct((a["sum"] + F.when(d < a["most"], -d).otherwise(d)).alias("sum"), F.greatest(a["most"], d).alias("most")), lambda a: a["sum"])
    return F.when(c.rlike("(?i)^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (c != ""), total)


def base26_next(c: Column) -> Column:
    """The label after a, b, ... z, aa, ab, ...; null if it isn't one."""
    codes = F.reverse(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x) - 96))
    n = F.aggregate(F.reverse(codes), F.lit(0).cast("long"), lambda a, d: a * 26 + d) + 1
    letter = lambda k: F.char(F.lit(97) + (k % 26))
    two = F.concat(F.when(n > 26, letter(F.floor((n - 1) / 26) - 1)).otherwise(""), letter(n - 1))
    return F.when(c.rlike("^[a-z]{1,2}$") & (n <= 702), two)


def needs_citation(c: Column) -> Column:
    """A month, a year or a number with a unit."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    return c.rlike(rf"\b({months})\b|\b(19|20)\d\d\b|\b\d[\d,.]*\s?(%|percent|tons?|tpy|ppm|days?|hours?|feet|gallons?|barrels?)(?!\w)")


def json_in(text: Column) -> Column:
    """The JSON of a fenced block, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), F.lit(""))


def lead(c: Column, most_words: int = 8) -> Column:
    """struct<lead, rest>: a short capitalised opening up to its first full stop or dash, apart from the text after it."""
    head = F.regexp_extract(c, r"^(\p{Lu}[^.—–\n]*)(?:\.|—|–)\s+\S", 1)
    good = (head != "") & (word_count(head) <= most_words)
    rest = F.ltrim(F.regexp_replace(F.substring(c, F.length(head) + 1, F.length(c)), r"^\s*[.—–]\s*", ""))
    return F.struct(F.when(good, head).alias("lead"), F.when(good, rest).otherwise(c).alias("rest"))


def markdown_only(before: Column, after: Column) -> Column:
    """Two texts differ in their markdown alone."""
    return ~before.eqNullSafe(after) & collapse(strip_markdown(before)).eqNullSafe(collapse(strip_markdown(after)))


def expansion_removed(before: Column, after: Column) -> Column:
    """The text is the same but for phrases before their own abbreviation in brackets, as in "a b c (ABC)"."""
    pairs = F.regexp_extract_all(before, F.lit(r"((?:[\p{L}-]+\s+){1,8})\((\p{Lu}{2,8})\)"), F.lit(0))
    short = lambda p: F.regexp_extract(p, r"\((.*)\)", 1)
    words = lambda p: F.split(F.trim(F.regexp_replace(p, r"\(.*$", "")), r"\s+")
    own = F.transform(pairs, lambda p: F.concat(F.array_join(F.slice(words(p), -F.least(F.length(short(p)), F.size(words(p))), F.length(short(p))), " "), F.lit(" ("), short(p), F.lit(")")))
    fitting = F.filter(own, lambda p: initials(F.regexp_replace(p, r"\(.*$", "")) == short(p))
    bare = F.aggregate(fitting, before, lambda t, p: F.replace(t, p, short(p)))
    return ~before.eqNullSafe(after) & (F.size(fitting) > 0) & collapse(bare).eqNullSafe(collapse(after))


def sql_text(c: Column) -> Column:
    """A statement without comments and with white space folded, for comparison; strings keep theirs but for runs."""
    return F.lower(collapse(F.regexp_replace(F.regexp_replace(c, r"(?m)--[^\n]*$", ""), r"(?s)/\*.*?\*/", " ")))


def count_phrase(n: Column, one: str, many: str) -> Column:
    """0 is "no ...", 1 "1 ...", more with thousands parted."""
    return F.when(n == 0, f"no {many}").when(n == 1, f"1 {one}").otherwise(F.concat(F.format_number(n, 0), F.lit(f" {many}")))


def transcript_line(counts: dict[str, Column]) -> Column:
    """What happened on a day in words: the parts with a count, reviewed ones without those corrected."""
    parts = [
        ("text_updated", "text updated", "texts updated"), ("added", "row added", "rows added"), ("removed", "row removed", "rows removed"), ("links_updated", "link updated", "links updated"),
        ("checked", "summary checked", "summaries checked"), ("corrected", "summary corrected", "summaries corrected"),
    ]
    own = counts | ({"checked": counts["reviewed"] - counts["corrected"]} if {"reviewed", "corrected"} <= counts.keys() else {})
    return F.array_join(F.array_compact(F.array(*[F.when(own[k] > 0, count_phrase(own[k], a, b)) for k, a, b in parts if k in own])), ", ")
