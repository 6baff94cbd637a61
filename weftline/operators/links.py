"""References in text: extraction, linking against the ids that exist, and buckets of what doesn't resolve."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V

#: The link syntaxes of stored HTML: attribute patterns with the target in group 1.
SYNTAXES = {
    "xref": r"data-xref=\"([^\"]+)\"",
    "anchor": r"href=\"#([^\"]+)\"",
    "page": r"href=\"/regulation/[^\"#]*#([^\"]+)\"",
    "preview": r"href=\"/provision/([^\"?#]+)\"",
}


def link_targets(nodes: DataFrame) -> DataFrame:
    """(id, kind, target): every link of every node."""
    out = None
    for kind, pattern in SYNTAXES.items():
        rows = nodes.select("id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.col("full_text"), F.lit(pattern), F.lit(1))).alias("target"))
        out = rows if out is None else out.unionByName(rows)
    return out


def references(nodes: DataFrame, pattern: str = r"(?:\b(?i:section|part)\s+|§\s*)([0-9A-Z]+(?:\.[0-9A-Za-z]+)*)(?![A-Za-z0-9])") -> DataFrame:
    """(id, n, label): references in the visible text in their order. A label is digits and capitals, with parts after points; "part of" has none."""
    found = F.regexp_extract_all(T.strip_html_plain(F.col("full_text")), F.lit(pattern), F.lit(1))
    return nodes.select("id", F.posexplode(found).alias("n", "label"))


def deepest_target(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, label, target): the longest prefix of a dotted label that is an id's label; null if none (ids: reg_key, label, id).

    Prefixes are joined to the ids; no pair of references and ids is compared."""
    parts = F.split("label", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    cut = refs.withColumn("prefix", F.explode(prefixes))
    hit = cut.join(ids.select("reg_key", F.col("label").alias("prefix"), F.col("id").alias("target")), ["reg_key", "prefix"])
    best = hit.groupBy("id", "n", "label").agg(F.max_by("target", F.struct(F.length("prefix"), "target")).alias("target"))
    return refs.select("id", "n", "label").join(best, ["id", "n", "label"], "left")


def numbering(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds key: the numbering range (low, high, key) that a number falls into. Ranges are a table of the corpus' layout, a few
    hundred rows, so they are joined by the hundreds that they cover, not by comparing all pairs."""
    step = 100
    cover = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor(F.col("high") / step))))
    rows = refs.withColumn("bin", F.floor(F.col("number") / step))
    return rows.join(cover, (rows["bin"] == cover["bin"]) & F.col("number").between(F.col("low"), F.col("high")), "left").drop("bin", "low", "high")


def unresolved(linked: DataFrame) -> DataFrame:
    """(label, n): references without a target, most frequent first."""
    return linked.filter("target is null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


#: How test methods and performance specifications are cited. A number is digits with at most one capital letter.
NUMBER = r"\d+[A-Z]?(?![A-Za-z0-9])"
_LIST = rf"(?:(?:\s*,\s*(?:(?:and|or)\s+)?|\s+(?:and|or)\s+){NUMBER}(?!\s*C\.?\s*F\.?\s*R))*"
_THROUGH, _DASH = rf"\s+through\s+{NUMBER}(?!\s*C\.?\s*F\.?\s*R)", rf"\s*[–—-]\s*{NUMBER}(?!\s*C\.?\s*F\.?\s*R)"
#: A citation as printed: singular or plural lead-in, list, at most one range at its end; a dash makes a range after the plural only.
CITATION = rf"(?<![A-Za-z])(?:(?:EPA |Reference |Test )?(?:Methods\s+{NUMBER}{_LIST}(?:{_THROUGH}|{_DASH})?|Method\s+{NUMBER}{_LIST}(?:{_THROUGH})?)|Performance Specification\s+{NUMBER})"
#: Text that is never linked: anchors, resolved references, table captions.
BLOCKED = r"(?is)<a(?:\s[^>]*)?>.*?</a\s*>|<span\b[^>]*class=\"xref\"[^>]*>.*?</span\s*>|<div\b[^>]*class=\"doc-table-caption\"[^>]*>.*?</div\s*>|<caption\b[^>]*>.*?</caption\s*>"
DATED = r"^(?:EPA |Reference |Test )?Method\s+\d+[A-Z]?$"


def methods(html: Column, known: list[str] | None = None) -> Column:
    """array<string>: slugs (method-25a, ps-8) that a text cites, in order, each time anew. Of a range the first and the last number are
    cited, what lies between isn't. ``known``: the slugs that there are; others are left out. Without it every number counts but that of a
    dated designation (Method 318-95). Tags end a list; a null text has none."""
    text = F.regexp_replace(F.regexp_replace(html, BLOCKED, "\u0001"), r"<[^>]+>", "\u0001")
    marked = F.regexp_replace(text, rf"((?<![A-Za-z])Method\s+\d+[A-Z]?)(?=\s*[–—-]\s*\d)", "$1\u0002") if known is None else text
    found = F.regexp_extract_all(marked, F.lit(CITATION + "\u0002?"), F.lit(0))
    dated = lambda x: F.when(x.endswith("\u0002"), F.array().cast("array<string>"))
    kind = lambda x: F.when(x.startswith("Performance"), "ps-").otherwise("method-")
    slugs = F.flatten(F.transform(found, lambda x: dated(x).otherwise(F.transform(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)), lambda n: F.concat(kind(x), F.lower(n))))))
    return slugs if known is None else F.filter(slugs, lambda x: x.isin(known))


_NUMBER, _PARTS = re.compile(NUMBER), re.compile(rf"(?P<blocked>{BLOCKED[5:]})|(?P<tag><[^>]+>)|(?P<cited>(?-i:{CITATION}))", re.I | re.S)


def link_methods(html: str, known: set[str], label: str | None = None) -> tuple[str, list[str]]:
    """HTML with its citations of known methods as anchors, and their slugs. The lead-in is part of the first anchor; nothing inside the row's
    own ``label`` at the start is linked. Text that is linked already comes back as it is."""
    made: list[str] = []
    plain = re.sub(r"<[^>]+>", "", html)
    start = len(plain) - len(plain.lstrip())
    bound, seen, at = (start + len(label) if label and plain[start:].startswith(label) else 0), 0, 0
    out: list[str] = []

    def anchor(slug: str, text: str) -> str:
        if slug not in known:
            return text
        made.append(slug)
        return f'<a class="xref-method" href="/test-methods/{slug}">{text}</a>'

    for m in _PARTS.finditer(html):
        out.append(html[at : m.start()])
        seen += m.start() - at
        at, whole = m.end(), m[0]
        if m["cited"] and seen >= bound:
            kind, put = "ps" if whole.startswith("Performance") else "method", 0
            for i, n in enumerate(_NUMBER.finditer(whole)):
                lead = 0 if i == 0 else n.start()
                out.append(whole[put:lead] + anchor(f"{kind}-{n[0].lower()}", whole[lead : n.end()]))
                put = n.end()
            out.append(whole[put:])
        else:
            out.append(whole)
        seen += len(whole) if m["cited"] else len(re.sub(r"<[^>]+>", "", whole))
    return "".join([*out, html[at:]]), made


def methods_linked(rows: DataFrame, known: list[str]) -> DataFrame:
    """Adds linked (the HTML of full_text with citations as anchors) and slugs, for rows (id, full_text[, citation])."""
    held = set(known)

    def run(texts: pa.Array, labels: pa.Array) -> pa.Array:
        found = [link_methods(t or "", held, x) for t, x in zip(texts.to_pylist(), labels.to_pylist(), strict=True)]
        return pa.array([{"linked": h, "slugs": m} for h, m in found], pa.struct([("linked", pa.string()), ("slugs", pa.list_(pa.string()))]))

    made = F.arrow_udf(run, "struct<linked:string,slugs:array<string>>")
    label = F.col("citation") if "citation" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("__x", made(F.col("full_text"), label)).select(*rows.columns, "__x.linked", "__x.slugs")


def method_summary(citations: DataFrame) -> DataFrame:
    """(method, n_rows) over (id, method), most cited first."""
    return citations.groupBy("method").agg(F.countDistinct("id").alias("n_rows")).orderBy(F.desc("n_rows"), "method")


def linked_html(html: Column, label: str, target: str) -> Column:
    """The first mention of a label outside of links, as a link."""
    return F.regexp_replace(html, rf"(?<![\w\">])(?<!href=){label}(?![\w<])", f'<a href="#{target}">{label}</a>')


def visitor_links(html: Column) -> Column:
    """In-document anchors to rows that a visitor can't open become previews."""
    return F.regexp_replace(html, r"href=\"#(sec-[^\"]+)\"", "href=\"/provision/$1\"")


def known_fixes(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """Literal replacements (id, wrong, right) of a text; one that would change a letter or digit isn't made."""
    joined = rows.join(fixes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("wrong", "right"))).alias("fixes")), "id", "left")
    text = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<wrong:string,right:string>>")), F.col("full_text"), lambda t, f: F.when(T.letters_digits(f["wrong"]) == T.letters_digits(f["right"]), F.replace(t, f["wrong"], f["right"])).otherwise(t))
    return joined.withColumn("full_text", text).drop("fixes")


def link_all(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, full_text, n_links): texts with every resolved reference (id, label, target) as a link, longest labels first; text
    inside of tags and links that are there already stays. A target in another document (by its id) is linked on that document's page."""
    here, there = V.document_key(F.col("id")), V.document_key(F.col("target"))
    href = F.when(here.isNull() | there.isNull() | (here == there), F.col("target")).otherwise(F.concat(F.lit("/regulation/"), there, F.lit("#"), "target"))
    targets = linked.filter("target is not null").select("id", "label", href.alias("target")).distinct()
    per = targets.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.length("label")).alias("o"), "label", "target"))).alias("targets"))  # labels of one text

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            out.append(linked_text(text or "", {x["label"]: x["target"] for x in found or []}))
        return pa.array([{"html": h, "n": n} for h, n in out], pa.struct([("html", pa.string()), ("n", pa.int32())]))

    made = F.arrow_udf(run, "struct<html:string,n:int>")
    rows = nodes.select("id", "full_text").join(per, "id", "left").select("id", made("full_text", "targets").alias("x"))
    return rows.select("id", F.col("x.html").alias("full_text"), F.col("x.n").alias("n_links"))


def linked_text(html: str, targets: dict[str, str]) -> tuple[str, int]:
    """HTML with the labels as links, and how many were made. Targets are ids of the same page, or paths."""
    if not targets:
        return html, 0
    labels = "|".join(re.escape(x) for x in sorted(targets, key=len, reverse=True))
    pattern = re.compile(rf"(<a\b.*?</a>|<[^>]*>)|(?<![\w.])({labels})(?![\w]|\.\w)", re.S)
    made = 0

    def put(m: re.Match) -> str:
        nonlocal made
        if m[1]:
            return m[1]
        made += 1
        target = targets[m[2]]
        return f'<a href="{target if target.startswith("/") else "#" + target}">{m[2]}</a>'

    return pattern.sub(put, html), made


def stripped(html: Column) -> Column:
    """Text with anchors unwrapped."""
    return F.regexp_replace(html, r"(?is)<a\b[^>]*>(.*?)</a>", "$1")


def anchor_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<a\b"))
