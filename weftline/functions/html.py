"""HTML that needs a parser: allow-lists of tags, and letters with their places. Small functions over Arrow batches."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags and attributes that stored text may have.
ALLOWED = {
    "a": ["href", "class"], "b": [], "br": [], "caption": [], "div": ["class"], "em": [], "i": [], "li": [], "mark": [], "ol": [], "p": ["class"], "span": ["class"], "strong": [], "sub": [], "sup": [],
    "table": ["class"], "tbody": [], "td": ["colspan", "rowspan"], "th": ["colspan", "rowspan"], "thead": [], "tr": [], "u": [], "ul": [],
}
DROPPED = {"script", "style", "iframe", "object"}


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.inside += 1
        elif not self.inside and tag in ALLOWED:
            kept = [(k, v or "") for k, v in attrs if k in ALLOWED[tag] and not (k == "href" and not (v or "").startswith(("#", "/", "http://", "https://")))]
            self.out.append(f"<{tag}" + "".join(f' {k}="{escape(v)}"' for k, v in kept) + ">")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.inside = max(0, self.inside - 1)
        elif not self.inside and tag in ALLOWED and tag != "br":
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(escape(data, quote=False))


def clean(html: str) -> str:
    parser = _Cleaner()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


def sanitized(c: Column) -> Column:
    """HTML with the allowed tags and attributes only; scripts and styles go with their content."""
    return F.arrow_udf(lambda xs: pa.array([None if x is None else clean(x) for x in xs.to_pylist()], pa.string()), "string")(c)


def letters(html: str) -> tuple[str, list[int]]:
    """Lower-case letters and digits outside of tags, and the place of each in the HTML."""
    out, places, inside = [], [], False
    for i, ch in enumerate(html):
        if ch in "<>":
            inside = ch == "<"
        elif not inside and ch.isalnum():
            out.append(ch.lower()[0])
            places.append(i)
    return "".join(out), places


def place_of(html: str, words: str) -> int:
    """Where a run of words begins in HTML, whatever tags and spaces are between its letters; -1 if it doesn't."""
    text, places = letters(html)
    at = text.find("".join(ch.lower()[0] for ch in words if ch.isalnum()))
    return places[at] if at >= 0 else -1


def inserted(html: Column, after: Column, note: Column) -> Column:
    """A note put before the place where some words begin; the HTML itself if they don't occur."""

    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        out = []
        for h, w, n in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True):
            at = place_of(h, w) if h and w else -1
            out.append(h if at < 0 else h[:at] + (n or "") + h[at:])
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(html, after, note)


def first_difference(old: Column, new: Column, context: int = 40) -> Column:
    """struct<was, now> around the first place where two texts differ; null if they don't."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if x == y or x is None or y is None:
                out.append(None)
                continue
            k = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            lo = max(0, k - context)
            out.append({"was": x[lo : k + context], "now": y[lo : k + context]})
        return pa.array(out, pa.struct([("was", pa.string()), ("now", pa.string())]))

    return F.arrow_udf(run, "struct<was:string,now:string>")(old, new)
