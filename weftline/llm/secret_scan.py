"""Secret scans: base patterns and a randomness test battery with false-discovery control.

Base kinds are found by patterns. A pattern's places come from the text split at its matches: the lengths of the pieces
and of the matches between them add up to the starts. They are added up in two levels, within chunks and over chunks, so that
a text with very many matches doesn't copy its array again for each of them.

The battery looks at every run of 20 or more characters of [A-Za-z0-9+/=_-]. Its encoding is inferred (digits, hex, base32,
letters-and-digits, base64), then
- chi-squared: evenness of its characters over the encoding's alphabet, against the expectation for even use and for
  the uneven use of ordinary identifiers and prose (a noncentral mean that grows with the length);
- runs: the number of runs of character classes, against both expectations;
- serial correlation of neighbouring character codes.
A token must pass as random in all three at the 0.1 % level, and gets a p-value for looking so random if it were ordinary
text: the normal tail of the combined first two. Tokens are tested together by the Benjamini-Hochberg rule at
``FDR``, within strata of token length, from a histogram of p-values over all documents. A discovered token is a span
of kind ``random`` unless it overlaps a base span.

Only DataFrame functions are used. Texts are scanned once: base spans and tokens with their tests are written to the shared
folder, the thresholds (one number for each power of two of a length) and all else come from there.
Edge cases: null and blank texts have no spans; repeated rows are scanned alike and count each time; ties of start sort
by kind as listed; very long texts and tokens work in arrays of their own matches; other columns are kept or ignored as
the function says; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged, text_of

#: The base patterns, their groups that count for length, and the least lengths.
KINDS = ["assign", "access", "hex", "random"]
BASE = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
TOKEN = "[A-Za-z0-9+/=_-]{20,}"
FDR = 0.001
#: Matches whose places are added up together.
CHUNK = 256
#: Bins of a tenth of a power of ten each.
BINS = 400


def matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, size, match>>: places of the leftmost non-overlapping matches, the length of a group of each, and its text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(whole, F.length)
    groups = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else sizes
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), groups.alias("part"), whole.alias("match")), lambda r: r["size"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,size:int,match:string>>")
    return F.when(text.rlike(pattern), let(rows, _places)).otherwise(none)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def running(rows: Column, first: int, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind>: for each of ``rows`` the second of ``step(at, row)``, whose first is the next row's ``at``. In two levels, chunks and
    rows of a chunk, since an array that grows by one is copied."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int"))), lambda i: F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)))

    def one(a: Column, row: Column) -> Column:
        at, out = step(a["at"], row)
        return F.struct(at.alias("at"), F.array_append(a["found"], out).alias("found"))

    def chunk(a: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(a["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("found")), one)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(a["found"], d["found"]).alias("found")))

    zero = F.struct(F.lit(first).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("found"))
    return F.flatten(F.aggregate(chunks, zero, chunk, lambda a: a["found"]))


def _places(rows: Column) -> Column:
    """Starts and ends of matches from (gap before, size, part, match) of each."""

    def step(at: Column, r: Column) -> tuple[Column, Column]:
        start = at + r["gap"]
        end = start + r["size"]
        return end, F.struct(start.alias("start"), end.alias("end"), r["part"].alias("size"), r["match"].alias("match"))

    return running(rows, 0, step, "struct<start:int,end:int,size:int,match:string>")


def _kept(found: Column, kind: int, least: int) -> Column:
    good = F.filter(found, lambda m: m["size"] >= least)
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>>, kind a number; sorted by start, then kind."""
    return F.array_sort(F.concat(*[_kept(matches(text, pattern, group), i, least) for i, (pattern, group, least) in enumerate(BASE.values())]))


#: Chance that neighbours are of different classes where an encoding's alphabet is used evenly. A capital before small letters is of their
#: class, as in words.
CHANGE = {"digits": 0.0, "letters": 0.0, "hex": 0.469, "base32": 0.305, "alnum": 0.401, "base64": 0.547}
SIZES = {"digits": 10.0, "letters": 26.0, "hex": 16.0, "base32": 32.0, "alnum": 36.0, "base64": 64.0}
#: The same chance in ordinary text: words of both cases and marks change more often than words of one case with numbers.
ORDINARY_CHANGE = {"digits": 0.08, "letters": 0.08, "hex": 0.08, "base32": 0.08, "alnum": 0.08, "base64": 0.2}
#: The sum of squared character shares of ordinary text.
ORDINARY_SQUARES = 0.065
#: Two-sided 0.1 % of the normal distribution.
LIMIT = 3.29


#: A Chebyshev fit of ln(erfc(x)) + x * x for x >= 0 in t = 2 / (2 + x); its relative error is below 1.2e-7 for every x.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _lower_tail(z: Column) -> Column:
    """The normal distribution function, to seven digits of its own size also where it is tiny, since that is where it is compared."""

    def half(x: Column) -> Column:  # erfc(x) / 2 for x >= 0
        t = 2 / (2 + x)
        series = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            series = series * t + c
        return t * F.exp(series - x * x) / 2

    x = F.abs(z) / F.sqrt(F.lit(2.0))
    return F.when(z <= 0, half(x)).otherwise(1 - half(x))


def _encoding(t: Column) -> Column:
    kind = F.when(t.rlike("^[0-9]+$"), "digits").when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^[A-Z2-7=]+$"), "base32")
    return kind.when(t.rlike("^([a-z]+|[A-Z]+)$"), "letters").when(t.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "alnum").otherwise("base64")


def _by(encoding: Column, values: dict[str, float]) -> Column:
    out = F.lit(values["base64"])
    for name, v in values.items():
        out = F.when(encoding == name, F.lit(v)).otherwise(out)
    return out


def battery(tokens: Column) -> Column:
    """array<struct<token, even, p>> of an array of tokens: even if no test rejects randomness, p the chance of looking
    so random for ordinary text of that length. Each transform adds what the next one uses."""
    more = lambda r, **new: F.struct(*[r[x].alias(x) for x in ("token", "n", "size", "change", "plain")], *[c.alias(k) for k, c in new.items()])
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def first(t: Column) -> Column:
        runs = t
        for classes, one in (("[A-Z]?[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^A-Za-z0-9]+", "-")):
            runs = F.regexp_replace(runs, classes, one)
        chars = F.filter(F.split(t, ""), lambda c: c != "")
        e = _encoding(t)
        return F.struct(t.alias("token"), F.length(t).cast("double").alias("n"), _by(e, SIZES).alias("size"), _by(e, CHANGE).alias("change"), _by(e, ORDINARY_CHANGE).alias("plain"), chars.alias("chars"), F.length(runs).cast("double").alias("runs"))

    def second(r: Column) -> Column:
        count = lambda c: r["n"] - F.length(F.replace(r["token"], c, F.lit("")))
        squares = total(F.transform(F.array_distinct(r["chars"]), lambda c: count(c) * count(c)))
        codes = F.transform(r["chars"], lambda c: F.ascii(c).cast("double"))
        return more(r, runs=r["runs"], squares=squares, codes=codes, mean=total(codes) / r["n"])

    def third(r: Column) -> Column:
        auto = total(F.zip_with(r["codes"], F.slice(r["codes"], F.lit(2), F.size(r["codes"])), lambda x, y: F.coalesce((x - r["mean"]) * (y - r["mean"]), F.lit(0.0))))
        var = total(F.transform(r["codes"], lambda x: (x - r["mean"]) * (x - r["mean"])))
        return more(r, runs=r["runs"], squares=r["squares"], serial=F.when(var > 0, auto / var).otherwise(1.0) * F.sqrt(r["n"]))

    def fourth(r: Column) -> Column:
        free, gaps = r["size"] - 1, r["n"] - 1
        chi = r["squares"] * r["size"] / r["n"] - r["n"]
        shift = r["n"] * F.greatest(r["size"] * ORDINARY_SQUARES - 1, F.lit(0.5))
        z_even = (chi - free) / F.sqrt(2 * free * gaps / r["n"])
        z_plain = (chi - free - shift) / F.sqrt(2 * (free + 2 * shift))
        q = F.greatest(r["change"], F.lit(0.01))
        r_even = F.when(r["change"] > 0, (r["runs"] - 1 - gaps * q) / F.sqrt(gaps * q * (1 - q))).otherwise(0.0)
        r_plain = F.when(r["change"] > 0, (gaps * r["plain"] - r["runs"] + 1) / F.sqrt(gaps * r["plain"] * (1 - r["plain"]))).otherwise(0.0)
        even = (z_even < LIMIT) & (F.abs(r_even) < LIMIT) & (F.abs(r["serial"]) < LIMIT)
        return F.struct(r["token"].alias("token"), even.alias("even"), _lower_tail((z_plain + r_plain) / F.sqrt(F.lit(2.0))).alias("p"))

    return F.transform(F.transform(F.transform(F.transform(tokens, first), second), third), fourth)


def stratum(token: Column) -> Column:
    return F.floor(F.log2(F.length(token).cast("double"))).cast("int")


def p_bin(p: Column) -> Column:
    """Tenths of the negative decimal logarithm, rounded down: a bin's p is at most 10 ** (-bin / 10)."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40)))).cast("int")))


def tested(text: Column) -> Column:
    """array<struct<start, end, stratum, bin>> of the tokens of a text; bin is 0 where a test rejects randomness."""

    def results(found: Column) -> Column:
        row = lambda m, t: F.struct(m["start"].alias("start"), m["end"].alias("end"), stratum(t["token"]).alias("stratum"), F.when(t["even"], p_bin(t["p"])).otherwise(0).alias("bin"))
        return F.zip_with(found, battery(F.transform(found, lambda m: m["match"])), row)

    none = F.array().cast("array<struct<start:int,end:int,stratum:int,bin:int>>")
    return F.when(text.rlike(TOKEN), let(matches(text, TOKEN, 0), results)).otherwise(none)


def thresholds(tokens: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each stratum with discoveries the least bin of them: Benjamini-Hochberg over all ``tokens`` (stratum, bin)."""
    counts = tokens.groupBy("stratum", "bin").count()  # 31 strata of BINS rows at most
    above, total = F.expr("sum(count) over (partition by stratum order by bin desc)"), F.expr("sum(count) over (partition by stratum)")
    found = counts.withColumn("above", above).withColumn("total", total)
    good = found.filter((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("total") <= fdr * F.col("above")))
    return {r[0]: r[1] for r in good.groupBy("stratum").agg(F.min("bin")).collect()}


def _all_spans(base: str, tokens: str, limits: dict[int, int]) -> Column:
    """Base spans and discovered tokens that overlap none, sorted by start and kind."""
    if not limits:
        return F.col(base)
    least = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    good = F.filter(tokens, lambda t: (t["bin"] > 0) & F.coalesce(t["bin"] >= least[t["stratum"]], F.lit(False)))
    free = F.filter(good, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return F.when(F.size(tokens) > 0, F.array_sort(F.concat(F.col(base), spans))).otherwise(F.col(base))


def scan(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` and two more columns, whose names are returned: base spans and all spans, each
    array<struct<start, kind, end>> sorted by start and kind."""
    base, tokens, spans = (f"{name}_{uuid.uuid4().hex}" for name in ("base", "tokens", "spans"))
    return _spans(docs.withColumn(base, base_spans(text_of(text_col))).withColumn(tokens, tested(text_of(text_col))), base, tokens, spans, fdr)


def _spans(rows: DataFrame, base: str, tokens: str, spans: str, fdr: float) -> tuple[DataFrame, str, str]:
    rows = staged(rows, "secret-tokens")
    limits = thresholds(rows.select(F.explode(tokens).alias("t")).select("t.stratum", "t.bin"), fdr)
    return rows.withColumn(spans, _all_spans(base, tokens, limits)).drop(tokens), base, spans


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col), base_spans(text).alias("base"), tested(text).alias("tokens"))
    rows, base, spans = _spans(rows, "base", "tokens", "spans", fdr)
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return rows.select(id_col, *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


#: Code points in the pieces that a text is cut into before parts of it are taken, so that a part costs no more than its own pieces.
PIECE = 1024


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each stretch of ``spans`` that overlap or touch."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:  # at: the end of the last stretch, -1 before the first
        return F.greatest(at, s["end"]), F.struct(at.alias("from"), s["start"].alias("to"))

    def part(pieces: Column, a: Column, z: Column) -> Column:
        own = F.array_join(F.slice(pieces, F.floor(a / PIECE).cast("int") + 1, (F.floor(z / PIECE) - F.floor(a / PIECE)).cast("int") + 1), "")
        return F.substring(own, a % PIECE + 1, z - a)

    def build(pieces: Column) -> Column:
        gaps = F.filter(running(spans, -1, step, "struct<from:int,to:int>"), lambda g: g["to"] > g["from"])
        kept = F.transform(gaps, lambda g: F.concat(part(pieces, F.greatest(g["from"], F.lit(0)), g["to"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), part(pieces, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), build)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark``; spans that overlap or touch are replaced together."""
    rows, base, spans = scan(docs, text_col)
    clean = _redacted(text_of(text_col), F.col(spans), mark)
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(F.col(text_col))).drop(base, spans)
