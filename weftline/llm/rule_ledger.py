"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each rule that the
document fails. A policy is a version, a mask of rules and a number of failures that it tolerates. Verdicts of any
policy, and the ablations (what each rule alone, or its absence, would change), come from the ledger by bitwise
operations and counts, without reading a text again.

Measurements of a text are made in Python (exact windows of words need an index); the rest are DataFrame functions.

Edge cases: null or blank texts have no words and fail the rule on length; repeated rows get equal rows; very long texts
take time in proportion to n log n of their words and are held alone; ties don't matter; other columns are ignored; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import staged, tune

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    rank, width = ids, 1
    while width < window:  # numbers of windows, twice as wide each time, then one word more: exact, no hashes
        step = min(width, window - width)
        code = rank[: len(words) - width - step + 1] * (len(words) + 1) + (rank if step == width else ids)[width : width + len(words) - width - step + 1]
        _, rank = np.unique(code, return_inverse=True)
        width += step
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), chars - symbols


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, MEASURES) for every row of ``docs``."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = np.array([measure(x.as_py()) for x in b.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(done[:, i]) for i in range(len(MEASURES))]], names=schema.names)

    return rows.mapInArrow(run, schema)


#: Rules in the order of their bits: SQL over the measurements, true where a document fails.
RULES = {
    "too_few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "too_many_words": "n_words > 1000000",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "duplicate_lines": "n_dup_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}


def bit(name: str) -> int:
    return 1 << list(RULES).index(name)


#: Versions: mask and tolerated failures. Base rules first; a later version adds rules.
POLICIES = {
    "base": (bit("too_few_words") | bit("repeated_words"), 0),
    "v1": (bit("too_few_words") | bit("repeated_words") | bit("symbols") | bit("duplicate_lines") | bit("long_words"), 0),
}


def ledger(measures: DataFrame) -> DataFrame:
    """``measures`` with failed, a long with a bit for each failed rule."""
    failed = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measures.withColumn("failed", failed)


def passes(policy: str) -> Column:
    mask, tolerated = POLICIES[policy]
    return F.bit_count(F.col("failed").bitwiseAND(F.lit(mask).cast("long"))) <= tolerated


def verdicts(entries: DataFrame, policy: str = "v1", id_col: str = "doc_id") -> DataFrame:
    """(id_col, the measurements of the contract, base_failed, kept, failed, policy) from ledger rows."""
    base = passes("base")
    return entries.select(id_col, *MEASURES[:5], (~base).alias("base_failed"), (base & passes(policy)).alias("kept"), "failed", F.lit(policy).alias("policy"))


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, failing, only_this, kept_without): for each rule of a policy the documents that fail it, that fail no other
    rule of the policy, and that the policy would keep without it."""
    mask, tolerated = POLICIES[policy]
    rows = entries.withColumn("own", F.col("failed").bitwiseAND(F.lit(mask).cast("long")))
    counts = rows.groupBy("own").count()  # as many rows as combinations of failures occur
    names = [(n, 1 << i) for i, n in enumerate(RULES) if mask >> i & 1]
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names])).alias("r")
    each = counts.select("own", "count", table).select("own", "count", "r.*")
    has = F.col("own").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias
    return each.groupBy("rule").agg(total(has)("failing"), total(F.col("own") == F.col("bit"))("only_this"), total(F.bit_count(F.col("own").bitwiseAND(F.bitwise_not("bit"))) <= tolerated)("kept_without"))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of ``docs``, written to the shared folder: texts are read once, whatever is asked of it later."""
    return staged(ledger(measured(docs, id_col, text_col)), "rule-ledger")


def all_ablations(entries: DataFrame) -> DataFrame:
    """(policy, rule, failing, only_this, kept_without) for the rules of each policy."""
    each = [ablations(entries, p).select(F.lit(p).alias("policy"), "*") for p in POLICIES]
    return reduce(DataFrame.unionByName, each)


#: Word measures in DuckDB, by lists. Windows are compared as joined words.
_MEASURED = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM d
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines,
    words, CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) ELSE [] END AS wins
  FROM w
), u AS (
  SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM m
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM u
), p AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM r, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id
), x AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM m LEFT JOIN p USING (doc_id)
)
, y AS (
  SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (n_words > 1000000)::BIGINT
    + 8 * (100 * n_symbols > 10 * word_chars)::BIGINT + 16 * (n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
    + 32 * (word_chars < 2 * n_words)::BIGINT + 64 * (word_chars > 15 * n_words)::BIGINT)::BIGINT AS failed
  FROM x
)
"""

ORACLE = _MEASURED + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 91 = 0 AS kept, failed, 'v1' AS policy
FROM y
"""

ABLATIONS = _MEASURED + """
, versions(policy, mask) AS (VALUES ('base', 3), ('v1', 91))
, rules(rule, bit) AS (VALUES ('too_few_words', 1), ('repeated_words', 2), ('symbols', 8), ('duplicate_lines', 16), ('long_words', 64))
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS failing, count(*) FILTER (failed & mask = bit) AS only_this,
  count(*) FILTER (failed & mask & ~bit = 0) AS kept_without
FROM y, versions, rules WHERE mask & bit <> 0 GROUP BY policy, rule
"""
