"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by an item if some window of it, as many words long as the item, has a weighted similarity
of ``THRESHOLD`` or more to it: the sum of the lesser counts of each word shingle over the sum of the greater ones.

1. Windows, without regard to which item they may be like: a window of n words is looked at if enough of its shingles occur
   among all shingles of items of n words for any similarity of ``THRESHOLD`` to be possible. Moving such a window to its
   first shared shingle (or to the last place where it fits) loses none, so windows start only there.
2. Each window gets a 64-bit SimHash fingerprint of its shingles; so does each item.
3. A multi-index finds the items of a window: fingerprints are cut into ``BLOCKS`` blocks of 16 bits, and items are entered under
   every value within ``REACH`` bits of each of their blocks. Two fingerprints within RADIUS = 19 bits have a block within
   ``REACH`` bits, so a window that is looked up under its own four values meets every item within the radius. Only pairs
   whose fingerprints are within the radius go on. Pairs at the threshold differ by about 10 bits (standard deviation
   2.9), so 19 loses fewer than 1 in 1,000 even there; tests hold the result against brute force.
4. The exact weighted similarity of these pairs, counted from the texts, decides.

Only DataFrame functions are used. Words are runs of non-space, A-Z lower-cased; shingles are five words, or the whole
item where it has fewer. Edge cases: null or blank texts and items never match; repeated rows give one result row for each
distinct (id, text); rows with a null id are judged like others, and so are items with a null item id; items are told
apart by a hash of their words, so texts that share an item id are judged one by one and the id gets its best window,
and ids that share a text get a row each; very long texts work in arrays of their own words; of windows of a single shingle
that are equal the first is looked at; ties go to the first window, then to the shorter text; other columns are ignored;
empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ascii_lower, bounded, staged, text_of, words_of

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, REACH = 4, 4
#: Two fingerprints that differ in more bits than REACH in each block differ in more than this.
RADIUS = BLOCKS * (REACH + 1) - 1
#: A side is broadcast only when it was counted and has at most so many rows of a few numbers; else the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bits of a fingerprint are counted in lanes of 32 bits, two to a long: sums stay below the sign for 2^31 - 1 shingles, which no array exceeds.
LANE, LANES = (1 << 32) - 1, (1 << 32) + 1


def _hashes(width: int) -> Column:
    """Hashes of the shingles of ``width`` words of the column words."""
    words = ", ".join(f"get(words, i + {k})" for k in range(width))
    return F.expr(f"if(size(words) >= {width}, transform(sequence(0, size(words) - {width}), i -> xxhash64({words})), array())")


def _item_words(items: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """(keep, words, item) of items with words: item is the hash of the words, which tells texts apart."""
    rows = items.select(*keep, words_of(ascii_lower(text_of(text_col))).alias("words"))
    return rows.filter(F.size("words") > 0).withColumn("item", F.xxhash64("words"))


def _item_shingles(items: DataFrame, text_col: str) -> DataFrame:
    """(item, n, width, q, h): words of the item, words of its shingles, place and hash of each."""
    rows = _item_words(items, text_col).distinct().withColumn("n", F.size("words")).withColumn("width", F.least(F.col("n"), F.lit(SHINGLE)))
    hashes = F.coalesce(*[F.when(F.col("width") == k, _hashes(k)) for k in range(1, SHINGLE + 1)])
    return rows.select("item", "n", "width", F.posexplode(hashes).alias("q", "h"))


def _fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp) of each group of rows (keys, h): one row for each shingle, repeats included. A bit is set if it is in over half of the h."""
    # two bits of h are spread to two lanes of 32 bits of a long, for each two bits
    sums = [F.expr(f"sum(((shiftrightunsigned(h, {2 * i}) & 3) * {(1 << 31) + 1}) & {LANES})").alias(f"s{i}") for i in range(32)]
    bits = [f"if(2 * (shiftrightunsigned(s{i // 2}, {32 * (i % 2)}) & {LANE}) > m, shiftleft(1L, {i}), 0L)" for i in range(64)]
    return shingles.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *sums).select(*keys, F.expr(" | ".join(bits)).alias("fp"))


def _block_values() -> Column:
    """(block, value) of each block of fp."""
    size = 64 // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", size * i).bitwiseAND(F.lit((1 << size) - 1)).cast("int").alias("value")) for i in range(BLOCKS)])


def _near_masks() -> Column:
    """Every mask of a block with at most REACH bits, as one array."""
    masks = [sum(1 << b for b in bits) for k in range(REACH + 1) for bits in combinations(range(64 // BLOCKS), k)]
    return F.lit(np.array(masks, np.int32))


def _index(items: DataFrame) -> DataFrame:
    """(n, block, value, item, fpi): each item (item, n, fp) under every value near each of its blocks."""
    cut = items.select("item", "n", F.col("fp").alias("fpi"), F.inline(_block_values()))
    return cut.select("n", "block", "item", "fpi", F.explode(F.transform(_near_masks(), lambda m: m.bitwiseXOR(F.col("value")))).alias("value"))


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(n, fp, item) of all pairs of a fingerprint of ``windows`` (n, fp) and an item of ``items`` (item, n, fp) of as many
    words that differ in RADIUS or fewer bits."""
    keyed = windows.select("n", "fp").distinct().select("n", "fp", F.inline(_block_values()))
    met = keyed.join(staged(_index(items), "item-index"), ["n", "block", "value"])  # written, so that its size is known before the join
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fpi"))) <= RADIUS).select("n", "fp", "item").distinct()


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if bounded(df, BROADCAST_ROWS) else df


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Rows of the same id and text."""
    return left["doc_id"].eqNullSafe(right["d"]) & (left["text_hash"] == right["t"])


def _windows(rows: DataFrame, shingles: DataFrame, widths: list[int], threshold: float) -> DataFrame:
    """(doc_id, text_hash, n, width, start, size): windows of rows (doc_id, text_hash, text) with enough shingles that items of n words have."""
    known = staged(shingles.select("width", "h", "n").distinct(), "known-shingles")
    words = rows.select("doc_id", "text_hash", words_of(ascii_lower(F.col("text"))).alias("words")).withColumn("n_doc", F.size("words"))
    hits = None
    for k in widths:
        own = words.select("doc_id", "text_hash", "n_doc", F.posexplode(_hashes(k)).alias("pos", "h"))
        own = own.join(_small(known.filter(F.col("width") == k).select("h").distinct()), "h", "left_semi").withColumn("width", F.lit(k))
        hits = own if hits is None else hits.unionByName(own)
    hits = staged(hits, "shingle-hits").distinct()
    found = hits.join(_small(known), ["width", "h"])  # as many rows a hit as items with its shingle have sizes
    size = F.col("n") - F.col("width") + 1
    fits = F.least(F.col("size"), F.col("n_doc") - F.col("width") + 1)
    start = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n_doc") - F.col("n")))
    # hits in a window: those before its end less those before its first, both from one running sum over places
    rows = found.withColumn("size", size).select("*", F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("hit")), F.struct((F.col("pos") + F.col("size")).alias("at"), F.lit(0).alias("hit")))).alias("e"))
    rows = rows.select("doc_id", "text_hash", "n", "n_doc", "width", "size", "pos", "h", "e.*")
    rows = rows.withColumn("before", F.expr("sum(hit) over (partition by doc_id, text_hash, n order by at, hit rows unbounded preceding)"))
    ends = F.max(F.when(F.col("hit") == 0, F.col("before"))) - F.max(F.when(F.col("hit") == 1, F.col("before"))) + 1
    near = rows.groupBy("doc_id", "text_hash", "n", "n_doc", "width", "size", "pos", "h").agg(ends.alias("hit"))
    near = near.withColumn("least", F.ceil(threshold / (1 + threshold) * (fits + F.col("size")) - 1e-9))
    near = near.filter(F.col("hit") >= F.col("least")).select("doc_id", "text_hash", "n", "width", start.alias("start"), fits.alias("size"), "h")
    # windows of one shingle that are equal are one
    twin = F.when(F.col("size") == 1, F.col("h")).otherwise(F.col("start"))
    return near.groupBy("doc_id", "text_hash", "n", "width", "size", twin.alias("twin")).agg(F.min("start").alias("start")).drop("twin")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, text_hash, item_id, start, n_words, similarity): for each contaminated document and item its best window."""
    shingles = staged(_item_shingles(items, "text"), "item-shingles")
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())  # 1 to 5
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    if not widths:
        empty = docs.select(F.col(id_col), F.lit(0).cast("long").alias("text_hash")).limit(0)
        return empty.crossJoin(items.select(F.col(item_col).alias("item_id")).limit(0)).selectExpr("*", "0 as start", "0 as n_words", "0d as similarity")
    windows = staged(_windows(rows, shingles, widths, threshold), "windows")

    # shingles of the documents that have windows, from here on the only texts
    wanted = windows.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    texts = rows.join(_small(wanted), _same(rows, wanted), "left_semi").distinct()
    words = texts.select("doc_id", "text_hash", words_of(ascii_lower(F.col("text"))).alias("words"))
    texts = staged(words.select("doc_id", "text_hash", F.explode(F.array(*[F.struct(F.lit(k).alias("width"), _hashes(k).alias("hashes")) for k in widths])).alias("x")).select("doc_id", "text_hash", "x.*"), "window-texts")

    def spread(of: DataFrame, *keys: str) -> DataFrame:
        """(doc_id, text_hash, n, start, keys, h): a row for each shingle of the windows ``of``."""
        w = of.withColumnsRenamed({"doc_id": "d", "text_hash": "t", "width": "k"})
        met = texts.join(w, _same(texts, w) & (texts["width"] == w["k"]))
        return met.select("doc_id", "text_hash", "n", "start", *keys, F.explode(F.slice("hashes", F.col("start") + 1, F.col("size"))).alias("h"))

    window = ["doc_id", "text_hash", "n", "start"]
    marked = staged(_fingerprints(spread(windows, "width", "size"), [*window, "width", "size"]), "window-fingerprints")
    pairs = within_radius(marked, _fingerprints(shingles, ["item", "n"]))
    candidates = marked.join(pairs, ["n", "fp"]).drop("fp")

    counted = spread(candidates, "item", "size").groupBy(*window, "item", "size", "h").agg(F.count(F.lit(1)).alias("c"))
    item_counts = shingles.groupBy("item", "h").agg(F.count(F.lit(1)).alias("ci"))
    both = counted.join(item_counts, ["item", "h"]).groupBy(*window, "item", "size").agg(F.sum(F.least("c", "ci")).alias("both"))
    item_size = F.col("n") - F.least(F.col("n"), F.lit(SHINGLE)) + 1
    verified = both.withColumn("similarity", F.col("both") / (F.col("size") + item_size - F.col("both"))).filter(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("start", F.col("n").alias("n_words"), "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
    found = verified.groupBy("doc_id", "text_hash", "item").agg(best)
    names = _item_words(items, "text", F.col(item_col).alias("item_id")).select("item", "item_id").distinct()
    found = found.join(names, "item")
    first = F.max_by("best", F.struct("best.similarity", -F.col("best.start"), -F.col("best.n_words"))).alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(first).select(F.col("doc_id").alias(id_col), "text_hash", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    bad = staged(contaminated(docs, items, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(text_of(text_col)) == bad["__hash"])
    return docs.join(F.broadcast(bad) if bounded(bad, 200_000) else bad, same, "left_anti")
