"""SimHash near-duplicate detection with pivot distance tables.

Each document gets a 64-bit fingerprint of its word shingles; fingerprints at ``RADIUS`` or fewer differing
bits link, and linked documents form components.

1. Fingerprints are made in one pass over the texts; equal ones collapse to one row, so copies cost nothing later.
2. Of two fingerprints within 3 bits, at least one of four 16-bit blocks is equal. Fingerprints meet under each of
   their blocks. A block with more than ``GROUP_LIMIT`` fingerprints is dealt anew by the blocks of its remaining
   bits, again and again; at the last level a group has at most 2**15 values, whatever the input.
3. Inside a group every fingerprint has a table of Hamming distances to ``PIVOTS`` reference fingerprints. By the
   triangle inequality a pair whose distances to any reference differ by more than the radius can't link; it is
   discarded, and the survivors are verified bit by bit. Pairs already connected are skipped, and a group returns
   a star for each connected set, so its output is linear in its size.
4. The stars are joined to components by alternating minimum-label steps on DataFrames, staged after each step.

Edge cases: a null or blank text has fingerprint 0, linked like any other; repeated rows and ties get the same
component; a null id never becomes a component id unless no member has an id (then it is null); other columns are
ignored, whatever they are called; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged, trimmed, tune

RADIUS = 3
SHINGLE = 3
SEED = 42
PIVOTS = 16
#: Fingerprints in a group before it is dealt anew.
GROUP_LIMIT = 4096
_ALL = (1 << 64) - 1


def _bits_over_half(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text: A-Z lower-cased, split at ASCII white space, shingles with repeats, XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    one, h, join = xxhash.xxh64_intdigest, seed, b" ".join
    return _bits_over_half(np.fromiter((one(join(words[i : i + shingle]), h) for i in range(n)), dtype=np.uint64, count=n))


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Column of fingerprints as signed longs."""

    @trimmed
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([simhash(x.as_py(), shingle, seed) for x in texts], dtype=np.uint64).view(np.int64))

    return F.arrow_udf(of, "bigint")(text.cast("string"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """Masks that hold ``mask`` and one of ``parts`` blocks of the other bits."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cut = [round(len(rest) * i / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in rest[cut[i] : cut[i + 1]]) for i in range(parts)]


def _levels() -> list[dict[int, list[int]]]:
    """For each level, the masks of the level before and what each is split into. 1, 4, 16, 64 and 256 masks."""
    out, level = [], [0]
    for _ in range(5):
        out.append({m: _split(m) for m in level})
        level = [c for m in level for c in out[-1][m]]
    return out


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 7) for i in range(n)], dtype=np.uint64)


def _connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each connected set) after edges a-b are added."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def link_sorted(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect, within each group, the fingerprints that links connect.

    ``group`` is non-decreasing; a fingerprint occurs once in a group."""
    refs = pivots()
    first = np.bitwise_count(fps ^ refs[0]).astype(np.int16)
    order = np.lexsort((first, group))
    group, fps, first = group[order], fps[order], first[order]
    to = np.stack([np.bitwise_count(fps ^ p) for p in refs[1:]]).astype(np.int16)  # the pivot distance table
    label = np.arange(len(fps))
    active, d = np.arange(len(fps)), 0
    while True:
        d += 1
        active = active[active + d < len(fps)]
        near = (group[active] == group[active + d]) & (first[active + d] - first[active] <= radius)
        active = active[near]
        if not len(active):
            break
        a, b = active, active + d
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for row in to:
            close = np.abs(row[a] - row[b]) <= radius
            a, b = a[close], b[close]
        same = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        if same.any():
            label = _connect(label, a[same], b[same])
    low, at = fps.view(np.int64).copy(), np.arange(len(fps))
    smallest = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, low)
    other = low != smallest[label[at]]
    return low[other], smallest[label][other]


@trimmed
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (mask, value, fp) sorted by group; a group that a batch ends in waits for the next."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
            u, v = link_sorted(np.cumsum(new), rows[:, 2].copy().view(np.uint64))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        if sum(map(len, held)) < 32768:
            continue
        rows = np.concatenate(held)
        last = (rows[:, :2] == rows[-1, :2]).all(1)
        end = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
        held = [rows[end:]]
        yield from flush(rows[:end])
    if held:
        yield from flush(np.concatenate(held))


def links(fps: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (u, v), v < u, that connect the distinct fingerprints of ``fps`` (column fp) as all links would."""
    spark = fps.sparkSession
    levels = _levels()
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in levels[0][0]])).alias("mask"))
    keyed = keyed.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    parts = []
    for level in levels[1:]:
        large = staged(keyed.groupBy("mask", "value").count().filter(F.col("count") > group_limit).drop("count"), "large-groups")
        if large.isEmpty():
            break
        parts.append(keyed.join(large, ["mask", "value"], "left_anti"))
        rows = [(_signed(m), [_signed(x) for x in c]) for m, c in level.items()]
        finer = spark.createDataFrame(rows, "mask long, finer array<long>")  # 256 rows at most
        again = keyed.join(large, ["mask", "value"], "left_semi").join(F.broadcast(finer), "mask")
        again = again.select("fp", F.explode("finer").alias("mask"))
        keyed = again.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    parts.append(keyed)
    found = None
    for part in parts:
        part = part.repartition("mask", "value").sortWithinPartitions("mask", "value")
        stars = part.mapInArrow(_stars, "u long, v long")
        found = stars if found is None else found.unionByName(stars)
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node that it can reach.

    Alternating large-star and small-star steps until nothing changes; each step is two grouped joins, written to
    the shared folder."""
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        edges = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        star = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def component_table(rows: DataFrame, id_col: str = "doc_id", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``rows`` (id_col, fp): its component and the least id in it."""
    fps = staged(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    roots = components(links(fps.select("fp"), group_limit)).withColumnRenamed("node", "fp")
    of = staged(fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id."""
    tune(docs.sparkSession)
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "documents-fp")
    of = component_table(rows, "doc_id", group_limit)
    return rows.join(of, "fp").select(F.col("doc_id").alias(id_col), as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component kept: the one with the least id (of equal ids, one row).

    Rows are written once with their fingerprint and a number; which rows go is settled on these alone."""
    tune(docs.sparkSession)
    fp, number = f"fp_{uuid.uuid4().hex}", f"row_{uuid.uuid4().hex}"
    marked = staged(docs.withColumns({fp: fingerprint(F.col(text_col)), number: F.monotonically_increasing_id()}), "documents-fp")
    rows = marked.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"), F.col(number).alias("row"))
    of = component_table(rows).select("fp", "root")
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    best = of.join(first, "fp").groupBy("root").agg(F.min("first").alias("best"))
    best = staged(of.join(best, "root").select("fp", F.col("best.row").alias("best")), "kept")
    gone = rows.join(best, "fp").filter("row <> best").select(F.col("row").alias(number))
    return marked.join(gone, number, "left_anti").drop(fp, number)
