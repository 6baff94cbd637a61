"""Importance resampling toward a target distribution, over a dictionary of distinct features.

Features of a text are its runs of one to three consecutive words (joined by one space, repeats counted); a feature's bucket is the
CRC-32 of its UTF-8 bytes modulo ``BUCKETS``.

1. Texts go through Python once. The texts of a batch form a dictionary: words get numbers, runs become pairs of numbers, and each
   distinct string is hashed once (the CRC of a longer run goes on from that of the run without its last word). Every text keeps
   its features as 16-bit buckets, written to the shared folder.
2. Buckets are counted over all documents and over the target; a bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))).
3. Gains (``BUCKETS`` numbers) are joined back to the features of each document; their sum is its weight.
4. Weights get Gumbel noise from a digest of the id; the highest scores are drawn and numbered over all tasks.

A dictionary spans the texts of ``CHUNK_BYTES``, not the corpus: the README says what one dictionary of the corpus would have to move.

Edge cases: a null or blank text has no words, no features and weight 0; repeated rows have equal scores and are drawn one after
the other; a null doc_id has the noise of an empty id and comes last among equal scores; other columns are ignored, whatever
they are called; empty tables give empty results, an empty target has T = 0 and t = 0. Null texts of the target count as empty.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged, trimmed, tune

BUCKETS = 10_000
LONGEST = 3
SEED = 42
LEAST_WORDS = 20
#: Texts of one dictionary, in bytes; a longer text has one of its own.
CHUNK_BYTES = 6_000_000
_NONE = 65_535

#: A-Z become a-z; other ASCII characters than letters and digits become spaces; bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def buckets_of(texts: list[list[bytes]], buckets: int = BUCKETS) -> list[np.ndarray]:
    """For each text (a list of words) the buckets of its features, in no order that means anything."""
    flat = [w for t in texts for w in t]
    n = len(flat)
    if not n:
        return [np.empty(0, np.uint16) for _ in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    at = np.fromiter(map(number.__getitem__, flat), np.int64, n)
    after = [b" " + w for w in number]
    crc = np.fromiter(map(zlib.crc32, number), np.uint64, len(number))
    ends = np.cumsum([len(t) for t in texts])
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # words of the text from here on
    out = np.full((n, LONGEST), _NONE, np.uint16)
    out[:, 0] = (crc % buckets)[at]
    hashes, run = crc, at
    for size in range(2, LONGEST + 1):
        starts = np.flatnonzero(left >= size)
        if not len(starts):
            break
        pairs = run[starts] * len(number) + at[starts + size - 1]
        distinct, inverse = np.unique(pairs, return_inverse=True)
        before, last = np.divmod(distinct, len(number))
        heads = hashes[before].tolist()
        hashes = np.fromiter(map(zlib.crc32, map(after.__getitem__, last.tolist()), heads), np.uint64, len(distinct))
        out[starts, size - 1] = (hashes % buckets)[inverse]
        run = np.full(n, -1, np.int64)
        run[starts] = inverse
    flat_buckets = out.ravel()
    cuts = np.r_[0, ends] * LONGEST
    return [(part := flat_buckets[a:b])[part != _NONE] for a, b in zip(cuts[:-1], cuts[1:])]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, words) of rows until their texts reach ``CHUNK_BYTES``."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            ids.append(key)
            texts.append(words(text))
            size += len(text or "")
            if size >= CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


@trimmed
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _chunks(batches):
        found = buckets_of(texts)
        for i in range(0, len(ids), 256):
            part = found[i : i + 256]
            columns = [pa.array(ids[i : i + 256], pa.int64()), pa.array([len(t) for t in texts[i : i + 256]], pa.int64()), pa.array([p.tobytes() for p in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets"])


@trimmed
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.bincount(np.frombuffer(x.as_py(), np.uint16), minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets): a row per row; buckets are 16-bit numbers, one for each feature, as bytes."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_features, "doc_id long, n_words long, buckets binary")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of ``features``: at most ``BUCKETS`` rows, partial sums before the shuffle."""
    return rows.select("buckets").mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of each bucket from two tables (bucket, n). These are at most ``BUCKETS`` rows each, so the driver takes them."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for rows, into in ((source, s), (target, t)):
        for bucket, n in rows.collect():
            into[bucket] = n
    S, T = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (S + BUCKETS) / ((int(a) + 1) * (T + BUCKETS)))) for a, b in zip(s, t)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of rows of ``features``."""
    kept = np.asarray(gain, np.int64)

    @trimmed
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([len(b) for b in found], pa.int64()), pa.array([int(kept[b].sum()) for b in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: weight plus Gumbel noise in thousandths, from the id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(rows: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, ... for the highest scores of ``percent`` percent of the rows with ``least_words`` words; null for the others.

    Rows are sorted over all tasks; a row's rank is its place in its task and the number of rows in the tasks before."""
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    able = rows.filter(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.monotonically_increasing_id()  # in its low 33 bits the place in the task, above them the task
    able = staged(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place), "resample-order")
    sizes = sorted(tuple(r) for r in able.groupBy(F.shiftright("__at", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
    total = sum(n for _, n in sizes)
    before, seen = [], 0
    for task, n in sizes:
        before.append((task, seen))
        seen += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__task long, __before long"))  # tasks, not rows
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = able.withColumn("__task", F.shiftright("__at", 33)).join(offsets, "__task").withColumn("rank", F.when(rank <= percent * total // 100, rank).cast("long"))
    return drawn.select(*rows.columns, "rank").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank, n_words) for each row of ``docs``; ``target`` holds texts of the wanted kind."""
    rows = staged(features(docs, id_col, text_col), "resample-features")
    wanted = features(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")))
    gain = gains(bucket_counts(rows), bucket_counts(wanted))
    weights = staged(scored(weighed(rows, gain), seed), "resample-weights")
    out = ranked(weights, percent, least_words)
    return out.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")
