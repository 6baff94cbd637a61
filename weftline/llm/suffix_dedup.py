"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts at another place too, in the same text or in any other. Strings
are judged on the input; matches never cross texts.

1. Anchors. Every window of ``LENGTH`` bytes has an anchor: its ``KEY``-byte string with the smallest hash (ties: the first). Equal windows have
   equal anchors at equal offsets, so two places of a string are met at their common anchor. About 1.2 of 100 bytes start one.
2. An anchor's context is all that windows around it can cover: 168 bytes before it and 168 after. Contexts that occur twice are covered
   whole; anchors with one context alone can't have a repeat. What is left are different contexts of one anchor.
3. Shards. Contexts are dealt by anchor, so all places of a string meet in one shard. They are cut to what they share with a
   neighbour; equal pieces are repeats as they are. What is left of a shard's text gets a suffix array by
   Larsson and Sadakane's refinement (``suffix_array``) and Kasai's common prefixes (``common_prefixes``); runs of suffixes with
   ``LENGTH`` common bytes at equal distance from their anchors are repeats.
4. An anchor with more than ``GROUP_LIMIT`` contexts is dealt anew by longer strings: a window around a key of k bytes reaches at least half
   of the missing bytes to its left or to its right, so it holds one of two longer keys. Their contexts are shorter, and
   equal ones collapse; at ``LENGTH`` bytes the key is the window, and nothing is left to compare. No group meets in one task.
5. The covered spans of all shards are merged for each text, and the rest of its bytes is kept.

Suffix arrays of different shards need no pairwise merging by binary search, whose cost would grow with the square of the number of
shards; that step of the method is replaced by dealing texts so that shards don't share strings.

Rows get a number when they are written to the shared folder, and keep it however the files are read later. Edge cases: a null text is empty; texts under ``LENGTH`` bytes have no strings; repeated rows repeat each other's
bytes; a null doc_id stays; other columns are ignored, whatever they are called; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged, trimmed, tune

LENGTH, KEY = 200, 32
#: Windows that hold a key, and the bytes before a key that they reach.
SPAN, REACH = LENGTH - KEY + 1, LENGTH - KEY
#: Contexts of an anchor before it is dealt anew.
GROUP_LIMIT = 4096
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 1_500_000
#: Anchors whose contexts a task compares before any is written.
TOGETHER = 100_000
#: One of so many places is looked at to find frequent anchors.
SAMPLE = 16
#: Bytes hashed at once; a window's place fits the low bits of its hash.
PART_BYTES, PLACE_BITS = 8_000_000, 24
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: bytes | np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as one number, where there are eight."""
    return np.ndarray((len(data) - 7,), kind, data, 0, (1,))


def key_hashes(data: bytes) -> np.ndarray:
    """A hash of the ``KEY`` bytes from each place on."""
    n, eight = len(data) - KEY + 1, _words(data)
    h = np.zeros(n, np.uint64)
    for j, c in enumerate(_MIX):
        p = eight[8 * j : 8 * j + n] * c
        p ^= p >> np.uint64(31)
        h += p * (_MIX[-1 - j] + np.uint64(2 * j))
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


def _smallest(h: np.ndarray) -> np.ndarray:
    """For each ``SPAN`` hashes in a row the place of the smallest, the first of equal ones: block minima from both sides."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    v = np.r_[v, np.full(SPAN + -len(v) % SPAN, ~np.uint64(0))].reshape(-1, SPAN)
    before = np.minimum.accumulate(v, axis=1).ravel()
    after = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - SPAN + 1
    return (np.minimum(after[:n], before[SPAN - 1 : SPAN - 1 + n]) & low).astype(np.int64)


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of texts that lie one after the other in ``data``."""
    places, found = [], []
    for cut in range(0, max(1, len(data) - LENGTH + 1), PART_BYTES):
        part = data[cut : cut + PART_BYTES + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        h = key_hashes(part)
        at = _smallest(h)
        a, b = np.clip(starts - cut, 0, len(at)), np.clip(ends - LENGTH + 1 - cut, 0, len(at))
        a, b = a[b > a], b[b > a]
        inside = np.cumsum(np.bincount(a, minlength=len(at) + 1) - np.bincount(b, minlength=len(at) + 1))[: len(at)] > 0
        at = np.unique(at[inside])
        places.append(at + cut)
        found.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(found)[first]


def _flat(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes in a row, their starts and ends."""
    parts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in texts]
    ends = np.cumsum([len(p) for p in parts])
    return b"".join(parts), ends - np.array([len(p) for p in parts], dtype=np.int64), ends


@trimmed
def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, c, t, at, rep, twice): anchor, digest of its context, text, place in the text. Of equal contexts that a task meets together one is kept
    (rep) and says so (twice); the places of the others are all that is known of them."""

    def flush() -> pa.RecordBatch:
        a, c, t, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((c, a))
        a, c, t, at = a[order], c[order], t[order], at[order]
        rep = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
        twice = np.diff(np.r_[np.flatnonzero(rep), len(a)])[np.cumsum(rep) - 1] > 1
        columns = [pa.array(a.view(np.int64), mask=~rep), pa.array(c.view(np.int64), mask=~rep), pa.array(t), pa.array(at.astype(np.int32)), pa.array(rep), pa.array(twice)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "c", "t", "at", "rep", "twice"])

    held: list[tuple] = []
    for batch in batches:
        data, starts, ends = _flat(batch.column(1))
        at, a = anchors(data, starts, ends)
        if not len(at):
            continue
        text = np.searchsorted(ends, at, "right")
        lo, hi = np.maximum(starts[text], at - REACH), np.minimum(ends[text], at + LENGTH)
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        c = np.fromiter((digest(view[x:y], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (at - lo).tolist())), np.uint64, len(at))
        held.append((a, c, batch.column(0).to_numpy()[text], at - starts[text]))
        if sum(len(x[0]) for x in held) >= TOGETHER:
            yield flush()
            held = []
    if held:
        yield flush()


@trimmed
def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (a, c, t, at, twice) sorted by a and c: places whose context occurs twice (full), and one place of each context of anchors with several (ship)."""

    def of(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, c, t, at, twice = rows
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_c = new_a | np.r_[True, c[1:] != c[:-1]]
        of_a, of_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        full = np.bincount(of_c, 1.0 + twice)[of_c] > 1
        ship = new_c & (np.bincount(of_a[new_c])[of_a] > 1)
        keep = full | ship
        columns = [pa.array(x[keep]) for x in (a, t, at, full, ship)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "t", "at", "full", "ship"])

    held = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        rows = rows if held is None else [np.r_[x, y] for x, y in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = int(np.argmax(rows[0] == rows[0][-1]))  # rows of an anchor are in a row
        held = [x[last:] for x in rows]
        if last:
            yield of([x[:last] for x in rows])
    if held is not None and len(held[0]):
        yield of(held)


# --- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): places sorted by the ``depth`` bytes from them on; equal ones have equal ranks. Zeros follow the end.

    Larsson and Sadakane: groups of equal ranks are refined by the rank of the place h further on, with h doubled each time;
    groups of one are left alone."""
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    key = _words(padded, ">u8")[:n].astype(np.uint64)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    new = np.r_[True, (s := key[order])[1:] != s[:-1]]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is where it begins
    known = min(8, depth)
    while known < depth:
        step = min(known, depth - known)
        sizes = np.diff(np.r_[np.flatnonzero(new), n])
        many = np.repeat(sizes > 1, sizes)
        spots = np.flatnonzero(many)
        if not len(spots):
            break
        at = order[spots]
        ahead = at + step
        pair = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        turn = np.argsort(pair)
        pair, at = pair[turn], at[turn]
        order[spots] = at
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        new[spots] = fresh
        later = rank.copy() if len(spots) < n else np.empty_like(rank)
        later[at] = spots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        rank = later
        known += step
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, lanes: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each sorted place the bytes it has in common with the one before, up to ``depth``.

    Kasai: what place i has in common with the nearest smaller string, less one, place i + 1 has at least. Equal strings have
    ``depth`` bytes in common; the walk is over what comes before all of them. ``lanes`` are starts from which it goes on side by side
    up to the next start."""
    n = len(data)
    eight = _words(np.r_[data, np.zeros(depth + 8, np.uint8)])
    out = np.full(n, depth, np.int64)
    lengths = np.diff(np.r_[lanes, n])
    by_size = np.argsort(-lengths, kind="stable")
    lanes, lengths = lanes[by_size], lengths[by_size]
    had = np.zeros(len(lanes), np.int64)
    for s in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -s, "left"))  # lanes longer than s
        i = lanes[:live] + s
        spot = rank[i]
        other = order[np.maximum(spot - 1, 0)]
        common = np.maximum(had[:live] - 1, 0)
        todo = np.flatnonzero(spot > 0)
        while len(todo):
            differ = eight[i[todo] + common[todo]] ^ eight[other[todo] + common[todo]]
            same = differ == 0
            lowest = differ & (~differ + np.uint64(1))
            common[todo] += np.where(same, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
            todo = todo[same & (common[todo] < depth)]
        common = np.minimum(common, depth)
        common[spot == 0] = 0
        out[spot] = common
        had[:live] = common
    return np.minimum(out, n - np.maximum(order, np.r_[order[:1], order[:-1]]))


def repeated_windows(contexts: list[bytes], offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the windows that another context of the same group has at the same distance from its key."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    order, rank = suffix_array(data)
    runs = np.cumsum(common_prefixes(data, order, rank, starts) < LENGTH)
    of = np.searchsorted(ends, order, "right")
    inside = order - starts[of]
    whole = inside + LENGTH <= sizes[of]
    runs, of, inside = runs[whole], of[whole], inside[whole]
    keys = np.stack([runs, group[of], inside - offsets[of]])
    turn = np.lexsort(keys)
    keys = keys[:, turn]
    equal = (keys[:, 1:] == keys[:, :-1]).all(0)
    hit = turn[np.r_[False, equal] | np.r_[equal, False]]
    return of[hit], inside[hit]


def _joined(row: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the unions of windows."""
    turn = np.lexsort((start, row))
    row, start = row[turn], start[turn]
    first = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)] if len(row) else np.empty(0, bool)
    last = np.r_[first[1:], True] if len(row) else first
    return row[first], start[first], start[last] + length


def _shared(contexts: list[bytes], offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): how many bytes before and from its key each context has in common with any other of its group. Sorted from the
    key to either side, the nearest neighbour has most in common."""
    sizes = np.array([len(c) for c in contexts], np.int64)

    def side(width: int, lengths: np.ndarray, part) -> np.ndarray:
        m = np.zeros((len(contexts), width), np.uint8)
        for row, c, o in zip(m, contexts, offsets.tolist()):
            p = part(np.frombuffer(c, np.uint8), o)
            row[: len(p)] = p
        order = np.lexsort([*m.view(">u8").T[::-1], group])
        m, kin, n = m[order], group[order], lengths[order]
        differ = m[1:] != m[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width)
        common = np.where(kin[1:] == kin[:-1], np.minimum(common, np.minimum(n[1:], n[:-1])), 0)
        out = np.empty(len(contexts), np.int64)
        out[order] = np.maximum(np.r_[0, common], np.r_[common, 0])
        return out

    return side(REACH, offsets, lambda c, o: c[:o][::-1]), side(LENGTH, sizes - offsets, lambda c, o: c[o:])


def covered(contexts: list[bytes], offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to): stretches of contexts that windows cover which another context of the same group has at the same distance from
    its key. Contexts are cut to what they share with their neighbours; equal pieces are covered whole, and one of them stands for all where
    its group has other pieces, which go through a suffix array."""
    left, right = _shared(contexts, offsets, group)
    pieces: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(left + right >= LENGTH).tolist():
        lo, o = int(left[i]), int(offsets[i])
        pieces.setdefault((int(group[i]), lo, contexts[i][o - lo : o + int(right[i])]), []).append(i)
    kin: dict[int, int] = {}
    for g, _, _ in pieces:
        kin[g] = kin.get(g, 0) + 1
    rows, starts, ends = [], [], []
    for (_, lo, piece), members in pieces.items():
        if len(members) > 1:
            at = offsets[members] - lo
            rows.append(np.array(members))
            starts.append(at)
            ends.append(at + len(piece))
    left_over = [(k, v[0]) for k, v in pieces.items() if kin[k[0]] > 1]
    if left_over:
        which, inside = repeated_windows([k[2] for k, _ in left_over], np.array([k[1] for k, _ in left_over]), np.array([k[0] for k, _ in left_over]))
        which, lo, hi = _joined(which, inside)
        of = np.array([i for _, i in left_over])[which]
        base = offsets[of] - np.array([k[1] for k, _ in left_over])[which]
        rows.append(of)
        starts.append(base + lo)
        ends.append(base + hi)
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (rows, starts, ends))


@trimmed
def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, body, off, t, at, need) sorted by key: (t, lo, hi) of repeated windows of places that need it."""

    def of(rows: list[tuple]) -> pa.RecordBatch:
        key, off, t, at, need = (np.array(x) for x in zip(*((r[0], r[2], r[3], r[4], r[5]) for r in rows)))
        context, lo, hi = covered([r[1] for r in rows], off.astype(np.int64), np.cumsum(np.r_[True, key[1:] != key[:-1]]))
        wanted = need[context]
        context, lo, hi = context[wanted], lo[wanted], hi[wanted]
        base = at[context]
        return pa.RecordBatch.from_arrays([pa.array(t[context].astype(np.int64)), pa.array((base + lo).astype(np.int32)), pa.array((base + hi).astype(np.int32))], names=["t", "lo", "hi"])

    rows, size, key = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if size >= SHARD_BYTES and row[0] != key:
                yield of(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[1])
            key = row[0]
    if rows:
        yield of(rows)


# --- the job -------------------------------------------------------------------------------------------------------


@trimmed
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (t, text, wanted): a row for each wanted context."""
    names = ["key", "body", "off", "t", "at", "need", "hot"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for t, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                lo = max(0, w["at"] - REACH)
                for column, v in zip(out, (w["a"], data[lo : w["at"] + LENGTH], w["at"] - lo, t, lo, w["need"], w["hot"])):
                    column.append(v)
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("d"))


def marks(places: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, t, at, full, ship, need, hot) from rows (a, c, t, at, rep, twice): places whose context occurs twice, and contexts to compare.

    Anchors that a fixed sample of places finds frequent are counted by context with partial sums; the rest of the rows meet by anchor."""
    known = [F.lit(x).alias(n) for x, n in ((True, "full"), (False, "ship"), (False, "need"), (False, "hot"))]
    others = places.filter("not rep").select("a", "t", "at", *known)
    places = places.filter("rep")
    picked = places.filter(F.pmod(F.xxhash64("t", "at"), F.lit(SAMPLE)) == 0)
    frequent = staged(_sizes(picked, "a").filter(F.col("d") * SAMPLE > group_limit).select("a"), "frequent-anchors")
    none = frequent.isEmpty()
    rare = (places if none else places.join(frequent, "a", "left_anti")).select("a", "c", "t", "at", "twice")
    cold = rare.repartition("a").sortWithinPartitions("a", "c").mapInArrow(_marks, "a long, t long, at int, full boolean, ship boolean")
    cold = cold.select("*", (F.col("ship") & ~F.col("full")).alias("need"), F.lit(False).alias("hot")).unionByName(others)
    if none:
        return cold
    often = places.join(frequent, "a", "left_semi")
    by_context = staged(often.groupBy("a", "c").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"), F.min(F.struct("t", "at")).alias("first")), "frequent-contexts")
    full = often.join(by_context.filter("n > 1").select("a", "c"), ["a", "c"], "left_semi")
    full = full.select("a", "t", "at", *known)
    several = by_context.join(_sizes(by_context, "a").filter("d > 1"), "a")
    ship = several.select("a", "first.t", "first.at", F.lit(False).alias("full"), F.lit(True).alias("ship"), (F.col("n") == 1).alias("need"), (F.col("d") > group_limit).alias("hot"))
    return cold.unionByName(full).unionByName(ship)


def _longer(rows: DataFrame, length: int) -> tuple[DataFrame, int]:
    """Rows (key, body, off, t, at, need) of keys of ``length`` bytes under their two longer keys, each place once."""
    half = (LENGTH - length + 1) // 2
    new = length + half
    slack = LENGTH - new
    sides = F.array(F.struct(F.col("off").alias("k"), (F.col("off") + new <= F.length("body")).alias("fits")), F.struct((F.col("off") - half).alias("k"), (F.col("off") >= half).alias("fits")))
    each = rows.select("*", F.explode(sides).alias("s")).filter("s.fits").withColumn("lo", F.greatest(F.lit(0), F.col("s.k") - slack))
    hi = F.least(F.length("body"), F.col("s.k") + new + slack)
    part = lambda start, size: F.expr(f"substring(body, {start} + 1, {size})")
    each = each.withColumn("hi", hi).select(
        F.xxhash64(part("s.k", str(new)), F.lit(new)).alias("key"), part("lo", "hi - lo").alias("body"), (F.col("s.k") - F.col("lo")).alias("off"),
        "t", (F.col("at") + F.col("lo")).cast("int").alias("at"), "need", (F.col("at") + F.col("s.k")).alias("place"),
    )
    once = each.groupBy("t", "place").agg(*[F.max(c).alias(c) for c in ("key", "body", "off", "at", "need")])  # equal in all rows of a place but for need
    return once.select("key", "body", "off", "t", "at", "need"), new


def _dealt_anew(rows: DataFrame, group_limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans, contexts to compare) of rows whose keys have too many contexts."""
    spans, compare, length = [], [], KEY
    while length < LENGTH:
        rows, length = _longer(rows, length)
        rows = staged(rows.withColumn("c", F.xxhash64("body", "off")), "longer-keys")
        if rows.isEmpty():
            break
        equal = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "at")).alias("first"))
        equal = staged(equal, "longer-contexts")
        spans.append(rows.filter("need").join(equal.filter("n > 1").select("key", "c"), ["key", "c"], "left_semi").select("t", F.col("at").alias("lo"), (F.col("at") + F.length("body")).cast("int").alias("hi")))
        sizes = _sizes(equal, "key").filter("d > 1")
        one = equal.join(sizes, "key").select(F.col("key").alias("k"), F.col("first.t").alias("ft"), F.col("first.at").alias("fat"), "n", "d")
        left = rows.join(one, (F.col("key") == F.col("k")) & (F.col("t") == F.col("ft")) & (F.col("at") == F.col("fat")))
        left = staged(left.select("key", "body", "off", "t", "at", (F.col("need") & (F.col("n") == 1)).alias("need"), "d"), "longer-left")
        compare.append(left.filter(F.col("d") <= group_limit).drop("d"))
        rows = left.filter(F.col("d") > group_limit).drop("d")
    return spans, compare


def spans(texts: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(t, lo, hi): stretches of bytes of texts (t, text) that repeated strings cover; they may overlap."""
    places = staged(texts.mapInArrow(_anchor_rows, "a long, c long, t long, at int, rep boolean, twice boolean"), "anchors")
    found = staged(marks(places, group_limit), "anchor-marks")
    whole = found.filter("full").select("t", F.greatest(F.lit(0), F.col("at") - REACH).cast("int").alias("lo"), (F.col("at") + LENGTH).cast("int").alias("hi"))
    wanted = found.filter("ship").groupBy("t").agg(F.collect_list(F.struct("at", "a", "need", "hot")).alias("wanted"))  # at most as many as the text has places
    contexts = texts.join(wanted, "t").select("t", "text", "wanted").mapInArrow(_contexts, "key long, body binary, off int, t long, at int, need boolean, hot boolean")
    parts, compare = [whole], [contexts.drop("hot")]
    if not found.filter("hot").isEmpty():
        contexts = staged(contexts, "contexts")
        more, finer = _dealt_anew(contexts.filter("hot").drop("hot"), group_limit)
        parts += more
        compare = [contexts.filter("not hot").drop("hot"), *finer]
    for rows in compare:
        parts.append(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_shards, "t long, lo int, hi int"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merged(lo: list[int], hi: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal stretches that the given ones cover, within ``size`` bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo, hi)):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@trimmed
def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (doc_id, text, lo, hi): what is left of each text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for text, lo, hi in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            cuts = merged(lo or [], hi or [], len(data))
            digest, at = hashlib.sha256(), 0
            for a, b in cuts:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            for column, v in zip(out, (len(data), sum(b - a for a, b in cuts), len(cuts), digest.hexdigest(), [{"lo": a, "hi": b} for a, b in cuts])):
                column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed) for each row of ``docs``; removed holds the spans as byte places."""
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("t"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = staged(rows, "numbered-texts")  # where files are split depends on the executors that there are, so a number made anew could be another
    cuts = spans(rows.select("t", "text"), group_limit).groupBy("t").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))  # at most as many as the text has places
    out = rows.join(cuts, "t", "left").select("doc_id", "text", "lo", "hi").mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo: int, hi: int>>")
    return out.withColumnRenamed("doc_id", id_col)
