"""Reconciliation of a corpus with its source, word by word.

Two word lists get the edits of the plain diff (difflib without junk), however long they are. Long lists aren't searched word by word:
runs of words that are in both are numbered, twice as long each time, until few pairs are left; the longest equal stretches are taken
from these, and what lies between them is searched for shorter ones. So the cost is about linear in the words, and more
where a few words come again and again. Words are compared as numbers.
"""

from __future__ import annotations

import difflib
import heapq
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate, count, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Product of the two lengths up to which all pairs of words are compared at once. The result is the same beyond.
PLAIN = 250_000
#: Product up to which difflib itself is used. The result is the same beyond.
TINY = 5_000
#: Lengths of the equal stretches that are taken one after the other where all pairs are compared.
LENGTHS = (4, 1)
#: Equal pairs of runs for a word up to which they are listed. The result is the same beyond.
PAIRS = 1
#: Words of context before a difference.
CONTEXT = 6

Block = tuple[int, int, int]
#: Windows between blocks: where each ends in a, its start in a, and both in b; the blocks themselves begin at all ends but the last.
Windows = tuple[list[int], list[int], list[int], list[int]]
#: (minus length, place in a, place in b) of stretches.
Heap = list[Block]


def _stretches(cells: np.ndarray, n: int, run: int, least: int) -> Heap:
    """The equal stretches of at least ``least`` words, of the sorted pairs of equal runs of ``run`` words, each numbered by diagonal and place in a."""
    begins = np.flatnonzero(np.diff(cells, prepend=-2) != 1)
    sizes = np.diff(begins, append=len(cells)) + run - 1
    long = sizes >= least
    start, sizes = cells[begins[long]], sizes[long]
    i = start % (n + 1)
    j = i + start // (n + 1) - (n - 1)
    return list(zip((-sizes).tolist(), i.tolist(), j.tolist()))


def _take(heap: Heap, windows: Windows, found: list[Block], least: int) -> None:
    """Takes stretches from the longest on, of these the first in a, then in b; one that blocks found before cut is put back as what is left of it."""
    first_a, end_a, first_b, end_b = windows
    heapq.heapify(heap)
    while heap:
        size, i, j = heapq.heappop(heap)
        end = i - size
        k = bisect_right(first_a, i)
        whole = False
        while k < len(first_a) and end_a[k] < end:
            x, y = max(i, end_a[k], end_b[k] + i - j), min(end, first_a[k], first_b[k] + i - j)
            if x == i and y == end:
                whole = True
                break
            if y - x >= least:
                heapq.heappush(heap, (x - y, x, x + j - i))
            k += 1
        if whole:
            found.append((i, j, -size))
            first_a.insert(k, i)
            first_b.insert(k, j)
            end_a.insert(k + 1, end)
            end_b.insert(k + 1, j - size)


def _plain(a: np.ndarray, b: np.ndarray) -> list[Block]:
    """The blocks of the plain diff (difflib without junk): the longest equal stretch, of these the first in a, then in b; and the same on
    both sides of it.

    All equal pairs of words are found at once, along diagonals. Short stretches are looked at once the longer ones have left little room."""
    n, m = len(a), len(b)
    if max(a.max(), b.max()) < 32_000:  # half of the memory to go through
        a, b = a.astype(np.int16), b.astype(np.int16)
    wide = np.full(m + 2 * n, -1, a.dtype)
    wide[n - 1 : n - 1 + m] = b
    rows = np.lib.stride_tricks.sliding_window_view(wide, n + 1)[: n + m - 1]  # a row a diagonal, and a last column that equals nothing
    own = np.append(a, a.dtype.type(-2))
    cells = np.flatnonzero(rows == own)
    windows = first_a, end_a, first_b, end_b = [n], [0], [m], [0]
    found: list[Block] = []
    for least in LENGTHS:
        if found:
            i = cells % (n + 1)
            j = i + cells // (n + 1) - (n - 1)
            k = np.searchsorted(np.array(first_a), i, "right")
            k[k == len(first_a)] = 0
            cells = cells[(i >= np.array(end_a)[k]) & (j >= np.array(end_b)[k]) & (j < np.array(first_b)[k])]
        if not len(cells):
            break
        _take(_stretches(cells, n, 1, least), windows, found, least)
    return sorted(found)


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges, and which range each is of."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(np.arange(len(size)), size)


def _shared(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers by place (of ``n`` and ``m``) of the values x at places p and y at q that are on both sides, -1 elsewhere; and how many pairs are equal."""
    keys, of = np.unique(np.concatenate([x, y]), return_inverse=True)
    in_x, in_y = np.bincount(of[: len(x)], minlength=len(keys)), np.bincount(of[len(x) :], minlength=len(keys))
    of[((in_x == 0) | (in_y == 0))[of]] = -1
    left, right = np.full(n, -1), np.full(m, -1)
    left[p], right[q] = of[: len(x)], of[len(x) :]
    return left, right, int(in_x @ in_y)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All pairs of places with equal numbers, as cells of diagonal and place in a."""
    n, p, q = len(left), np.flatnonzero(left >= 0), np.flatnonzero(right >= 0)
    q = q[np.argsort(right[q], kind="stable")]
    start, end = (np.searchsorted(right[q], left[p], side) for side in ("left", "right"))
    at, k = _ranges(start, end)
    return np.sort((q[at] - p[k] + n - 1) * (n + 1) + p[k])


def _levels(left: np.ndarray, right: np.ndarray, run: int, bound: int, windows: Windows, found: list[Block]) -> None:
    """Takes stretches of less than ``bound`` (at most 2 * ``run``) down to ``run`` words, a length at a time, by the numbers of runs.

    No window holds a longer stretch, so of each length a pass from left to right takes the first place in a that has one, with its first in
    b: what it leaves on its left has none of that length, and the pass goes on behind it."""
    first_a, end_a, first_b, end_b = windows
    n, m, top = len(left), len(right), int(left.max()) + 1
    left, right = np.append(left, np.full(run, -1)), np.append(right, np.full(run, -1))
    length, changed = bound, True
    while length > run:
        if changed:  # a stretch has all of its runs numbered
            most = run - 1 + min(int(np.diff(np.flatnonzero(side < 0), prepend=-1).max()) - 1 for side in (left, right))
        length, changed = min(length - 1, most), False
        more = length - run
        if more < 0:
            break
        p = np.flatnonzero((left[:n] >= 0) & (left[more : more + n] >= 0))
        q = np.flatnonzero((right[:m] >= 0) & (right[more : more + m] >= 0))
        x, y = left[p] * top + left[p + more], right[q] * top + right[q + more]
        p, q = p[np.isin(x, y)], q[np.isin(y, x)]
        if not len(p):
            continue
        keys, of = np.unique(right[q] * top + right[q + more], return_inverse=True)
        places = np.append(np.sort(of * (m + 1) + q), len(keys) * (m + 1))
        base = np.searchsorted(keys, left[p] * top + left[p + more]) * (m + 1)
        k = np.searchsorted(first_a, p, "right")
        to, stop = places[np.searchsorted(places, base + np.array(end_b)[k])], base + np.array(first_b)[k]
        hit = to < stop
        x = y = 0
        for i, j, low, high in zip(p[hit].tolist(), (to - base)[hit].tolist(), base[hit].tolist(), stop[hit].tolist()):
            if i < x:
                continue
            if j < y:  # the first behind what this pass has taken
                j = int(places[np.searchsorted(places, low + y)])
                if j >= high:
                    continue
                j -= low
            x, y = i + length, j + length
            found.append((i, j, length))
            for values, value in zip(windows, (i, x, j, y)):
                values.append(value)
            left[max(0, i - run + 1) : x] = right[max(0, j - run + 1) : y] = -1
            changed = True
        if changed:
            for values in windows:
                values.sort()


def _long(a: np.ndarray, b: np.ndarray) -> list[Block]:
    """The blocks of the plain diff without a look at all pairs of words.

    Runs of 1, 2, 4, ... words are numbered within the windows between blocks until few pairs are equal. All stretches of such runs are listed
    and taken; windows then hold shorter ones only, and are numbered anew. Where even the longest runs that are left have many pairs (a few words
    again and again), their lengths are gone through one by one."""
    n, m, words = len(a), len(b), int(max(a.max(), b.max())) + 1
    windows, found, bound = ([n], [0], [m], [0]), [], 2 * min(n, m) + 2
    while bound > 1:
        first_a, end_a, first_b, end_b = map(np.array, windows)
        both = (first_a > end_a) & (first_b > end_b)
        (p, u), (q, v) = _ranges(end_a[both], first_a[both]), _ranges(end_b[both], first_b[both])
        few, run = PAIRS * (len(p) + len(q)), 1
        left, right, pairs = _shared(p, u * words + a[p], q, v * words + b[q], n, m)
        while pairs > few and 2 * run < bound:  # two runs beside each other are in one window, as a block is between windows
            top = int(left.max()) + 1
            p, q = (np.flatnonzero((side[:-run] >= 0) & (side[run:] >= 0)) for side in (left, right))
            left, right, pairs = _shared(p, left[p] * top + left[p + run], q, right[q] * top + right[q + run], n, m)
            run *= 2
        if pairs > few:
            _levels(left, right, run, bound, windows, found)
        elif pairs:
            _take(_stretches(_pairs(left, right), n, run, run), windows, found, run)
        bound = run
    return sorted(found)


def _short(a: list[str], b: list[str], x: np.ndarray, y: np.ndarray) -> list[Block]:
    """The same by the way that is quickest for the size."""
    if len(a) == 1:
        return [(0, b.index(a[0]), 1)] if a[0] in b else []
    if len(b) == 1:
        return [(a.index(b[0]), 0, 1)] if b[0] in a else []
    if len(a) * len(b) <= TINY:
        return [(i, j, n) for i, j, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if n]
    return _plain(x, y)


def blocks(a: list[str], b: list[str]) -> list[Block]:
    """(place in a, place in b, length) of the equal stretches of the plain diff, rising in both. Lengths decide how they are found, not what they are."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    if not a or not b:
        return []
    numbers: dict[str, int] = defaultdict(count().__next__)
    size = len(a) * len(b)
    # where difflib is quicker, numbers aren't needed
    x, y = (np.array([numbers[w] for w in words] if size > min(TINY, PLAIN) else [], np.int32) for words in (a, b))
    return _short(a, b, x, y) if size <= PLAIN else _long(x, y)


def edits(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to) of the stretches that differ."""
    out, x, y = [], 0, 0
    for i, j, n in [*blocks(a, b), (len(a), len(b), 0)]:
        if i > x or j > y:
            out.append((x, i, y, j))
        x, y = i + n, j + n
    return out


def word_edits(old: Column, new: Column) -> Column:
    """array<struct<kind, was, now>>: the word edits from one text to another (case aside); spacing where letters and digits are equal. Null texts
    are empty."""

    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        lower = lambda words: " ".join(words).lower().split(" ") if words else []
        for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
            if x == y:
                out.append([])
                continue
            p, q = re.findall(r"\w+", x or ""), re.findall(r"\w+", y or "")
            row = []
            for i, k, j, m in edits(lower(p), lower(q)):
                was, now = " ".join(p[i:k]), " ".join(q[j:m])
                same = was.replace(" ", "").lower() == now.replace(" ", "").lower()
                row.append({"kind": "spacing" if same else "delete" if j == m else "insert" if i == k else "replace", "was": was, "now": now})
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("was", pa.string()), ("now", pa.string())])))

    return F.arrow_udf(run, "array<struct<kind:string,was:string,now:string>>")(old, new)


def _bare(words: list[str]) -> str:
    return re.sub(r"[^a-z0-9]", "", "".join(words).lower())


def _beside(i: int, step: int, stop: int, to: dict[int, int], table: list[bool]) -> int | None:
    """The nearest word from ``i`` on that begins three words of prose matched in a row."""
    while 0 <= i < stop:
        three = [i, i + step, i + 2 * step]
        if all(0 <= k < stop and k in to and not table[k] for k in three) and to[three[2]] - to[three[0]] == 2 * step:
            return i
        i += step
    return None


def differences(a: list[str], owners: list[str], table: list[bool], b: list[str], lines: list[int]) -> list[dict]:
    """Differences of a corpus (words with owner and whether they are a table's) and its source (words with line): spacing, table_layout or
    extraction. A table's cells are read in another order in the source, so a table is compared with the source words between the prose
    that matches on both sides of it, as bags of letters and words."""
    low_a, low_b = [w.lower() for w in a], [w.lower() for w in b]
    to = {i + n: j + n for i, j, size in blocks(low_a, low_b) for n in range(size)}
    done_a, done_b, out = [False] * len(a), [False] * len(b), []

    def record(kind: str, i: int, j: int, corpus: list[str], source: list[str]) -> None:
        owner = owners[min(i, len(owners) - 1)] if owners else None
        out.append({"kind": kind, "owner": owner, "line": lines[min(j, len(lines) - 1)] if lines else None, "corpus": " ".join(corpus), "source": " ".join(source), "context": " ".join(a[max(0, i - CONTEXT) : i])})

    ends = list(accumulate(len(list(g)) for _, g in groupby(table)))
    tables = [(begin, end) for begin, end in zip([0, *ends], ends) if table[begin]]
    compared = 0
    for begin, end in tables:
        if begin < compared:  # part of the stretch of the table before
            continue
        before, after = _beside(begin - 1, -1, len(a), to, table), _beside(end, 1, len(a), to, table)
        lo, j = (0, 0) if before is None else (before + 1, to[before] + 1)
        compared, m = (len(a), len(b)) if after is None else (after, max(j, to[after]))
        mine, other = a[lo:compared], b[j:m]
        done_a[lo:compared], done_b[j:m] = [True] * len(mine), [True] * len(other)
        left, right = _bare(mine), _bare(other)
        if left == right:
            continue
        if Counter(left) == Counter(right):
            record("table_layout", lo, j, mine, other)
        else:
            x, y = Counter(w.lower() for w in mine), Counter(w.lower() for w in other)
            record("extraction", lo, j, list((x - y).elements()), list((y - x).elements()))
    for i, k, j, m in edits(low_a, low_b):
        mine, other = [a[x] for x in range(i, k) if not done_a[x]], [b[y] for y in range(j, m) if not done_b[y]]
        if mine or other:
            record("spacing" if _bare(mine) == _bare(other) else "extraction", i, j, mine, other)
    return out


def reconciled(corpus: DataFrame, source: DataFrame) -> DataFrame:
    """(doc, kind, owner, line, corpus, source, context): differences of each document of corpus rows (doc, pos, id, text, in_table) and source lines
    (doc, line, text). A document is one task's, as its alignment is one; its cost is about linear in its words."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\s|]+"), F.lit(0))
    a = corpus.select(F.col("doc").cast("string").alias("doc"), F.col("pos").cast("long").alias("pos"), F.col("id").cast("string").alias("id"), words.alias("words"), F.coalesce("in_table", F.lit(False)).alias("in_table"))
    b = source.select(F.col("doc").cast("string").alias("doc"), F.col("line").cast("long").alias("line"), words.alias("words"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values(["pos", "id"]), y.sort_values("line")
        flat = lambda rows, values: [v for words, v in zip(rows.words, values) for _ in words]
        every = lambda rows: [w for words in rows.words for w in words]
        found = differences(every(x), flat(x, x.id), flat(x, x.in_table), every(y), flat(y, y.line))
        doc = (x if len(x) else y).doc.iloc[0]
        return pd.DataFrame([{"doc": doc, **d} for d in found], columns=["doc", "kind", "owner", "line", "corpus", "source", "context"])

    return a.groupBy("doc").cogroup(b.groupBy("doc")).applyInPandas(run, "doc string, kind string, owner string, line long, corpus string, source string, context string")
