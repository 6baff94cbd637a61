"""Vector search: filtered top-k, the neighbour graph in blocks (exact), and inverted lists (``VectorIndex``).

Rows without a usable vector (null, empty, with null or non-finite entries, or of length zero in norm) have no neighbours and are
none; vectors of different lengths are never compared."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.sources.shared import new_path, staged


#: Rows of a block of the neighbour graph, and of the part of it that is multiplied at once.
BLOCK_ROWS, PART_ROWS = 4096, 512
#: An index is fitted on at most so many rows, has at most so many lists, and finds its reach with so many of those rows as questions.
FIT_ROWS, MOST_LISTS, FIT_QUESTIONS = 20_000, 4_096, 400
#: Shelves that lists lie on, and the rows of each side that one task compares on a shelf. A row asks once on a shelf, whatever the number of lists.
SHELVES, SHELF_ROWS = 16, 65_536


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding has numbers only and isn't zero."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return vectors.filter(F.col("embedding").isNotNull()).filter((F.size("embedding") > 0) & finite & F.exists(c, lambda v: v != 0))


def _unit(rows) -> np.ndarray:
    m = np.stack(rows).astype(float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def nearest(chunks: DataFrame, query: list[float], n: int | None = 20, where=None, over_fetch: int = 6, basis_weight: float = 0.92) -> DataFrame:
    """(id, score, is_basis): the best chunk of each of the ``n`` best nodes of chunks (id, embedding, is_basis).

    Chunks are over-fetched, so that nodes of many chunks don't crowd others out; basis rows are ordered by a lowered score."""
    n = V.clamp(n, 1, 50, 20)
    rows = chunks.filter(where) if where is not None else chunks
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = rows.select("id", "is_basis", V.cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(n * over_fetch)
    best = hits.groupBy("id").agg(F.max("score").cast("float").alias("score"), F.bool_or("is_basis").alias("is_basis"))
    weight = F.when(F.col("is_basis"), F.col("score") * basis_weight).otherwise(F.col("score"))
    return best.orderBy(F.desc(weight), "id").limit(n)


def neighbours(vectors: DataFrame, k: int = 5, blocks: int | None = None, family: str | None = None) -> DataFrame:
    """(id, neighbor_id, score, rank): the ``k`` nearest others of every vector by cosine, exactly; ``family`` is a column
    whose equal values exclude each other (siblings); a null family excludes nobody.

    Vectors are dealt into blocks; each pair of blocks is one task's matrix product, which serves the rows of both and returns the best
    ``k`` for each row, and the best of those are ranked. No pair of rows is ever a row. Blocks hold about
    ``BLOCK_ROWS`` rows whatever the input's size, so they bound a task's memory. Scores are rounded to 12 digits, as equal vectors
    can differ in the last bit of a product; equal scores go to the smaller id, in a block and over all."""
    k = V.clamp(k, 1, 20, 5)
    rows = usable(vectors)
    blocks = blocks or max(1, -(-rows.count() // BLOCK_ROWS))
    family_of = F.col(family).cast("string") if family else F.lit(None).cast("string")
    rows = rows.select("id", "embedding", family_of.alias("family"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    pairs = rows.select("*", every.alias("other"), F.size("embedding").alias("d"))
    pairs = pairs.select("id", "embedding", "family", "block", "d", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def best(pair: pd.DataFrame) -> pd.DataFrame:
        x, y = pair.x.iloc[0], pair.y.iloc[0]
        pair = pair.sort_values("id")  # a stable sort by score then leaves equal scores in order of id
        one, two = pair[pair.block == x], pair[pair.block == y]
        out = list(_best_of(one, two, k, bool(family)))
        return pd.concat([*out, *(_best_of(two, one, k, bool(family)) if x != y else [])])

    found = pairs.groupBy("x", "y", "d").applyInPandas(best, "id string, neighbor_id string, score double")
    order = W.partitionBy("id").orderBy(F.desc("score"), "neighbor_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("id", "neighbor_id", F.col("score").cast("float").alias("score"), "rank")


def _best_of(mine: pd.DataFrame, other: pd.DataFrame, k: int, families: bool) -> Iterator[pd.DataFrame]:
    """For each row of ``mine`` its ``k`` nearest of ``other`` (sorted by id)."""
    yield pd.DataFrame({"id": pd.Series([], dtype=str), "neighbor_id": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})
    if mine.empty or other.empty:
        return
    every, names = _unit(other.embedding.to_numpy()).T, other.id.to_numpy()
    # numbers are compared in place of strings: a pair of blocks has 16 million of them
    ids, kin = pd.factorize(np.r_[mine.id.to_numpy(), names])[0], pd.factorize(np.r_[mine.family.to_numpy(), other.family.to_numpy()])[0]
    n, units = len(mine), _unit(mine.embedding.to_numpy())
    for at, row, column, score in _best_at(units, ids[:n], kin[:n], every, ids[n:], kin[n:], k, families):
        yield pd.DataFrame({"id": mine.id.to_numpy()[at + row], "neighbor_id": names[column], "score": score})


def _best_at(units: np.ndarray, ids: np.ndarray, kin: np.ndarray, every: np.ndarray, other_ids: np.ndarray, other_kin: np.ndarray, k: int, families: bool) -> Iterator[tuple]:
    """(first row, rows from there, columns, scores) of the ``k`` nearest columns of ``every`` for each row of ``units``."""
    for i in range(0, len(units), PART_ROWS):
        at = slice(i, i + PART_ROWS)
        s = units[at] @ every
        s[ids[at][:, None] == other_ids[None, :]] = -np.inf
        if families:
            own = kin[at]
            s[(own[:, None] == other_kin[None, :]) & (own >= 0)[:, None]] = -np.inf
        least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        row, column = np.nonzero(s >= least[:, None] - 1e-11)  # what can be among the k best once scores are rounded
        score = np.round(s[row, column], 12)
        row, column, score = _first(row, column, score, k)
        real = np.isfinite(score)
        yield i, row[real], column[real], score[real]


def _first(row: np.ndarray, column: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row by score and column."""
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    if not len(row):
        return row, column, score
    first = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return row[place < k], column[place < k], score[place < k]


# --- inverted lists ------------------------------------------------------------------------------------------------


def _nearest_lists(units: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest lists of each row, nearest first."""
    s = units @ centres.T
    n = min(n, len(centres))
    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def _centres(units: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = units[rng.choice(len(units), lists, replace=False)]
    for _ in range(rounds):
        of = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], units[rng.choice(len(units), lists)])
    return centres


@dataclass
class VectorIndex:
    """Inverted lists of unit vectors: centres, the number of lists that a search reads (narrow, wide), and the folder of the lists.

    Every row is stored in its ``copies`` nearest lists, so that vectors at a border between lists are found from both sides. The files
    are laid out by list, and a search reads those of its lists only."""

    path: str
    centres: np.ndarray
    narrow: int
    wide: int
    k: int
    sample_recall: float
    shelf: np.ndarray  # of each list

    @classmethod
    def fit(cls, vectors: DataFrame, k: int = 5, lists: int | None = None, copies: int = 2, recall: float = 0.95, family: str | None = None, seed: int = 1) -> VectorIndex:
        """Centres come from at most ``FIT_ROWS`` rows (those with the least id hashes); every row is indexed. On these rows the smallest
        number of lists is taken whose search reaches ``recall`` against all of them."""
        rows = usable(vectors)
        n = rows.count()
        if not n:
            raise ValueError("an index needs at least one usable vector")
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("embedding", (F.col(family).cast("string") if family else F.lit(None).cast("string")).alias("family")).toPandas()
        d = picked.embedding.map(len).mode().max()
        picked = picked[picked.embedding.map(len) == d]
        units = np.unique(np.round(_unit(picked.embedding.to_numpy()), 12), axis=0)
        lists = min(lists or max(1, round(n**0.5)), MOST_LISTS, len(units))
        centres = _centres(units, lists, seed)
        reach, got = cls._reach(_unit(picked.embedding.to_numpy()), picked.family.to_numpy(), centres, k, copies, recall)
        path = new_path(rows.sparkSession, "vector-index")
        cls._stored(rows, centres, copies, family, int(d)).repartition("list").write.partitionBy("list").parquet(path)
        shelf = (centres @ _centres(centres, min(SHELVES, lists), seed).T).argmax(1)
        return cls(path, centres, reach, min(lists, 4 * reach), k, got, shelf)

    @staticmethod
    def _reach(units: np.ndarray, kin: np.ndarray, centres: np.ndarray, k: int, copies: int, recall: float) -> tuple[int, float]:
        """(lists to read, recall on the sample): doubling, then halving the step."""
        step = max(1, len(units) // FIT_QUESTIONS)
        asked = np.arange(0, len(units), step)
        s = np.round(units[asked] @ units.T, 12)
        s[np.arange(len(asked)), asked] = -np.inf
        s[(kin[asked][:, None] == kin[None, :]) & pd.notna(kin[asked])[:, None]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        real = np.isfinite(np.take_along_axis(s, top, 1))
        homes, ways = _nearest_lists(units, centres, copies), _nearest_lists(units[asked], centres, len(centres))
        place = np.empty_like(ways)
        np.put_along_axis(place, ways, np.arange(len(centres))[None, :].repeat(len(asked), 0), 1)
        first = np.take_along_axis(place, homes[top].reshape(len(asked), -1), 1).reshape(len(asked), top.shape[1], -1).min(2)  # when a true neighbour is met
        met = np.sort(first[real])
        if not len(met):
            return len(centres), 1.0
        need = int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]) + 1
        return need, float((met < need).mean())

    @staticmethod
    def _stored(rows: DataFrame, centres: np.ndarray, copies: int, family: str | None, d: int) -> DataFrame:
        """(id, family, unit, list, home): a row for each list that holds a vector."""
        rows = rows.filter(F.size("embedding") == d).select("id", (F.col(family).cast("string") if family else F.lit(None).cast("string")).alias("family"), F.col("embedding").cast("array<double>").alias("embedding"))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                units = _unit(list(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)))
                of = _nearest_lists(units, centres, copies)
                r = np.repeat(np.arange(batch.num_rows), of.shape[1])
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * units.shape[1]), pa.array(units[r].ravel()))
                columns = [batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), unit, pa.array(of.ravel().astype(np.int32)), pa.array(np.tile(np.arange(of.shape[1]) == 0, batch.num_rows))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "family", "unit", "list", "home"])

        return rows.mapInArrow(deal, "id string, family string, unit array<double>, list int, home boolean")

    def members(self, spark) -> DataFrame:
        return spark.read.schema("id string, family string, unit array<double>, home boolean, list int").parquet(self.path)

    def nearest(self, spark, query: list[float], n: int = 20, lists: int | None = None) -> DataFrame:
        """(id, score): the ``n`` best rows of the lists nearest to a vector; only these lists' files are read."""
        unit = _unit([query])
        near = _nearest_lists(unit, self.centres, lists or self.narrow)[0].tolist()
        q = F.array(*[F.lit(float(x)) for x in unit[0]])
        score = F.round(F.aggregate(F.zip_with("unit", q, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y), 12)
        found = self.members(spark).filter(F.col("list").isin(near)).select("id", score.alias("score")).distinct()
        return found.orderBy(F.desc("score"), "id").limit(n).select("id", F.col("score").cast("float").alias("score"))

    def _probed(self, spark, anchors: DataFrame, low: int, high: int, k: int) -> DataFrame:
        """(id, neighbor_id, score) of anchors (id, family, unit) in their lists number ``low`` to ``high``; a neighbour that several shelves hold
        comes several times.

        A row is sent to each shelf that has lists of its, with their numbers, and not to each list: the lists that it reads grow with the
        table, the shelves don't."""
        centres, shelf = self.centres, self.shelf

        def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                of = _nearest_lists(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1), centres, high)[:, low:]
                both = np.sort(shelf[of] * MOST_LISTS + of, axis=1)
                on, of = both // MOST_LISTS, both % MOST_LISTS
                begins = np.flatnonzero(np.diff(on, axis=1, prepend=-1))
                row = pa.array(begins // of.shape[1])
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, of.size).astype(np.int32)), pa.array(of.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns), pa.array(on.ravel()[begins].astype(np.int32)), lists], names=["id", "family", "embedding", "shelf", "lists"])

        kinds = "id string, family string, embedding array<double>, shelf int, lists array<int>"
        asked = anchors.select("id", "family", "unit").mapInArrow(ways, kinds)
        shelves = spark.createDataFrame([(i, int(x)) for i, x in enumerate(shelf)], "list int, shelf int")  # at most MOST_LISTS rows
        held = self.members(spark).join(F.broadcast(shelves), "list")
        # both sides are cut, so that a task compares at most SHELF_ROWS rows with as many
        asks = max(1, -(-anchors.count() // SHELF_ROWS))
        sizes = F.broadcast(staged(held.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / SHELF_ROWS).cast("int").alias("holds")), "shelf-sizes"))
        part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = asked.join(sizes, "shelf").select("id", "family", "embedding", "shelf", "lists", part(F.lit(asks)).alias("x"), every(F.col("holds")).alias("y"), F.lit(True).alias("asking"))
        right = held.join(sizes, "shelf").select("id", "family", F.col("unit").alias("embedding"), "shelf", F.array("list").alias("lists"), every(F.lit(asks)).alias("x"), part(F.col("holds")).alias("y"), F.lit(False).alias("asking"))

        def best(rows: pd.DataFrame) -> pd.DataFrame:
            return _best_on_shelf(rows.sort_values("id"), k)

        return left.unionByName(right).groupBy("shelf", "x", "y").applyInPandas(best, "id string, neighbor_id string, score double")

    def neighbours(self, spark, k: int | None = None) -> DataFrame:
        """(id, neighbor_id, score, rank): about the ``k`` nearest others of every indexed row. Rows that find fewer in their narrow lists
        (siblings are left out) go on to their wide ones."""
        k = V.clamp(k or self.k, 1, 20, 5)
        order = W.partitionBy("id").orderBy(F.desc("score"), "neighbor_id")

        def ranked(found: DataFrame) -> DataFrame:
            once = found.repartition("id").groupBy("id", "neighbor_id").agg(F.max("score").alias("score"))  # one shuffle for both
            return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        anchors = self.members(spark).filter("home").select("id", "family", "unit")
        found = staged(ranked(self._probed(spark, anchors, 0, self.narrow, k)), "narrow")
        if self.wide > self.narrow:
            enough = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            few = staged(anchors.join(enough.select("id"), "id", "left_anti"), "few")
            if not few.isEmpty():
                found = ranked(found.drop("rank").unionByName(self._probed(spark, few, self.narrow, self.wide, k)))
        return found.select("id", "neighbor_id", F.col("score").cast("float").alias("score"), "rank")


def _best_on_shelf(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest held rows of each asking one (rows sorted by id), over the lists that it asks in."""
    ids, kin, asking = pd.factorize(rows.id)[0], pd.factorize(rows.family)[0], rows.asking.to_numpy(bool)
    units = _unit(rows.embedding.to_numpy())
    row = np.repeat(np.arange(len(rows)), rows.lists.map(len).to_numpy())
    of = np.concatenate(rows.lists.to_numpy())
    order = np.argsort(of, kind="stable")  # rows of a list stay in order of id
    of, row = of[order], row[order]
    found = [(np.array([], np.int64), np.array([], np.int64), np.array([], float))]
    for x, y in zip(np.r_[0, np.flatnonzero(np.diff(of)) + 1], np.r_[np.flatnonzero(np.diff(of)) + 1, len(of)]):
        mine, other = row[x:y][asking[row[x:y]]], row[x:y][~asking[row[x:y]]]
        if len(mine) and len(other):
            found += [(mine[i + a], other[b], score) for i, a, b, score in _best_at(units[mine], ids[mine], kin[mine], units[other].T, ids[other], kin[other], k, True)]
    a, b, score = (np.concatenate(x) for x in zip(*found))
    b = ids[b]  # a row is held in some lists of a shelf: once is enough
    order = np.lexsort((-score, b, a))
    a, b, score = a[order], b[order], score[order]
    once = np.ones(len(a), bool)
    once[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
    a, b, score = _first(a[once], b[once], score[once], k)  # numbers of ids rise as ids do
    names = rows.id.to_numpy()
    return pd.DataFrame({"id": names[a], "neighbor_id": names[np.searchsorted(ids, b)], "score": score})


def rebuilt(old: DataFrame, new: DataFrame, anchors: DataFrame) -> DataFrame:
    """The neighbour table with the anchors' rows replaced."""
    return old.join(anchors.select("id"), "id", "left_anti").unionByName(new)


def other_document_first(items: DataFrame, margin: float = 0.03) -> DataFrame:
    """Adds position: a neighbour from another document within ``margin`` of the best comes first (anchor, reg_key, neighbor_reg_key, score, rank)."""
    top = F.max("score").over(W.partitionBy("id"))
    cross = (F.col("reg_key") != F.col("neighbor_reg_key")) & (F.col("score") >= top - margin)
    lead = F.row_number().over(W.partitionBy("id", cross).orderBy("rank")) == 1
    order = W.partitionBy("id").orderBy(F.when(cross & lead, 0).otherwise(1), "rank")
    return items.withColumn("position", F.row_number().over(order))


def batched(rows: Iterator, most_rows: int, most_chars: int) -> Iterator[list]:
    """Batches of at most so many texts and characters."""
    batch, size = [], 0
    for r in rows:
        if batch and (len(batch) >= most_rows or size + len(r) > most_chars):
            yield batch
            batch, size = [], 0
        batch.append(r)
        size += len(r)
    if batch:
        yield batch
