"""Whitening of embeddings by a matrix-free block Lanczos solver.

An entry c becomes the integer floor(64 c) + 1,000,000. Of these vectors only sums are ever gathered; the covariance V isn't formed.

1. One pass counts rows and sums each dimension (exact integers).
2. Block Lanczos: a pass over the rows multiplies the centred vectors with a block of ``BLOCK`` directions, X'(X B) / n, in partial
   sums that a shuffle adds up; the driver holds dimension x directions. The product is orthogonalised against all
   earlier directions twice (full reorthogonalisation); directions that vanish are a breakdown, after which random
   ones, orthogonal to all others, start again.
3. The small projected matrix gives Ritz pairs; the solver ends when the residual of every wanted pair is below ``TOLERANCE`` times
   the greatest eigenvalue, or when the directions span the whole space.
4. A pass projects the rows and scales by 1/sqrt(e). The trace of V is the sum of the exact deviations over n cubed, so the share
   that a component explains needs no other eigenvalue. A last pass takes the covariance of what is returned.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are empty vectors and those of another
length than most rows have (ties: the longer). Components of eigenvalue zero (below 1e-12 of the greatest) have no unit
variance and are left out: equal vectors alone give no rows, and neither do empty tables. Repeated rows count as often as
they occur; a null vec_id stays; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged, trimmed

COMPONENTS = 32
BLOCK = 16
SCALE, SHIFT = 64, 1_000_000
TOLERANCE = 1e-13
#: Entries greater than this in size don't fit the integers and count as not finite.
MOST = 1e12
#: Rows that a task turns into a matrix at once.
PART_ROWS = 4096


@dataclass
class Spectrum:
    """n rows, exact sums of each dimension, eigenvalues (falling) and unit eigenvectors as columns, passes over the rows."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): integer vectors of the rows that remain, written to the shared folder."""
    c = F.col(vector_col).cast("array<double>")
    good = F.forall("c", lambda v: F.coalesce(F.abs(v) <= MOST, F.lit(False)))  # NaN is greater than any number in Spark
    kept = rows.select(F.col(id_col).alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0)).filter(good)
    x = F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    every = staged(kept.select("vec_id", x.alias("x")), "integer-vectors")
    lengths = every.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    return every if len(lengths) < 2 else every.filter(F.size("x") == lengths[0]["d"])


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as an integer matrix."""
    for whole in batches:
        for i in range(0, whole.num_rows, PART_ROWS):
            batch = whole.slice(i, PART_ROWS)
            yield batch, batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, partial, shape: tuple[int, ...], kind: str = "double") -> np.ndarray:
    """The sum over all tasks of ``partial(batches)``, an array of a fixed shape: a row for each cell and task is shuffled."""

    @trimmed
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "v"])

    added = rows.mapInArrow(cells, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(int(np.prod(shape)), np.int64 if kind == "bigint" else float)
    for cell, v in added.collect():  # as many as the shape has cells
        out[cell] = v
    return out.reshape(shape)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from the exact difference where it fits 64 bits."""
    return (n * x - sums) / n if n < 1 << 41 else (x - sums // n) - (sums % n) / n


def products(x: DataFrame, n: int, sums: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """V times ``directions``, by one pass over the rows."""

    def partial(batches):
        total = None
        for _, m in _matrices(batches, 0):
            c = _centred(m, n, sums)
            part = c.T @ (c @ directions)
            total = part if total is None else total + part
        return total

    return _summed(x.select("x"), partial, directions.shape) / n


def _against(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``block`` without its parts along ``basis``; twice, as once leaves rounding errors."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _orthonormal(basis: np.ndarray, block: np.ndarray, scale: float, rng: np.random.Generator, most: int) -> np.ndarray:
    """At most ``most`` unit directions of ``block`` orthogonal to ``basis`` and to each other; vanishing ones (breakdown) are replaced by random ones."""
    out = np.empty((block.shape[0], 0))
    for v in _against(basis, block).T[:most]:
        for _ in range(8):
            v = _against(np.hstack([basis, out]), v[:, None])[:, 0]
            size = np.linalg.norm(v)
            if size > 1e-10 * scale:
                v = _against(np.hstack([basis, out]), (v / size)[:, None])[:, 0]
                out = np.hstack([out, (v / np.linalg.norm(v))[:, None]])
                break
            v, scale = rng.standard_normal(block.shape[0]), 1.0
    return out


def fit(x: DataFrame, components: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 13) -> Spectrum | None:
    """The leading eigenpairs of the covariance of ``x`` (column x); None for an empty table."""
    first = x.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]

    def partial(batches):
        total = np.zeros(d + 1, np.int64)
        for _, m in _matrices(batches, 0):
            total += np.r_[m.sum(0), len(m)]
        return total

    summed = _summed(x.select("x"), partial, (d + 1,), "bigint")
    sums, n = summed[:d], int(summed[d])
    rng, wanted = np.random.default_rng(seed), min(components, d)
    basis, images, passes = np.empty((d, 0)), np.empty((d, 0)), 0
    new = _orthonormal(basis, rng.standard_normal((d, min(block, d))), 1.0, rng, d)
    while True:
        image = products(x, n, sums, new)
        passes += 1
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        k = min(wanted, len(values))
        vectors = basis @ turn[:, :k]
        residual = np.linalg.norm(images @ turn[:, :k] - vectors * values[:k], axis=0)
        top = max(values[0], 0.0)
        if basis.shape[1] == d or (k == wanted and (residual <= tolerance * max(top, 1e-300)).all()):
            break
        new = _orthonormal(basis, image, max(top, 1e-300), rng, d - basis.shape[1])
    good = values[:k] > 1e-12 * max(top, 1e-300)
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return Spectrum(n, sums, values[:k][good], vectors[:, good], passes)


def projected(x: DataFrame, of: Spectrum) -> DataFrame:
    """(vec_id, deviation, w): exact squared deviations and whitened coordinates."""
    n, sums, turn = of.n, of.sums, of.vectors / np.sqrt(of.values)
    kind = x.schema["vec_id"].dataType.simpleString()

    @trimmed
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, m in _matrices(batches, 1):
            w = _centred(m, n, sums) @ turn
            deviation = ((n * m - sums) ** 2).sum(1)  # exact while it fits 64 bits, which the result's type asks for
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation), lists], names=["vec_id", "deviation", "w"])

    return x.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows (column w) minus the identity."""

    def partial(batches):
        total = np.zeros((k + 1, k))
        for _, w in _matrices(batches, 0):
            total += np.vstack([w.T @ w, w.sum(0)])
        return total

    total = _summed(rows.select("w"), partial, (k + 1, k)) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component: id, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    x = integer_vectors(rows, id_col, vector_col)
    of = fit(x, components)
    if of is None or not len(of.values):
        kind = x.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double")
    white = staged(projected(x, of), "whitened")
    total = white.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("s")).first()["s"]
    trace = float(total) / of.n**3
    error = identity_error(white, of.n, len(of.values))
    explained = F.array(*[F.lit(float(e / trace)) for e in of.values])  # COMPONENTS numbers at most
    values = F.array(*[F.lit(float(e)) for e in of.values])
    long = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        F.col("vec_id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(of.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"), F.element_at(values, F.col("at") + 1).alias("eigenvalue"),
    )
