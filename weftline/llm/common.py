"""What the operators of this folder share: the shared folder, staged tables, table reading."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import new_path, shared_dir, staged

__all__ = ["BATCH_ROWS", "WORD_GAPS", "ascii_lower", "bounded", "new_path", "shared_dir", "staged", "table", "text_of", "trimmed", "tune", "words_of"]

#: Rows in one Arrow batch. Texts can be long, so a batch of the default 10,000 rows could be gigabytes.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the memory of the Arrow exchange with Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def trimmed(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """For functions over the batches of a task: when the task is over, its free memory goes back to the system, so that idle
    workers stay small."""

    @wraps(run)
    def over(*batches: Iterator) -> Iterator:
        try:
            yield from run(*batches)
        finally:
            pa.default_memory_pool().release_unused()
            give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if give_back:
                give_back(0)

    return over


def bounded(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than it must to know."""
    return df.limit(rows + 1).count() <= rows


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_GAPS = "[ \\t\\n\\x0B\\f\\r]+"


def words_of(c: Column) -> Column:
    """Words of a text as an array; an empty array if there is none."""
    inner = F.trim(c, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAPS))
