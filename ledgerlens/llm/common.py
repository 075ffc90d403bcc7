"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column over all rows; one number comes back."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0]


def parts_for(size: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(size / per_part))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no piece holds more than `limit` bytes of a column, long rows apart.

    Cutting bounds what vectorised code allocates; every row is in exactly one piece.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their tasks, so what one task needed would else stay with the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable) -> Callable:
    """A function of one group, or of two that belong together, that gives memory back when it is done."""

    def one(held: pa.Table) -> pa.Table:
        try:
            return work(held)
        finally:
            give_back()

    def two(held: pa.Table, found: pa.Table) -> pa.Table:
        try:
            return work(held, found)
        finally:
            give_back()

    return one if work.__code__.co_argcount == 1 else two


def lean_stream(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same for a function over a partition's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run
