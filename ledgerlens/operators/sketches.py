"""Quantiles from mergeable sketches, within a stated error of rank.

A KLL sketch (Karnin, Lang and Liberty, 2016) holds a few thousand values whatever the number of rows, and sketches of parts of a table
merge into one of the whole. Kept as a table, one line per part and measure, they answer for any choice of parts, and a new part
is sketched without a look at the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.values import ref

# The published fit of the error of rank, at 99 % confidence, to a sketch's parameter k, and the range of k.
ERROR_FACTOR, ERROR_POWER = 2.296, 0.9021
LEAST_K, MOST_K = 8, 65_535


def sketch_size(rank_error: float) -> int:
    """The smallest k whose sketches are within rank_error."""
    if not 0 < rank_error < 1:
        raise ValueError("rank_error must lie between 0 and 1")
    k = max(LEAST_K, math.ceil((ERROR_FACTOR / rank_error) ** (1 / ERROR_POWER)))
    if k > MOST_K:
        raise ValueError(f"rank_error {rank_error} is below what a sketch can reach; use exact quantiles")
    return k


def quantile_sketches(df: DataFrame, columns: list[str], rank_error: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, measure, values, sketch) of numeric columns, one line per part of the table and measure that has values."""
    stacked = F.array(*[F.struct(F.lit(c).alias("measure"), ref(c).cast("double").alias("value")) for c in columns])
    pairs = df.select(*[ref(b) for b in by], F.inline(stacked)).filter("value IS NOT NULL")
    sketch = F.kll_sketch_agg_double("value", F.lit(sketch_size(rank_error)))
    return pairs.groupBy(*[ref(b) for b in by], "measure").agg(F.count("*").alias("values"), sketch.alias("sketch"))


def merged_sketches(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sketches of fewer, larger parts: those that share `by`, or all."""
    return sketches.groupBy(*[ref(b) for b in by], "measure").agg(
        F.sum("values").alias("values"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: str, q: float) -> Column:
    """The value whose rank is near the share q of the values."""
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(q)))


def approximate_quantiles(df: DataFrame, columns: list[str], quantiles: dict[str, float], rank_error: float) -> dict:
    """{column: {label: value or None}} from one sketch per column."""
    result: dict = {c: {label: None for label in quantiles} for c in columns}
    found = quantile_sketches(df, columns, rank_error).select("measure", *[quantile("sketch", q).alias(label) for label, q in quantiles.items()])
    for row in found.collect():  # one line per column
        result[row["measure"]] = {label: row[label] for label in quantiles}
    return result
