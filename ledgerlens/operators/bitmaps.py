"""Exact distinct counts that merge: bitmaps over the numbers that a dictionary gives to values.

A distinct count cannot be added up over months, but the bitmaps behind it can be united. Every value gets one number for good; a part of the table (a
month, say) is summed up once as bitmaps of the numbers that occur in each group, and counts over any parts come from the bitmaps
alone. A new part adds its new values to the dictionary and its own bitmaps, without a look at the rows of the others. A bitmap covers 32,768
numbers, so a large group is spread over many lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.values import ref
from ledgerlens.operators.ordering import number_rows
from ledgerlens.session import materialize

NULL_NUMBER = 1  # NULL is a value like any other; the numbers of the others follow


class DistinctCounts:
    """The bitmaps of one column by some group keys, added part by part."""

    def __init__(self, column: str, by: tuple[str, ...]):
        self.column, self.by = column, by
        self.dictionaries: list[DataFrame] = []  # (value, number); a value is in one of them
        self.parts: list[DataFrame] = []  # (by…, bucket, bits)
        self.largest = NULL_NUMBER

    def _numbers(self) -> DataFrame:
        merged = self.dictionaries[0]
        for more in self.dictionaries[1:]:
            merged = merged.unionByName(more)
        return merged

    def add(self, rows: DataFrame) -> None:
        """Add a part: numbers its new values, then sums its rows up as bitmaps."""
        own = rows.select(ref(self.column).alias("value")).filter("value IS NOT NULL").distinct()
        fresh = own.join(self._numbers(), "value", "left_anti") if self.dictionaries else own
        numbered = materialize(number_rows(fresh, "number", start=self.largest + 1), "dictionary")
        self.largest = numbered.agg(F.max("number")).first()[0] or self.largest
        self.dictionaries.append(numbered.select("value", "number"))
        held = rows.select(*[ref(b) for b in self.by], ref(self.column).alias("value")).distinct()
        known = held.join(self._numbers(), "value", "left").withColumn("number", F.coalesce("number", F.lit(NULL_NUMBER)))
        self.parts.append(materialize(
            known.groupBy(*[ref(b) for b in self.by], F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")), "bitmaps"))

    def counts(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """(by…, name): distinct values over some of the parts or all, NULL being one."""
        chosen = [self.parts[i] for i in (range(len(self.parts)) if parts is None else parts)]
        merged = chosen[0]
        for more in chosen[1:]:
            merged = merged.unionByName(more)
        united = merged.groupBy(*[ref(b) for b in self.by], "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return united.groupBy(*[ref(b) for b in self.by]).agg(F.sum(F.bitmap_count("bits")).alias(name))
