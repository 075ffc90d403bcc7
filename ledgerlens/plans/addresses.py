"""Near-equal addresses: the token sets behind the rows and the rows they flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.documents import address_tokens
from ledgerlens.functions.values import text
from ledgerlens.operators.near_sets import light_tokens, near_set_edges, near_set_range, signatures
from ledgerlens.operators.skew import HOT_ROWS, join_key_stats
from ledgerlens.session import materialize, row_count

THRESHOLD, MIN_SHARED, MIN_LENGTH = 0.85, 3, 4


def address_id(df: DataFrame) -> Column:
    """16 bytes that stand for the words of an address, NULL where there are none."""
    return F.unhex(F.md5(F.array_join(address_tokens(df), " ")))


class AddressBook:
    """The token sets behind the addresses of a table, written once for all uses.

    rows: (_row_num, cid, gid, tokens), rows with the same words sharing one gid;
    sets: one line per gid. heavy_rows=None counts every word of four or more letters
    as shared evidence; a number ignores words that occur in more rows than that.
    """

    def __init__(self, df: DataFrame, heavy_rows: int | None = None, hot_rows: int = HOT_ROWS):
        self.hot_rows = hot_rows
        words = df.select("_row_num", text(df, "customer_id").alias("cid"), address_tokens(df).alias("tokens"), address_id(df).alias("gid"))
        self.rows = materialize(words.filter(F.col("tokens").isNotNull()), "addresses")
        sets = self.rows.groupBy("gid").agg(
            F.any_value("tokens").alias("tokens"),
            F.count("*").alias("rows"),
            F.min("_row_num").alias("first"),
            F.min("cid").alias("low"),
            F.max("cid").alias("high"),
        )
        self.sets = materialize(light_tokens(sets, MIN_LENGTH, heavy_rows, hot_rows), "address-sets")
        self.signatures = materialize(signatures(self.sets, THRESHOLD, MIN_SHARED), "signatures")

    def edges(self, rows: DataFrame | None = None) -> DataFrame:
        """(a, b) row pairs that tie together all rows with equal or near-equal addresses.

        `rows` (_row_num, gid, ...) stands for the table where it is enough to tie these, as the first row of each profile.
        """
        rows = self.rows if rows is None else rows
        enough = (F.col("rows") > 1) & (F.size("light") >= MIN_SHARED)
        repeated = self.sets.filter(enough).select("gid", "rows", "first")
        size = row_count(rows)
        same = (
            join_key_stats(rows.select("_row_num", "gid"), repeated, ["gid"], "rows", self.hot_rows, size)
            .filter(F.col("_row_num") != F.col("first"))
            .select(F.col("_row_num").alias("a"), F.col("first").alias("b"))
        )
        near = near_set_edges(self.sets, self.signatures, THRESHOLD, MIN_SHARED, self.hot_rows)
        return same.unionByName(near)

    def duplicate_rows(self) -> DataFrame:
        """_row_num of every row whose address is near-equal to one of another customer."""
        around = near_set_range(self.sets, self.signatures, THRESHOLD, MIN_SHARED, self.hot_rows)
        # Only sets that see two different customers can flag anything.
        mixed = around.filter(F.col("low") != F.col("high")).join(self.sets.select("gid", "rows"), "gid")
        size = row_count(self.rows)
        rows = self.rows.select("_row_num", "gid")
        return join_key_stats(rows, mixed, ["gid"], "rows", self.hot_rows, size).select("_row_num")
