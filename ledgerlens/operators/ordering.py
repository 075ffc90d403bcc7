"""Global positions and exact order statistics without a one-task sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.values import ref
from ledgerlens.session import materialize


def number_rows(df: DataFrame, name: str = "_row_num", start: int = 1) -> DataFrame:
    """Consecutive numbers in the order the rows are read.

    The frame is written once with a (partition, offset) pair; the sizes of the
    partitions before each one then turn offsets into consecutive numbers.
    """
    tagged = df.withColumn("__at", F.monotonically_increasing_id())
    stored = materialize(
        tagged.select(
            "*",
            F.shiftright("__at", 33).cast("int").alias("__part"),
            F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__offset"),
        ).drop("__at"),
        "numbered",
    )
    sizes = stored.groupBy("__part").agg(F.count("*").alias("size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one line per partition
    starts = sizes.select("__part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    numbered = stored.join(F.broadcast(starts), "__part")
    position = (F.col("__before") + F.col("__offset") + start).cast("long")
    return numbered.select(position.alias(name), *[ref(c) for c in df.columns])


class OrderedValues:
    """Several numeric columns counted by value and range-partitioned, ready for rank lookups.

    Values are counted first, the (column, value) pairs are range-partitioned, and a
    lookup scans only the partitions that hold a wanted rank with a running sum.
    """

    def __init__(self, df: DataFrame, columns: list[str]):
        pairs = F.array(
            *[F.struct(F.lit(c).alias("name"), ref(c).cast("double").alias("value")) for c in columns]
        )
        counts = (
            df.select(F.inline(pairs))
            .filter(F.col("value").isNotNull())
            .groupBy("name", "value")
            .agg(F.count("*").alias("n"))
        )
        self.table = materialize(
            counts.repartitionByRange("name", "value").withColumn("part", F.spark_partition_id()), "ordered"
        )
        self.spread: dict[str, list] = {c: [] for c in columns}
        # one line per column and partition
        for row in self.table.groupBy("name", "part").agg(F.sum("n").alias("n")).orderBy("name", "part").collect():
            self.spread[row["name"]].append((row["part"], row["n"]))

    def count(self, column: str) -> int:
        return sum(n for _, n in self.spread[column])

    def at(self, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
        """Values at 0-based ascending ranks, as {(column, rank): value}."""
        targets = []
        for name, rank in dict.fromkeys(wanted):
            ends = list(accumulate(n for _, n in self.spread[name]))
            spot = next(i for i, end in enumerate(ends) if rank < end)
            targets.append((name, self.spread[name][spot][0], rank, rank - (ends[spot - 1] if spot else 0)))
        if not targets:
            return {}
        ranks = self.table.sparkSession.createDataFrame(targets, "name string, part int, rank long, local long")
        held = ranks.select("name", "part").distinct()
        running = Window.partitionBy("name", "part").orderBy("value")
        located = (
            self.table.join(F.broadcast(held), ["name", "part"], "left_semi")
            .withColumn("upto", F.sum("n").over(running))
            .join(F.broadcast(ranks), ["name", "part"])
            .filter((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n")))
        )
        return {(r["name"], r["rank"]): r["value"] for r in located.select("name", "rank", "value").collect()}


def order_statistics(df: DataFrame, columns: list[str], quantiles: dict[str, float], method: str) -> dict:
    """Exact quantiles of several numeric columns, {column: {label: value or None}}.

    `method` is "nearest" (the value at the rounded rank) or "linear" (interpolated
    between neighbours).
    """
    ordered = OrderedValues(df, columns)
    plan: dict[tuple[str, str], list[tuple[int, float]]] = {}
    for name in columns:
        last = ordered.count(name) - 1
        if last < 0:
            continue
        for label, q in quantiles.items():
            at = q * last
            low = int(at + 0.5) if method == "nearest" else int(at)
            part = 0.0 if method == "nearest" else at - low
            plan[name, label] = [(low, 1.0 - part)] + ([(low + 1, part)] if part else [])
    values = ordered.at([(name, rank) for (name, _), ranks in plan.items() for rank, _ in ranks])
    result: dict = {c: {label: None for label in quantiles} for c in columns}
    for (name, label), ranks in plan.items():
        result[name][label] = sum(values[name, rank] * weight for rank, weight in ranks)
    return result


def top_k(df: DataFrame, column: str, k: int, tiebreak: str, sort_limit: int = 100_000) -> DataFrame:
    """The k rows with the largest values of a double column, ties by the smaller tiebreak.

    A small k is one ordered limit. A large one, which may be a share of the table, is
    cut at the exact k-th value instead, so no task has to hold k rows.
    """
    if k <= sort_limit:
        return df.orderBy(F.desc(column), tiebreak).limit(max(k, 0))
    ordered = OrderedValues(df, [column])
    rows = ordered.count(column)
    if k >= rows:
        return df.filter(ref(column).isNotNull())
    rank = rows - k
    cut = ordered.at([(column, rank)])[column, rank]
    above = df.filter(ref(column) > cut)
    missing = k - above.count()
    return above.unionByName(df.filter(ref(column) == cut).orderBy(tiebreak).limit(missing))
