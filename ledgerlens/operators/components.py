"""Connected components of an edge table by alternating star contractions.

The two steps follow Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014): every node hands its larger neighbours to its smallest
neighbour, then its smaller ones, until each component is a star around its
smallest member. Only nodes with an edge take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.skew import HOT_ROWS, join_key_stats
from ledgerlens.session import discard, materialize, row_count


def _join(rows: DataFrame, stats: DataFrame, edges: int, hot_rows: int) -> DataFrame:
    """A node cannot be hot in an edge table that is shorter than the limit."""
    if 2 * edges <= hot_rows:
        return rows.join(stats, "node")
    return join_key_stats(rows, stats, ["node"], "degree", hot_rows)


def _large_star(edges: DataFrame, count: int, hot_rows: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    smallest = (
        both.groupBy(F.col("high").alias("node"))
        .agg(F.min("low").alias("nearest"), F.count("*").alias("degree"))
        .select("node", "degree", F.least("nearest", "node").alias("root"))
    )
    outward = edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
    return _join(outward, smallest, count, hot_rows).select(F.col("other").alias("high"), F.col("root").alias("low"))


def _small_star(edges: DataFrame, count: int, hot_rows: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy(F.col("high").alias("node")).agg(
        F.min("low").alias("root"), F.count("*").alias("degree")
    )
    inward = edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
    moved = _join(inward, smallest, count, hot_rows).select(F.col("other").alias("high"), F.col("root").alias("low"))
    own = smallest.select(F.col("node").alias("high"), F.col("root").alias("low"))
    return moved.unionByName(own)


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("high") > F.col("low")).distinct()


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """(all components are stars, edges at the busiest centre)."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    tangled = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    wrong, widest = nodes.agg(F.count_if(tangled), F.coalesce(F.max("down"), F.lit(0))).first()
    return wrong == 0, widest


def connected_components(
    edges: DataFrame, hot_rows: int = HOT_ROWS, max_rounds: int = 60
) -> tuple[DataFrame, int]:
    """(a, b) long pairs -> ((node, component), size of the largest component).

    component is the smallest member. Each round is written to the shared folder and
    the one before is dropped, so lineage stays one round long and a lost executor
    costs at most one round.
    """
    pairs = edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    current = materialize(_tidy(pairs), "edges")
    rounds = 0
    star, widest = _shape(current)
    while not star:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        count = row_count(current)
        wide = _tidy(_large_star(current, count, hot_rows))
        if 2 * count > hot_rows:
            wide = materialize(wide, "large-star")
        # small-star never adds edges, so `count` still bounds the degrees here
        following = materialize(_tidy(_small_star(wide, count, hot_rows)), "small-star")
        discard(wide)
        discard(current)
        current = following
        star, widest = _shape(current)
    members = current.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return members.unionByName(roots), widest + 1
