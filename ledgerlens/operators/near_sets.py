"""Near-equal token sets (Jaccard at or above a threshold) without listing pairs.

Two sets x and y with J(x, y) >= t have |x & y| >= t * |x|, so their common part z is
x with at most (1 - t) * |x| tokens deleted, and likewise for y. Every set therefore
emits its small-deletion subsets as signatures, and sets meet on equal signatures. On
a signature z the pair qualifies exactly when |x| + |y| <= |z| * (1 + t) / t, which
depends on the sizes alone: a bucket is summarised per size, never multiplied out, so
a bucket that holds a third of the table costs one aggregation like any other.

The number of signatures grows with the size of a set. Pairs with a set above `SHORT` tokens meet on parts instead
(PartEnum; Arasu, Ganti and Kaushik, 2006): tokens are dealt to H + 2 parts by hash, where H is how many tokens the pair may
differ by, so at least two parts are equal, and every pair of parts is a signature. A bucket's members are first compared with two pivots
only, which settles a bucket of near lines in linear work; pairs are listed only where that leaves something open.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.components import connected_components
from ledgerlens.operators.skew import HOT_ROWS, join_key_stats
from ledgerlens.session import materialize

SHORT = 19  # up to two deletions, at most 191 signatures of one line
EPS = 1e-9


def light_tokens(sets: DataFrame, min_length: int, heavy_rows: int | None, hot_rows: int) -> DataFrame:
    """Adds `light`: the tokens of at least min_length characters that count as shared evidence.

    With heavy_rows set, tokens found in more rows than that do not count.
    """
    long_tokens = F.filter("tokens", lambda t: F.length(t) >= min_length)
    if heavy_rows is None:
        return sets.withColumn("light", long_tokens)
    each = sets.select("gid", "rows", F.explode(long_tokens).alias("token"))
    usage = each.groupBy("token").agg(F.sum("rows").alias("token_rows"), F.count("*").alias("token_sets"))
    kept = (
        join_key_stats(each, usage, ["token"], "token_sets", hot_rows)
        .filter(F.col("token_rows") <= heavy_rows)
        .groupBy("gid")
        .agg(F.array_sort(F.collect_set("token")).alias("light"))  # bounded by the words of one line
    )
    return sets.join(kept, "gid")


def _subsets(deletions: int) -> Column:
    """All token arrays with exactly this many tokens removed (0 to 3)."""
    tokens = F.col("tokens")
    spots = F.sequence(F.lit(0), F.size(tokens) - 1)
    if deletions == 0:
        return F.array(tokens)
    if deletions == 1:
        return F.transform(spots, lambda i: F.filter(tokens, lambda _, k: k != i))
    if deletions == 2:
        return F.flatten(
            F.transform(
                spots,
                lambda i: F.transform(
                    F.filter(spots, lambda j: j > i), lambda j: F.filter(tokens, lambda _, k: (k != i) & (k != j))
                ),
            )
        )
    return F.flatten(F.transform(spots, lambda h: F.flatten(F.transform(
        F.filter(spots, lambda i: i > h),
        lambda i: F.transform(
            F.filter(spots, lambda j: j > i), lambda j: F.filter(tokens, lambda _, k: (k != h) & (k != i) & (k != j))
        ),
    ))))


def signatures(sets: DataFrame, threshold: float, min_shared: int) -> DataFrame:
    """(gid, first, low, high, size, extra, sig, sig_size) for sets of up to SHORT tokens; extra = tokens deleted."""
    short = sets.filter((F.size("tokens") <= SHORT) & (F.size("light") >= min_shared))
    budget = F.floor((1 - threshold) * F.size("tokens") + EPS)
    levels = []
    for d in range(int((1 - threshold) * SHORT + EPS) + 1):
        if d > 3:
            raise ValueError("threshold too low for deletion signatures")
        empty = F.array().cast("array<array<string>>")
        levels.append(F.when(budget >= d, _subsets(d)).otherwise(empty))
    emitted = short.select(
        "gid", "first", "low", "high", F.size("tokens").alias("size"), "light", F.explode(F.flatten(F.array(*levels))).alias("part")
    )
    return emitted.filter(F.size(F.array_intersect("part", "light")) >= min_shared).select(
        "gid",
        "first",
        "low",
        "high",
        "size",
        F.size("part").alias("sig_size"),
        (F.col("size") - F.size("part")).alias("extra"),
        F.unhex(F.md5(F.array_join("part", " "))).alias("sig"),
    )


def _fits(size: Column, other: Column, threshold: float) -> Column:
    """J >= threshold for two sets that share a signature of sig_size tokens."""
    union = size + other - F.col("sig_size")
    return F.col("sig_size") / union >= threshold


def part_signatures(sets: DataFrame, threshold: float, min_shared: int) -> DataFrame:
    """(gid, first, low, high, size, sig) of sets that can be in a pair with one above SHORT tokens, for pairs of equal parts."""
    reach = math.floor(SHORT * threshold)
    usable = sets.filter((F.size("tokens") > reach) & (F.size("light") >= min_shared))
    size = F.size("tokens")

    def parts(other: Column) -> Column:
        """Parts for a partner of that size: two more than the tokens that the pair may differ by."""
        return (F.floor((1 - threshold) / (1 + threshold) * (size + other) + EPS) + 2).cast("int")

    counts = F.sequence(parts(F.ceil(size * threshold - EPS)), parts(F.floor(size / threshold + EPS)))
    dealt = usable.select("gid", "first", "low", "high", size.alias("size"), "tokens", F.explode(counts).alias("m"))
    held = F.transform(
        F.sequence(F.lit(0), F.col("m") - 1),
        lambda i: F.xxhash64(F.array_join(F.filter("tokens", lambda t: F.pmod(F.xxhash64(t), F.col("m")) == i), " ")))
    dealt = dealt.withColumn("held", held)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("m") - 2), lambda i: F.transform(
        F.sequence(i + 1, F.col("m") - 1), lambda j: F.xxhash64(F.col("m"), i, j, F.get("held", i), F.get("held", j)))))
    return dealt.select("gid", "first", "low", "high", "size", F.explode(pairs).alias("sig"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, min_shared: int) -> DataFrame:
    """The (gid, other) pairs that qualify and hold a set above SHORT tokens."""
    one = sets.select("gid", "tokens", "light")
    two = sets.select(F.col("gid").alias("other"), F.col("tokens").alias("tokens2"), F.col("light").alias("light2"))
    shared = F.size(F.array_intersect("tokens", "tokens2"))
    return (
        pairs.join(one, "gid").join(two, "other")
        .filter(F.greatest(F.size("tokens"), F.size("tokens2")) > SHORT)
        .filter(shared / (F.size("tokens") + F.size("tokens2") - shared) >= threshold)
        .filter(F.size(F.array_intersect("light", "light2")) >= min_shared)
        .select("gid", "other")
    )


class LongSets:
    """Near pairs with a set above SHORT tokens, as far as edges or ranges need them."""

    def __init__(self, sets: DataFrame, threshold: float, min_shared: int, hot_rows: int):
        self.sets, self.threshold, self.min_shared, self.hot_rows = sets, threshold, min_shared, hot_rows
        marked = materialize(part_signatures(sets, threshold, min_shared), "part-signatures")
        pivots = (
            marked.groupBy("sig")
            .agg(F.count("*").alias("members"), F.min(F.struct("low", "gid")).alias("p"), F.max(F.struct("high", "gid")).alias("q"))
            .filter("members > 1")
        )
        self.met = materialize(
            join_key_stats(marked, pivots, ["sig"], "members", hot_rows).select(
                "sig", "gid", "first", "low", "high", F.col("p.gid").alias("p"), F.col("q.gid").alias("q")),
            "part-members")
        ends = F.explode(F.array("p", "q")).alias("other")
        tried = self.met.select("gid", ends).filter("gid <> other").distinct()
        self.by_pivot = materialize(_verified(tried, sets, threshold, min_shared), "pivot-pairs")

    def _both_ways(self, pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select(F.col("other").alias("gid"), F.col("gid").alias("other")))

    def edges(self) -> DataFrame:
        """(a, b) of `first` ids that connect what these pairs connect."""
        firsts = self.sets.select("gid", "first")

        def named(pairs: DataFrame) -> DataFrame:
            return (
                pairs.join(firsts.withColumnRenamed("first", "a"), "gid")
                .join(firsts.select(F.col("gid").alias("other"), F.col("first").alias("b")), "other").select("a", "b"))

        known = materialize(named(self.by_pivot), "pivot-edges")
        members, _ = connected_components(known, self.hot_rows)
        labelled = self.met.join(members.withColumnRenamed("node", "first"), "first", "left").select(
            "sig", "gid", F.coalesce("component", "first").alias("label"))
        open_ = labelled.groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("sig")
        left = materialize(labelled.join(open_, "sig", "left_semi"), "open-parts")
        right = left.select("sig", F.col("gid").alias("other"), F.col("label").alias("other_label"))
        rest = left.join(right, "sig").filter("label <> other_label AND gid < other").select("gid", "other").distinct()
        return known.unionByName(named(_verified(rest, self.sets, self.threshold, self.min_shared)))

    def ranges(self) -> DataFrame:
        """(gid, low, high) seen over near sets: enough to tell whether a set sees two customers."""
        own = self.sets.select(F.col("gid").alias("other"), "low", "high")
        seen = materialize(self._both_ways(self.by_pivot).join(own, "other").select("gid", "low", "high"), "pivot-ranges")
        spread = seen.unionByName(self.met.select("gid", "low", "high").distinct()).groupBy("gid").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        single = spread.filter("low = high").select("gid", F.col("low").alias("only"))
        others = self.met.select("sig", F.col("gid").alias("other"), F.col("low").alias("l"), F.col("high").alias("h"))
        rest = (
            self.met.select("sig", "gid").join(single, "gid").join(others, "sig")
            .filter("l <> only OR h <> only").select("gid", "other").distinct())
        found = _verified(rest, self.sets, self.threshold, self.min_shared)
        return seen.unionByName(found.join(own, "other").select("gid", "low", "high"))


def has_long_sets(sets: DataFrame) -> bool:
    return not sets.filter(F.size("tokens") > SHORT).isEmpty()


def near_set_edges(
    sets: DataFrame, marked: DataFrame, threshold: float, min_shared: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(a, b) pairs of `first` ids that connect all near-equal sets; `marked` holds their signatures.

    On each signature every fitting set is tied to the smallest set of the bucket: if x
    fits any y it also fits the smallest one, so connectivity is the same with one
    edge per member.
    """
    anchors = (
        marked.groupBy("sig")
        .agg(F.min(F.struct("size", "first")).alias("anchor"), F.count("*").alias("members"))
        .filter("members > 1")
    )
    tied = join_key_stats(marked, anchors, ["sig"], "members", hot_rows)
    short = tied.filter(
        (F.col("first") != F.col("anchor.first")) & _fits(F.col("size"), F.col("anchor.size"), threshold)
    ).select(F.col("first").alias("a"), F.col("anchor.first").alias("b"))
    if not has_long_sets(sets):
        return short
    return short.unionByName(LongSets(sets, threshold, min_shared, hot_rows).edges())


def near_set_range(
    sets: DataFrame, marked: DataFrame, threshold: float, min_shared: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(gid, low, high): smallest `low` and largest `high` over a set and all sets near it."""
    extras = range(int((1 - threshold) * SHORT + EPS) + 1)
    per_size = [F.min(F.when(F.col("extra") == e, F.col("low"))).alias(f"low{e}") for e in extras]
    per_size += [F.max(F.when(F.col("extra") == e, F.col("high"))).alias(f"high{e}") for e in extras]
    buckets = marked.groupBy("sig").agg(F.count("*").alias("members"), *per_size)
    met = join_key_stats(marked, buckets, ["sig"], "members", hot_rows)

    def near(side: str, pick) -> Column:
        fitting = [
            F.when(_fits(F.col("size"), F.col("sig_size") + e, threshold), F.col(f"{side}{e}")) for e in extras
        ]
        return pick(*fitting) if len(fitting) > 1 else fitting[0]

    short = met.select("gid", near("low", F.least).alias("low"), near("high", F.greatest).alias("high"))
    own = sets.filter(F.size("light") >= min_shared).select("gid", "low", "high")
    seen = short.unionByName(own)
    if has_long_sets(sets):
        seen = seen.unionByName(LongSets(sets, threshold, min_shared, hot_rows).ranges())
    return seen.groupBy("gid").agg(F.min("low").alias("low"), F.max("high").alias("high"))
