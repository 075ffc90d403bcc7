"""Stratified audit samples of a wide exception table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.severity import STRATA, severity_name, severity_rank
from ledgerlens.functions.values import share, unpivot

# Attribute sample sizes at 95 % confidence. One line per population band
# (largest population of the band), one size per band of the expected deviation rate.
DEVIATION_BANDS = (0.05, 0.10, 0.15, 0.20)
SAMPLE_SIZES = (
    (250, (47, 30, 20, 15)),
    (500, (47, 30, 20, 15)),
    (1_000, (47, 30, 20, 15)),
    (5_000, (76, 52, 34, 25)),
    (50_000, (160, 100, 65, 50)),
    (500_000, (195, 125, 80, 60)),
    (None, (195, 125, 80, 60)),
)
DRAW_DIGITS = 4  # hexadecimal digits of a draw by which draws are counted
MOST_TABLED = max(max(sizes) for _, sizes in SAMPLE_SIZES)


def sample_size(population: Column, exceptions: Column) -> Column:
    """Rows to test for a population with this many exceptions; never more than the population.

    Above the last deviation band the square root of the population, at least 20, is used.
    """
    rate = F.coalesce(F.try_divide(exceptions.cast("double"), population.cast("double")), F.lit(0.0))
    band = F.when(rate < 0, None)
    for i, limit in enumerate(DEVIATION_BANDS):
        band = band.when(rate < limit, i)
    row = None
    for largest, sizes in SAMPLE_SIZES:
        cell = F.get(F.array(*[F.lit(s) for s in sizes]), band)
        if largest is None:
            row = row.otherwise(cell)
        else:
            row = F.when(population <= largest, cell) if row is None else row.when(population <= largest, cell)
    root = F.greatest(F.lit(20).cast("long"), F.floor(F.sqrt(population.cast("double"))).cast("long"))
    return F.least(F.coalesce(row.cast("long"), root), population.cast("long"))


def segment_sample_sizes(wide: DataFrame, *segments: str) -> DataFrame:
    """Population, exceptions and sample size of every segment in one aggregation."""
    per = wide.groupBy(*segments).agg(
        F.count("*").alias("population"), F.count_if(F.col("overall_status") != "OK").alias("exceptions")
    )
    return per.withColumn("sample_size", sample_size(F.col("population"), F.col("exceptions")))


def with_stratum(wide: DataFrame) -> DataFrame:
    """Adds `stratum`: OK, or the worst severity among the row's codes."""
    codes = F.filter(F.transform(F.split("exception_codes", r"\|"), F.trim), lambda c: c != "")
    worst = F.array_min(F.transform(codes, severity_rank))
    clean = (F.col("overall_status") == "OK") | (F.trim(F.coalesce("exception_codes", F.lit(""))) == "")
    return wide.withColumn("stratum", F.when(clean, "OK").otherwise(severity_name(worst)))


def stratum_summary(wide: DataFrame) -> DataFrame:
    counts = with_stratum(wide).agg(
        F.count("*").alias("all"), *[F.count_if(F.col("stratum") == s).alias(s) for s in STRATA]
    )
    rows = [[F.lit(s), F.col(s), share(F.col(s), F.col("all"), 4)] for s in STRATA]
    return unpivot(counts, rows, ["stratum", "count", "percentage"])


def sample_seed(engagement: str, run: str) -> int:
    return int(hashlib.sha256(f"{engagement}:{run}".encode()).hexdigest()[:8], 16)


def select_sample(wide: DataFrame, engagement: str, run: str) -> DataFrame:
    """A reproducible sample, proportional to the strata and at least one row from each.

    Rows are ranked inside their stratum by a hash of the seed and the row number. Draws are
    counted by their first digits before, and only the rows up to the digits in which a
    stratum's allocation ends are ranked, so a stratum is never gathered, whatever its allocation.
    """
    strata = with_stratum(wide)
    counts = strata.agg(
        F.count("*").alias("population"),
        F.count_if(F.col("overall_status") != "OK").alias("exceptions"),
        *[F.count_if(F.col("stratum") == s).alias(s) for s in STRATA],
    )
    facts = counts.withColumn("size", sample_size(F.col("population"), F.col("exceptions"))).first()
    size, population = facts["size"], facts["population"]
    quota = {
        s: min(max(1, int(size * (facts[s] / population))), facts[s]) for s in STRATA if population and facts[s]
    }
    if not quota or size < 1:
        quota, size = {}, 0
    seed = sample_seed(engagement, run)
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_row_num").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("draw", "_row_num"))
    allowed = F.lit(0)
    for s, n in quota.items():
        allowed = F.when(F.col("stratum") == s, n).otherwise(allowed)
    first_code = F.get(F.split("exception_codes", r"\|"), F.lit(0))
    coded = F.trim("exception_codes") != ""
    rank = F.array_position(F.array(*[F.lit(s) for s in STRATA]), F.col("stratum"))
    drawn = strata.select("_row_num", "exception_codes", "stratum", draw.alias("draw"))
    head = F.substring("draw", 1, DRAW_DIGITS)
    upto = F.sum("count").over(Window.partitionBy("stratum").orderBy("head"))  # one line per head
    ends = (
        drawn.groupBy("stratum", head.alias("head")).count().withColumn("before", upto - F.col("count"))
        .filter(F.col("before") < allowed).groupBy("stratum").agg(F.max("head").alias("last_head"))
    )
    picked = (
        drawn.join(F.broadcast(ends), "stratum").filter(head <= F.col("last_head"))
        .withColumn("place", place)
        .filter(F.col("place") <= allowed)
        .select(
            "_row_num", "exception_codes",
            F.concat("stratum", F.lit(": "), F.when(coded, first_code).otherwise("No specific code"))
            .alias("selection_reason"),
            F.col("stratum").alias("criticality"), rank.alias("rank"),
        )
        .orderBy("rank", "_row_num")
        .limit(size)
    )
    number = F.row_number().over(Window.orderBy("rank", "_row_num"))  # over the sample only
    return picked.select(number.alias("sample_no"), "_row_num", "exception_codes", "selection_reason", "criticality")
