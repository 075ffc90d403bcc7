import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import number_rows, order_statistics, top_k
from ledgerlens.plans import loan_book, sampling


def test_order_statistics(spark):
    rng = random.Random(1)
    values = [rng.randrange(50) for _ in range(101)]
    df = spark.createDataFrame([(v, float(v) if v % 5 else None) for v in values], "a int, b double")
    b = sorted(v for v in values if v % 5)
    got = order_statistics(df, ["a", "b"], {"q1": 0.25, "q2": 0.5}, "linear")
    assert got["a"]["q2"] == sorted(values)[50]
    at = 0.25 * (len(b) - 1)
    low = b[int(at)] + (at - int(at)) * (b[min(int(at) + 1, len(b) - 1)] - b[int(at)])
    assert math.isclose(got["b"]["q1"], low)
    near = order_statistics(spark.range(1, 5).select(F.col("id").alias("a")), ["a"], {"q": 0.25}, "nearest")
    assert near["a"]["q"] == 2.0
    assert order_statistics(df.filter("a < 0"), ["a"], {"q": 0.5}, "nearest")["a"]["q"] is None


def test_large_top_k_is_cut_exactly(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)], "id long, v double")
    small = {r["id"] for r in top_k(df, "v", 37, "id").collect()}
    assert {r["id"] for r in top_k(df, "v", 37, "id", sort_limit=5).collect()} == small and len(small) == 37


def test_rows_are_numbered_without_gaps(spark):
    numbered = number_rows(spark.range(1000).repartition(7))
    assert sorted(r[0] for r in numbered.select("_row_num").collect()) == list(range(1, 1001))


@pytest.mark.parametrize(
    "population,exceptions,size", [(0, 0, 0), (30, 0, 30), (200, 5, 47), (1000, 60, 30), (3000, 0, 76), (600_000, 60_000, 80),
                                   (10_000, 5_000, 100), (100, 90, 20), (500_000, 0, 195)],
)
def test_sample_sizes(spark, population, exceptions, size):
    df = spark.createDataFrame([(population, exceptions)], "p long, x long")
    assert df.select(sampling.sample_size(F.col("p"), F.col("x"))).first()[0] == size


def wide_rows(spark, n=900):
    codes = ["", "PAN_DUPLICATE|PAN_MISSING", "EMAIL_MISSING", "STATE_PIN_MISMATCH", "MOBILE_DUPLICATE", "UNKNOWN_CODE"]
    rows = [(i, codes[i % 6], "OK" if i % 6 == 0 else "WARN") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "_row_num long, exception_codes string, overall_status string")


def test_selected_sample(spark):
    wide = wide_rows(spark)
    first = [tuple(r) for r in sampling.select_sample(wide, "e", "r").collect()]
    again = [tuple(r) for r in sampling.select_sample(wide.repartition(5), "e", "r").collect()]
    other = [tuple(r) for r in sampling.select_sample(wide, "e", "other").collect()]
    assert first == again != other
    levels = [r[4] for r in first]
    assert levels == sorted(levels, key=sampling.STRATA.index) and set(levels) == set(sampling.STRATA)
    assert len({r[1] for r in first}) == len(first) <= 47
    assert first[0][3] == "CRITICAL: PAN_DUPLICATE"
    summary = {r["stratum"]: r["count"] for r in sampling.stratum_summary(wide).collect()}
    assert summary == {"CRITICAL": 150, "HIGH": 150, "MEDIUM": 150, "LOW": 300, "OK": 150}


def test_audit_sample_of_a_loan_book(spark):
    import datetime

    rng = random.Random(4)
    rows = []
    for i in range(3000):
        rows.append((
            i, None if i % 300 == 3 else f"LAN{i - (i % 200 == 1)}", f"C{i}", "2024-13-45" if i == 7 else f"20{rng.randrange(10, 24)}-05-{1 + i % 28:02d}",
            100_000 if i % 500 else 0, 50_000, 9.5, 36, rng.choice(["Active", "Closed"]) if i % 11 else "NPA", 90 if i % 11 == 0 else 0,
            f"P{i % 3}", f"B{i % 2}", "Complete" if i % 40 else None if i % 80 else "Expired",
        ))
    df = spark.createDataFrame(
        rows, "ROW_ID long, LAN string, CUSTOMER_ID string, LOAN_DATE string, SANCTIONED_AMT long, OUTSTANDING_AMT long,"
        " INTEREST_RATE double, TENURE_MONTHS int, LOAN_STATUS string, DPD int, PRODUCT string, BRANCH string, KYC_STATUS string",
    )
    sample, summary = loan_book.audit_sample(df, datetime.date(2024, 12, 31), hot_rows=5)
    again, _ = loan_book.audit_sample(df.repartition(6), datetime.date(2024, 12, 31))
    got = {(r["ROW_ID"], r["SELECTION_REASON"]) for r in sample.collect()}
    assert got == {(r["ROW_ID"], r["SELECTION_REASON"]) for r in again.collect()}
    assert len({i for i, _ in got}) == len(got) == summary["total_sample_size"] == sample.count()
    assert summary["clean_records"] + summary["exception_records"] == 3000
    for name, counts in summary["per_class"].items():
        assert counts["sampled"] == min(counts["found"], loan_book.PER_CLASS), name
    strata = {r for _, r in got if r.startswith("STRATA")}
    # every closed loan still has a balance, so only two statuses are clean
    assert len(strata) == summary["strata_covered"] == 3 * 2 * 2
    assert summary["random_sampled"] == 50 - 12
    weights = [r["RECENCY_WEIGHT"] for r in sample.collect()]
    assert all(0.25 <= w <= 1.0 for w in weights)


def test_sketches_of_parts_merge(spark):
    from ledgerlens.operators import sketches

    values = [(i % 7, float((i * 7919) % 10_007)) for i in range(10_007)] + [(1, None)]
    df = spark.createDataFrame(values, "part int, v double")
    parts = sketches.quantile_sketches(df.filter("part < 3"), ["v"], 0.01, ("part",)).unionByName(
        sketches.quantile_sketches(df.filter("part >= 3"), ["v"], 0.01, ("part",)))
    whole = sketches.merged_sketches(parts).select("values", *[sketches.quantile("sketch", q).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.9)])
    [row] = whole.collect()
    assert row["values"] == 10_007
    for q in (0.1, 0.5, 0.9):
        assert abs(row[f"q{int(100 * q)}"] / 10_007 - q) < 0.015
    none = sketches.approximate_quantiles(df.filter("v IS NULL"), ["v"], {"m": 0.5}, 0.01)
    assert none == {"v": {"m": None}}


def test_large_allocations_rank_only_the_rows_near_their_end(spark, monkeypatch, capsys):
    monkeypatch.setattr(sampling, "DRAW_DIGITS", 2)
    wide = spark.range(1, 40_001).select(
        F.col("id").alias("_row_num"), F.when(F.col("id") % 3 == 0, "OK").otherwise("ERROR").alias("overall_status"),
        F.when(F.col("id") % 3 == 0, "").otherwise("PAN_INVALID").alias("exception_codes"))
    picked = sampling.select_sample(wide, "e", "r")
    got = {s: {r["_row_num"] for r in picked.filter(F.col("criticality") == s).collect()} for s in {r[0] for r in picked.select("criticality").distinct().collect()}}
    seed = sampling.sample_seed("e", "r")
    draws = {i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in range(1, 40_001)}
    clean = [i for i in draws if i % 3 == 0]
    others = [i for i in draws if i % 3]
    [bad] = set(got) - {"OK"}
    for rows, name in ((clean, "OK"), (others, bad)):
        assert got[name] == set(sorted(rows, key=draws.get)[: int(200 * (len(rows) / 40_000))])
    capsys.readouterr()
    picked.explain(True)
    assert "last_head" in capsys.readouterr().out.split("row_number(")[-1]
