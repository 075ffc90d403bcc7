"""Exposure-at-default and expected-credit-loss reports over a merged exposure table."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.values import (
    amount,
    distinct_with_null,
    is_blank_raw,
    iso_date,
    parse_snapshot_date,
    percent,
    ref,
    rounded,
    share,
    strip,
    text,
    total,
    unpivot,
)
from ledgerlens.operators.ordering import order_statistics
from ledgerlens.plans.report import NotAvailable, ReportResult, asc, desc, plan_report, require
from ledgerlens.session import materialize

# --- Fixed values: names and patterns that reports and their readers agree on -------------------

# Pivot dimensions: canonical names, then headers that pass through unmapped.
PIVOT_DIMENSIONS = (
    "entity source_system_id scheme_id scheme_name branch_id branch_name state sbu sub_sbu"
    " channel_code channel_desc loan_status stage dpd_bucket written_off"
    " System ECL WriteOffSecuSelldown ProductID ProductName FVTPL FuturePoS_GL_ID FuturePOS_GL_Des"
    " Principle_DRS_GL_ID Principle_DRS_GL_Des INT_DRS_GL_ID INT_DRS_GL_DESC Accrued_Interest_GL_ID"
    " Accrued_Interest_GL_DESC Redemption_Premium_Debtors_GL_ID Redemption_Premium_Debtors_GL_DESC"
    " Accrued_Redemption_Premium_GL_ID Accrued_Redemption_Premium_GL_DESC Prepaid_GL_ID Prepaid_GL_DESC"
).split()

# Pivot measures: source column and output name.
PIVOT_MEASURES = {
    "future_pos": "Sum(FuturePOS)",
    "outstanding_principal": "Sum(DrsPOS)",
    "outstanding_interest": "Sum(DrsInt)",
    "accrued_interest": "Sum(AccruedInterest)",
    "overdue_charges": "Sum(OverDueCharges)",
    "gross_book_value": "Sum(Gross_Loans_and_Advances)",
    "ead": "Sum(EAD)",
    "mob": "Sum(MOB)",
    "collateral_value": "Sum(National_Asset_Value)",
    "covered_portion": "Sum(Covered_Portion)",
    "uncovered_portion": "Sum(Uncovered_Portion)",
    "existing_provision": "Sum(Provsion_as_per_Policy)",
    "additional_provision": "Sum(AdditionalProvision)",
    "total_provision": "Sum(Total_Provision)",
    "sanction_amount": "Sum(SANCTIONAMOUNT)",
    "disbursed_amount": "Sum(DISBURSEDAMOUNT)",
    "loan_id": "Count(AGREEMENTID_R)",
    "principal_paid": "Sum(PrincipalPaid)",
    "interest_paid": "Sum(InterestPaid)",
    "emi_amount": "Sum(EMI Amount)",
}

# Pivot measures under their raw header.
PIVOT_RAW_MEASURES = (
    "Prepaid|Debtors_Redemption_Premium|AccruedRedemptionPremium|TotalDebtors|zero_90_days_interest"
    "|zero_90_days_interest_Hist|zero_90_int_Final|Other Charges Paid|PrinAdvance|CBC Unpaid|ODC Unpaid"
    "|CBC|ODC|CBC Paid|ODC Paid|PROCESSINGFEES|Unbanked"
).split("|")

# Columns of the negative-value check.
SIGNED_COLUMNS = (
    "ead outstanding_principal outstanding_interest accrued_interest overdue_charges future_pos"
    " gross_book_value collateral_value covered_portion uncovered_portion existing_provision"
    " additional_provision total_provision sanction_amount disbursed_amount principal_paid"
    " interest_paid emi_amount mob Prepaid TotalDebtors Debtors_Redemption_Premium"
    " AccruedRedemptionPremium zero_90_days_interest zero_90_int_Final PROCESSINGFEES Unbanked"
).split()

QUALITY_COLUMNS = (
    "loan_id stage dpd_bucket ead gross_book_value outstanding_principal collateral_value"
    " total_provision written_off"
).split()

# Bucket texts beyond 90 days, and status texts of a closed account; either may match anywhere.
HIGH_DPD = "91|121|151|181|211|241|271|361|npa|sub|doubtful|loss"
CLOSED = "closed|written off|writeoff|wo|write off|settled|foreclosed"

# --- Shared pieces -------------------------------------------------------------------------------


def is_high_dpd(bucket: Column) -> Column:
    return F.coalesce(F.lower(bucket.cast("string")).rlike(HIGH_DPD), F.lit(False))


def is_closed(status: Column) -> Column:
    return F.coalesce(F.lower(status.cast("string")).rlike(CLOSED), F.lit(False))


def in_last_snapshot(df: DataFrame) -> Column | None:
    """Whether a row is of the latest business_date; None when there is no usable date.

    The texts (or the date) that mean the latest day are found first, by a small job over that one column, so what
    is left is a plain IN that prunes partitions and reaches the scan. One day has few spellings.
    """
    if "business_date" not in df.columns:
        return None
    raw = ref("business_date")
    seen = df.select(raw.alias("raw")).filter("raw IS NOT NULL").distinct()
    dated = isinstance(df.schema["business_date"].dataType, T.DateType)
    days = seen.groupBy((F.col("raw") if dated else iso_date(seen, "raw")).alias("day")).agg(F.collect_set("raw").alias("texts"), F.max("raw").alias("last"))
    latest = days.agg(F.max_by(F.struct("day", "texts"), "day").alias("dated"), F.max("last").alias("last")).first()
    if latest["dated"] is not None and latest["dated"]["day"] is not None:
        return raw.isin(*latest["dated"]["texts"])
    return None if latest["last"] is None else raw == latest["last"]


def last_snapshot(df: DataFrame) -> DataFrame:
    """Rows of the latest business_date; the frame itself when there is no usable date."""
    inside = in_last_snapshot(df)
    return df if inside is None else df.filter(inside)


@dataclass
class Grouping:
    """A group-by report: source keys and their titles, measures by title, and the order."""

    keys: dict[str, str]
    measures: tuple[str, ...]
    order: tuple = ()
    needs: tuple[str, ...] = ()
    min_keys: int = 1
    latest_only: bool = False
    coverage: tuple[str, str, str] | None = None
    titles: dict[str, str] = field(default_factory=dict)


# title -> (source column, how)
MEASURES = {
    "LAN Count": ("loan_id", "count"),
    "Loan Count": ("loan_id", "count"),
    "New Loans": ("loan_id", "count"),
    "Total EAD": ("ead", "sum"),
    "Total Provision": ("total_provision", "sum"),
    "Provision as per Policy": ("existing_provision", "sum"),
    "Additional Provision": ("additional_provision", "sum"),
    "Outstanding Principal": ("outstanding_principal", "sum"),
    "Covered (Secured)": ("covered_portion", "sum"),
    "Uncovered (Unsecured)": ("uncovered_portion", "sum"),
    "Total Disbursed": ("disbursed_amount", "sum"),
    "Total Sanctioned": ("sanction_amount", "sum"),
}
PROVISION_COVER = ("Total Provision", "Total EAD", "Coverage %")
PRODUCT = {"scheme_id": "Product ID", "scheme_name": "Product Name"}

GROUPINGS = {
    "ucid_lan": Grouping(
        {"ucid": "UCID"}, ("LAN Count", "Total EAD", "Total Provision"),
        order=(("LAN Count", "desc"),), needs=("ucid", "loan_id"), latest_only=True,
    ),
    "state_ead": Grouping(
        {"state": "State"}, ("Loan Count", "Total EAD", "Total Provision"),
        order=(("Total EAD", "desc"),), latest_only=True, coverage=PROVISION_COVER,
    ),
    "product_ead": Grouping(
        PRODUCT, ("Loan Count", "Total EAD", "Total Provision", "Outstanding Principal"),
        order=(("Total EAD", "desc"),), latest_only=True, coverage=PROVISION_COVER,
    ),
    "product_stage_dpd": Grouping(
        {**PRODUCT, "stage": "Stage", "dpd_bucket": "DPD Bucket"}, ("Loan Count", "Total EAD", "Total Provision"),
        order=(("Product Name", "asc"), ("Product ID", "asc"), ("Stage", "asc"), ("DPD Bucket", "asc")),
        min_keys=2, latest_only=True,
    ),
    "stage_summary": Grouping(
        {"stage": "stage"},
        ("Total EAD", "Total Provision", "Provision as per Policy", "Additional Provision", "Loan Count"),
        order=(("stage", "asc"),), coverage=PROVISION_COVER,
    ),
    "dpd_summary": Grouping(
        {"dpd_bucket": "DPD Bucket"}, ("Loan Count", "Total EAD", "Outstanding Principal", "Total Provision"),
        order=(("DPD Bucket", "asc"),),
    ),
    "security": Grouping(
        {"stage": "Stage"}, ("Covered (Secured)", "Uncovered (Unsecured)", "Total EAD"),
        order=(("Stage", "asc"),), coverage=("Covered (Secured)", "Total EAD", "Security Coverage %"),
    ),
    "writeoff": Grouping(
        {"written_off": "written_off", "stage": "stage"}, ("Total EAD", "Total Provision", "Loan Count"),
        order=(("written_off", "asc"), ("stage", "asc")),
    ),
    "sbu": Grouping(
        {"sbu": "SBU", "sub_sbu": "Sub-SBU"}, ("Total EAD", "Total Provision", "Loan Count"),
        order=(("SBU", "asc"),),
    ),
    "fvtpl": Grouping(
        {"FVTPL": "FVTPL"}, ("Total EAD", "Total Provision", "Loan Count"), order=(("FVTPL", "asc"),)
    ),
}


def _measure(df: DataFrame, title: str) -> Column:
    source, how = MEASURES[title]
    return (F.count(ref(source)) if how == "count" else total(df, source)).alias(title)


def _summarise(df: DataFrame, keys: dict[str, str], measures: tuple[str, ...], counter: str) -> DataFrame:
    present = [m for m in measures if MEASURES[m][0] in df.columns]
    columns = [_measure(df, m) for m in present] or [F.count("*").alias(counter)]
    return df.groupBy(*[ref(k).alias(t) for k, t in keys.items()]).agg(*columns)


def _ordered(result: DataFrame, order, keys) -> DataFrame:
    """Sort with NULLs first in both directions; the group keys break ties."""
    named = [(n, way) for n, way in order if n in result.columns]
    named += [(k, "asc") for k in keys if k not in dict(named)]
    return result.orderBy(*[(desc if way == "desc" else asc)(n)[0] for n, way in named])


def _keys_of(df: DataFrame, key: str) -> dict[str, str]:
    """The group keys of a report that the frame has, with their titles."""
    spec = GROUPINGS[key]
    require(df, *spec.needs)
    keys = {k: t for k, t in spec.keys.items() if k in df.columns}
    if len(keys) < spec.min_keys:
        raise NotAvailable(f"{' / '.join(spec.keys)} columns not available")
    return keys


def grouped_report(df: DataFrame, key: str, latest: Callable[[DataFrame], DataFrame] = last_snapshot) -> DataFrame:
    """A report that is one group-by; `latest` gives the rows of the last snapshot."""
    spec, keys = GROUPINGS[key], _keys_of(df, key)
    source = latest(df) if spec.latest_only else df
    return _finished(_summarise(source, keys, spec.measures, "Loan Count"), key, keys)


def _finished(result: DataFrame, key: str, keys: dict[str, str]) -> DataFrame:
    """The sums of a report with what is worked out from them, in order."""
    spec = GROUPINGS[key]
    if spec.coverage and set(spec.coverage[:2]) <= set(result.columns):
        part, whole, title = spec.coverage
        result = result.withColumn(title, percent(ref(part), ref(whole)))
    if key == "product_stage_dpd" and {"DPD Bucket", "Stage"} <= set(result.columns):
        early = strip(ref("Stage").cast("string")) == "1"
        result = result.withColumn("DPD-Stage Mismatch", is_high_dpd(ref("DPD Bucket")) & early)
    return _ordered(result, spec.order, keys.values())


class SharedSums:
    """All group-by reports from one pass over the book.

    Every row is expanded to one line per report that it counts in, with that report's keys alone filled in; the lines are
    summed before they are shuffled, and the sums, a table of the size of the reports, are written once. Reports over the same keys and rows share
    their lines.
    """

    def __init__(self, df: DataFrame, reports: list[str]):
        self.df = df
        self.sets: dict[tuple, int] = {}
        for key in reports:
            try:
                keys = _keys_of(df, key)
            except NotAvailable:
                continue
            self.sets.setdefault((GROUPINGS[key].latest_only, tuple(keys)), len(self.sets))
        if not self.sets:
            return
        columns = list(dict.fromkeys(k for _, keys in self.sets for k in keys))
        kinds = {f.name: f.dataType for f in df.schema.fields}

        def line(number: int, keys: tuple[str, ...]) -> Column:
            held = [(ref(c) if c in keys else F.lit(None).cast(kinds[c])).alias(f"k{i}") for i, c in enumerate(columns)]
            return F.struct(F.lit(number).alias("set"), *held)

        every = [line(n, keys) for (latest, keys), n in self.sets.items() if not latest]
        newest = [line(n, keys) for (latest, keys), n in self.sets.items() if latest]
        inside = in_last_snapshot(df) if newest else None
        if inside is None:
            lines = F.array(*every, *newest)
        elif every:
            lines = F.when(inside, F.array(*every, *newest)).otherwise(F.array(*every))
        else:
            lines = F.when(inside, F.array(*newest))
        sources = [s for s in dict.fromkeys(s for s, _ in MEASURES.values()) if s in df.columns]
        sums = [(F.count(ref(s)) if s == "loan_id" else total(df, s)).alias(f"m{i}") for i, s in enumerate(sources)]
        rows = df.select(*[ref(s) for s in sources], F.explode(lines).alias("line")).select(*[ref(s) for s in sources], "line.*")
        names = ["set", *[f"k{i}" for i in range(len(columns))]]
        self.written = materialize(rows.groupBy(*names).agg(*sums, F.count("*").alias("rows")), "exposure-sums")
        self.key_at, self.sum_at = {c: f"k{i}" for i, c in enumerate(columns)}, {s: f"m{i}" for i, s in enumerate(sources)}

    def report(self, key: str) -> DataFrame:
        spec, keys = GROUPINGS[key], _keys_of(self.df, key)
        number = self.sets[spec.latest_only, tuple(keys)]
        measures = [F.col(self.sum_at[MEASURES[m][0]]).alias(m) for m in spec.measures if MEASURES[m][0] in self.sum_at]
        held = [F.col(self.key_at[k]).alias(t) for k, t in keys.items()]
        own = self.written.filter(F.col("set") == number).select(*held, *(measures or [F.col("rows").alias("Loan Count")]))
        return _finished(own, key, keys)


# --- Reports that are more than one group-by -----------------------------------------------------


def _as_date(value: str | None):
    import datetime

    try:
        return datetime.date.fromisoformat(value) if value else None
    except (ValueError, TypeError):
        return None


def disbursement(df: DataFrame, period_from: str | None = None, period_to: str | None = None) -> DataFrame:
    """New loans by month and product inside a period; unusable bounds are ignored."""
    require(df, "disbursement_date")
    day = iso_date(df, "disbursement_date")
    start, end = _as_date(period_from), _as_date(period_to)
    inside = day.isNotNull()
    if start:
        inside = inside & (day >= F.lit(start))
    if end:
        inside = inside & (day <= F.lit(end))
    dated = df.filter(inside).withColumn("__month", F.date_format(day, "yyyy-MM"))
    keys = {"__month": "Disbursement Month"}
    keys.update({k: t for k, t in {**PRODUCT, "state": "State"}.items() if k in df.columns})
    result = _summarise(dated, keys, ("New Loans", "Total Disbursed", "Total Sanctioned"), "New Loans")
    return result.orderBy(*asc(*keys.values()))


def pivot(df: DataFrame, numeric_ids_only: bool = False) -> DataFrame:
    """Every present dimension against every present measure.

    Loan ids are counted whatever they look like; earlier reports counted only those that are numbers.
    """
    dims = [d for d in PIVOT_DIMENSIONS if d in df.columns]
    columns = []
    for source, title in PIVOT_MEASURES.items():
        if source in df.columns:
            value = F.count(amount(df, source) if numeric_ids_only else ref(source)) if source == "loan_id" else total(df, source)
            columns.append(value.alias(title))
    columns += [total(df, c).alias(f"Sum({c})") for c in PIVOT_RAW_MEASURES if c in df.columns]
    if not columns:
        raise NotAvailable("no measure columns available")
    coded = _coded(df, dims)
    if coded is not None:
        rows, code, named = coded
        return named(rows.groupBy(code).agg(*columns).orderBy(code))
    result = df.groupBy(*[ref(d) for d in dims]).agg(*columns)
    return result.orderBy(*asc(*dims)) if dims else result


CODE_BITS, CODED_VALUES = 62, 10_000


def _coded(df: DataFrame, dims: list[str]) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]] | None:
    """The rows with one number for the values of all dims, the column's name, and what turns numbers back into the dims.

    Each text is its place among the dim's distinct texts, NULL first, and places are the digits of the number, so numbers sort as the texts do and
    a row carries eight bytes through a shuffle. None where dims are not texts, or have too many different ones for that.
    """
    if not dims or any(not isinstance(df.schema[d].dataType, T.StringType) for d in dims):
        return None
    lines = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), ref(d).alias("value")) for i, d in enumerate(dims)])).alias("line")
    values = materialize(df.select(lines).select("line.*").distinct(), "dimension-values")
    sizes = {r["dim"]: r["n"] for r in values.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes or max(sizes.values()) > CODED_VALUES or math.prod(sizes.values()) >> CODE_BITS:
        return None
    code, weight, weights = F.lit(0).cast("long"), 1, {}
    places = values.withColumn("place", (F.row_number().over(Window.partitionBy("dim").orderBy(*asc("value"))) - 1).cast("long"))
    digits = [F.broadcast(places.filter(F.col("dim") == i).select(F.col("value").alias(f"__value{i}"), F.col("place").alias(f"__place{i}"))) for i in range(len(dims))]
    rows = df
    for i, d in reversed(list(enumerate(dims))):
        rows = rows.join(digits[i], ref(d).eqNullSafe(F.col(f"__value{i}")))
        code, weights[i] = code + F.col(f"__place{i}") * weight, weight
        weight *= sizes[i]

    def named(sums: DataFrame) -> DataFrame:  # without a join, which would take the order away
        names = []
        for i, d in enumerate(dims):
            texts = values.filter(F.col("dim") == i).agg(F.sort_array(F.collect_list(F.struct("value")))["value"])
            names.append(F.get(texts.scalar(), F.expr(f"CAST(__code div {weights[i]}L % {sizes[i]}L AS INT)")).alias(d))
        return sums.select(*names, *[ref(c) for c in sums.columns if c != "__code"])

    return rows.withColumn("__code", code), "__code", named


def provision_check(df: DataFrame) -> DataFrame:
    """Rows with an overlay; the overlay is an outlier above twice the median overlay ratio."""
    require(df, "additional_provision")
    extra = amount(df, "additional_provision")
    titles = {"loan_id": "Loan ID", "stage": "Stage", "dpd_bucket": "DPD Bucket", "ead": "EAD"}
    columns = [ref(c).alias(t) for c, t in titles.items() if c in df.columns]
    columns.append(ref("additional_provision").alias("Additional Provision"))
    rows = df.filter(extra > 0)
    if "existing_provision" not in df.columns:
        return rows.select(*columns)
    policy = amount(df, "existing_provision").cast("double")
    ratio = F.when(policy > 0, rounded(F.try_divide(extra.cast("double"), policy), 4))
    found = rows.select(*columns, policy.alias("Policy Provision"), ratio.alias("Ratio (Addl/Policy)"))
    middle = order_statistics(
        found.select(ref("Ratio (Addl/Policy)").alias("ratio")), ["ratio"], {"median": 0.5}, "linear"
    )["ratio"]["median"]
    if middle is None:
        return found
    return found.withColumn("Outlier Flag", ref("Ratio (Addl/Policy)") > 2 * middle)


def negative_check(df: DataFrame) -> DataFrame:
    names = [c for c in SIGNED_COLUMNS if c in df.columns]
    if not names:
        raise NotAvailable("No numeric columns found")
    counts = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        value = amount(df, c)
        counts += [F.count_if(value < 0).alias(f"neg{i}"), F.count_if(value.isNull()).alias(f"nul{i}")]
    rows = [
        [F.lit(c), F.col("rows"), F.col(f"neg{i}"), F.col(f"nul{i}"), F.col(f"neg{i}") > 0]
        for i, c in enumerate(names)
    ]
    return unpivot(df.agg(*counts), rows, ["Column", "Total Rows", "Negative Count", "Null Count", "Has Issue"])


def stage_mismatch(df: DataFrame) -> DataFrame:
    """Early stage with high arrears, or a closed account still in a late stage."""
    require(df, "stage")
    stage = strip(ref("stage").cast("string"))
    tests = []
    if "dpd_bucket" in df.columns:
        tests.append(is_high_dpd(ref("dpd_bucket")) & (stage == "1"))
    if "loan_status" in df.columns:
        tests.append(is_closed(ref("loan_status")) & stage.isin("2", "3"))
    if not tests:
        raise NotAvailable("Insufficient columns to detect mismatches")
    wrong = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    titles = {
        "loan_id": "Loan ID", "stage": "Stage", "dpd_bucket": "DPD Bucket",
        "loan_status": "Loan Status", "ead": "EAD",
    }
    return df.filter(wrong).select(*[ref(c).alias(t) for c, t in titles.items() if c in df.columns])


def portfolio_concentration(df: DataFrame, top_n: int = 10) -> DataFrame:
    require(df, "loan_id", "ead")
    return _largest(df.groupBy("loan_id").agg(total(df, "ead").alias("Total EAD"), F.count("loan_id").alias("Loan Count")), top_n)


def _largest(loans: DataFrame, top_n: int = 10) -> DataFrame:
    largest = loans.orderBy(*desc("Total EAD"), *asc("loan_id")).limit(top_n)
    place = Window.orderBy(*desc("Total EAD"), *asc("loan_id"))  # over top_n rows
    return largest.select(F.row_number().over(place).alias("Rank"), "loan_id", "Total EAD", "Loan Count")


def _distribution(df: DataFrame, key: str, loans: Column | None = None) -> DataFrame:
    """Distinct loans (or `loans`, a column of the key that gives them) and exposure by a key."""
    require(df, key, "loan_id", "ead")
    count = distinct_with_null(F.col("loan_id")) if loans is None else F.count(F.lit(1))
    sums = df.groupBy(key).agg(count.alias("Loan Count"), total(df, "ead").alias("Total EAD"))
    if loans is not None:
        sums = sums.withColumn("Loan Count", loans)
    return sums.orderBy(*desc("Total EAD"), *asc(key))


def stage_distribution(df: DataFrame) -> DataFrame:
    return _distribution(df, "stage")


def dpd_risk_distribution(df: DataFrame) -> DataFrame:
    return _distribution(df, "dpd_bucket")


def writeoff_recovery(df: DataFrame) -> DataFrame:
    return _distribution(df, "written_off")


LOAN_KEYS = {"stage_distribution": "stage", "dpd_risk_distribution": "dpd_bucket", "writeoff_recovery": "written_off"}


class SharedLoans:
    """The reports on single loans from one line a loan: its sums, and a bit for every value of a key that it occurs with.

    A loan then travels once instead of once for every report. Bits fit one number, so a key with too many values for what is left
    of it (or of a type that has no plain literal) keeps the report's own plan.
    """

    BITS = 62

    def __init__(self, df: DataFrame, reports: list[str]):
        self.df, self.counts = df, {}
        require(df, "loan_id", "ead")
        bits: dict[str, list] = {}
        for key in (LOAN_KEYS[r] for r in reports if r in LOAN_KEYS):
            if key not in df.columns or not isinstance(df.schema[key].dataType, (T.StringType, T.IntegralType, T.BooleanType, T.DateType)):
                continue
            free = self.BITS - sum(map(len, bits.values()))
            values = [r[0] for r in df.select(ref(key)).distinct().limit(free + 1).collect()]
            if len(values) <= free:
                bits[key] = values
        place = {(k, v): 1 << i for i, (k, v) in enumerate((k, v) for k, values in bits.items() for v in values)}
        mask = F.lit(0).cast("long")
        for (key, value), bit in place.items():
            mask = mask.bitwiseOR(F.when(ref(key).eqNullSafe(F.lit(value)), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        sums = [total(df, "ead").alias("Total EAD"), F.count("loan_id").alias("Loan Count"), F.bit_or(mask).alias("held")]
        self.loans = materialize(df.groupBy("loan_id").agg(*sums), "loans")
        if place:
            found = self.loans.agg(*[F.count_if(F.col("held").bitwiseAND(F.lit(bit)) != 0).alias(f"n{i}") for i, bit in enumerate(place.values())]).first()
            for (key, value), n in zip(place, found):
                self.counts.setdefault(key, []).append((value, n))

    def report(self, key: str) -> DataFrame:
        if key == "portfolio_concentration":
            return _largest(self.loans)
        by = LOAN_KEYS[key]
        if by not in self.counts:
            return _distribution(self.df, by)
        loans = F.lit(0).cast("long")
        for value, n in self.counts[by]:
            loans = F.when(ref(by).eqNullSafe(F.lit(value)), F.lit(n).cast("long")).otherwise(loans)
        return _distribution(self.df, by, loans)


def _part_of_whole(df, part, whole, title, labels, order) -> DataFrame:
    """Three lines: the part, the rest and the whole, with their percentages."""
    require(df, part, whole)
    sums = df.agg(total(df, part).alias("p"), total(df, whole).alias("w"))
    portion = share(F.col("p"), F.col("w"))
    lines = {
        "part": [F.col("p"), portion],
        "rest": [F.col("w") - F.col("p"), rounded(F.lit(100.0) - share(F.col("p"), F.col("w"), 10), 2)],
        "whole": [F.col("w"), F.lit(100.0)],
    }
    rows = [[F.lit(label), *lines[kind]] for label, kind in zip(labels, order)]
    return unpivot(sums, rows, [title, "Amount", "Percent"])


def collateral_coverage(df: DataFrame) -> DataFrame:
    labels = ("Covered", "Uncovered", "Total")
    return _part_of_whole(df, "collateral_value", "ead", "Coverage Type", labels, ("part", "rest", "whole"))


def provision_coverage(df: DataFrame) -> DataFrame:
    labels = ("Provided", "Uncovered", "Total Exposure")
    return _part_of_whole(df, "total_provision", "ead", "Coverage Type", labels, ("part", "rest", "whole"))


def sanction_disbursement(df: DataFrame) -> DataFrame:
    labels = ("Sanctioned", "Disbursed", "Undrawn")
    order = ("whole", "part", "rest")
    return _part_of_whole(df, "disbursed_amount", "sanction_amount", "Amount Type", labels, order)


def field_fill(df: DataFrame, names: list[str], blank=is_blank_raw) -> tuple[DataFrame, list[list[Column]]]:
    """One aggregate row with present counts, and per field the (present, missing, rows) columns."""
    present = [F.count_if(~blank(ref(c))).alias(f"p{i}") for i, c in enumerate(names)]
    one_row = df.agg(F.count("*").alias("rows"), *present)
    return one_row, [[F.col(f"p{i}"), F.col("rows") - F.col(f"p{i}"), F.col("rows")] for i in range(len(names))]


def missing_rates(df: DataFrame, names: list[str]) -> DataFrame:
    """Column, Present, Missing and Percent Missing, worst first; empty for an empty table."""
    if not names:
        raise NotAvailable("No columns found")
    one_row, fills = field_fill(df, names)
    rows = [
        [F.lit(c.replace("_", " ").title()), present, missing, percent(missing, n)]
        for c, (present, missing, n) in zip(names, fills)
    ]
    table = unpivot(one_row.filter("rows > 0"), rows, ["Column", "Present", "Missing", "Percent Missing"])
    return table.orderBy(*desc("Percent Missing"), *asc("Column"))


def data_quality_ead(df: DataFrame) -> DataFrame:
    return missing_rates(df, [c for c in QUALITY_COLUMNS if c in df.columns])


# key -> title, in reading order
REPORTS = {
    "ucid_lan": "UCID to LAN Count",
    "state_ead": "State-wise EAD (Last Month)",
    "disbursement": "Disbursements in Audit Period",
    "product_ead": "Product-wise EAD (Last Month)",
    "product_stage_dpd": "Product x Stage x DPD",
    "pivot": "Master Pivot Report",
    "stage_summary": "Stage Summary",
    "dpd_summary": "DPD Bucket Summary",
    "security": "Secured vs Unsecured",
    "writeoff": "Write-Off Summary",
    "sbu": "SBU - SubSBU Breakdown",
    "provision_check": "Provision Reasonableness",
    "negative_check": "Negative Values Check",
    "stage_mismatch": "Stage-DPD Mismatch",
    "fvtpl": "FVTPL Split",
    "portfolio_concentration": "Portfolio Concentration",
    "stage_distribution": "Stage Distribution",
    "dpd_risk_distribution": "DPD-Risk Distribution",
    "collateral_coverage": "Collateral Coverage",
    "provision_coverage": "Provision Coverage",
    "writeoff_recovery": "Write-off & Recovery",
    "sanction_disbursement": "Sanction vs Disbursement",
    "data_quality_ead": "Data Quality Summary",
}


def report(df: DataFrame, key: str, **options) -> DataFrame:
    """One report by key; raises NotAvailable when its columns are absent."""
    if key not in REPORTS:
        raise KeyError(key)
    return grouped_report(df, key, **options) if key in GROUPINGS else globals()[key](df, **options)


def run_exposure_reports(
    df: DataFrame,
    keys: list[str] | None = None,
    period_from: str | None = None,
    period_to: str | None = None,
) -> dict[str, ReportResult]:
    """All selected reports over one frame: the group-by ones and those on single loans from one pass each that is made here, the others as lazy plans."""
    chosen = [k for k in REPORTS if keys is None or k in keys]
    results = {}
    sums = cache(lambda: SharedSums(df, [k for k in chosen if k in GROUPINGS]))
    on_loans = [k for k in chosen if k in LOAN_KEYS or k == "portfolio_concentration"]
    loans = cache(lambda: SharedLoans(df, on_loans))
    for key in chosen:
        options = {"period_from": period_from, "period_to": period_to} if key == "disbursement" else {}
        if key in GROUPINGS:
            build = lambda frame, key=key: sums().report(key)
        elif key in on_loans and len(on_loans) > 1 and {"loan_id", "ead", LOAN_KEYS.get(key, "ead")} <= set(df.columns):
            build = lambda frame, key=key: loans().report(key)
        else:
            build = lambda frame, key=key, **o: report(frame, key, **o)
        results[key] = plan_report(key, build, df, **options)
    return results


def summary_stats(df: DataFrame) -> DataFrame:
    """One row: loans, exposure, provision and coverage of the whole book."""
    loans = F.count("loan_id") if "loan_id" in df.columns else F.count("*")
    none = F.lit(None).cast("double")
    one = df.agg(
        loans.alias("total_loans"),
        (total(df, "ead") if "ead" in df.columns else none).alias("total_ead"),
        (total(df, "total_provision") if "total_provision" in df.columns else none).alias("total_provision"),
    )
    cover = F.when(
        (F.col("total_ead") > 0) & (F.col("total_provision") != 0),
        percent(F.col("total_provision"), F.col("total_ead")),
    )
    return one.withColumn("coverage_pct", cover)


def snapshot_months(df: DataFrame, column: str = "business_date") -> DataFrame:
    """Distinct snapshot months as labels such as 'Mar 2001', oldest first."""
    require(df, column)
    raw = strip(text(df, column))
    day = parse_snapshot_date(raw)
    month = F.coalesce(F.date_format(day, "yyyy-MM"), F.substring(raw, 1, 7)).alias("month_key")
    label = F.coalesce(F.date_format(day, "MMM yyyy"), raw).alias("label")
    seen = df.filter(ref(column).isNotNull()).select(month, day.isNotNull().alias("dated"), label)
    best = F.max_by("label", F.struct("dated", "label")).alias("label")
    return seen.groupBy("month_key").agg(best).orderBy("month_key")


def snapshot_dates(df: DataFrame, column: str = "business_date") -> DataFrame:
    require(df, column)
    return df.select(ref(column)).filter(ref(column).isNotNull()).distinct().orderBy(column)


# --- Unit scaling --------------------------------------------------------------------------------

# Divisors of the display units, and how a monetary column is told by its name.
UNITS = {"actual": 1, "lakh": 100_000, "crore": 10_000_000, "million": 1_000_000}
NOT_MONEY_ENDINGS = "_count _pct _id _name _code _bucket _flag _date _month _desc _system".split()
NOT_MONEY_NAMES = "count stage ucid lan_count new_loans dpd_stage_mismatch score ratio".split()
MONEY_WORDS = (
    "ead provision outstanding principal disburse sanction writeoff write_off recovery amount balance"
    " interest premium exposure"
).split()


def is_monetary(name: str) -> bool:
    lowered = name.lower()
    if lowered.endswith(tuple(NOT_MONEY_ENDINGS)) or lowered in NOT_MONEY_NAMES:
        return False
    return re.search("|".join(MONEY_WORDS), lowered) is not None


def scale_units(df: DataFrame, unit: str) -> DataFrame:
    """Divide the numeric monetary columns of a report by the unit; the rest stays."""
    divisor = UNITS[unit]
    scaled = {
        f.name: ref(f.name).cast("double") / F.lit(float(divisor))
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and is_monetary(f.name)
    }
    return df.withColumns(scaled) if scaled else df


def merge_extracts(frames: dict[str, DataFrame]) -> DataFrame:
    """Merge exposure extracts by name, widening types, with the origin in _source_file."""
    merged = None
    widest: dict[str, set] = {}
    for frame in frames.values():
        for f in frame.schema.fields:
            widest.setdefault(f.name, set()).add(f.dataType)
    for origin, frame in frames.items():
        casts = []
        for f in frame.schema.fields:
            kinds = widest[f.name]
            if len(kinds) == 1:
                casts.append(ref(f.name))
            elif all(isinstance(k, T.NumericType) for k in kinds):
                casts.append(ref(f.name).cast("double").alias(f.name))
            else:
                casts.append(ref(f.name).cast("string").alias(f.name))
        tagged = frame.select(*casts, F.lit(origin).alias("_source_file"))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    if merged is None:
        raise NotAvailable("no exposure extracts given")
    return merged
