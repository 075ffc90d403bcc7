"""Customer-master summaries and compliance screens."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.values import (
    amount,
    distinct_with_null,
    is_blank_raw,
    percent,
    ref,
    rounded,
    share,
    strip,
    text,
    unpivot,
)
from ledgerlens.plans.duplicates import ADDRESS_RULE, DUPLICATE_RULES
from ledgerlens.plans.exposure import field_fill, missing_rates
from ledgerlens.plans.report import NotAvailable, ReportResult, asc, desc, plan_report, require

KYC_FIELDS = "pan aadhaar voter_id passport driving_licence mobile email dob".split()
MASTER_FIELDS = (
    "customer_id full_name dob gender mobile email pan aadhaar voter_id passport driving_licence"
    " address_line1 address_line2 city district state pincode bank_account ifsc lan"
).split()


def _customers(df: DataFrame, title: str, otherwise: str | None = None):
    """Distinct customers (NULL is one more), or rows where the table has no customer_id."""
    if "customer_id" in df.columns:
        return distinct_with_null(F.col("customer_id")).alias(title)
    return F.count("*").alias(otherwise or title)


def geographic_distribution(df: DataFrame) -> DataFrame:
    require(df, "state")
    keys = [c for c in ("state", "district") if c in df.columns]
    placed = df.filter(F.col("state").isNotNull())
    return placed.groupBy(*keys).agg(_customers(df, "Customer Count", "Record Count")).orderBy(*asc(*keys))


def kyc_completeness(df: DataFrame) -> DataFrame:
    names = [c for c in KYC_FIELDS if c in df.columns]
    if not names:
        raise NotAvailable("No ID fields found")
    one_row, fills = field_fill(df, names)
    rows = [
        [F.lit(c.replace("_", " ").title()), p, m, percent(p, n)] for c, (p, m, n) in zip(names, fills)
    ]
    return unpivot(one_row.filter("rows > 0"), rows, ["Field", "Present", "Missing", "Percent Present"])


def demographic_distribution(df: DataFrame, as_of: datetime.date | None = None) -> DataFrame:
    """Age bands by gender; ages are days over 365 from dd-mm-yyyy births only, 0 to 120."""
    require(df, "dob")
    today = F.lit(as_of) if as_of else F.current_date()
    raw = ref("dob").cast("string")
    born = F.when(raw.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(raw, "dd-MM-yyyy"))
    age = F.floor(F.datediff(today, born) / 365)
    band = (
        F.when(age < 26, "18-25").when(age < 36, "26-35").when(age < 51, "36-50").when(age < 66, "51-65")
        .otherwise("65+")
    )
    aged = df.filter(age.between(0, 120)).withColumn("age_bucket", band)
    keys = [c for c in ("age_bucket", "gender") if c in aged.columns]
    return aged.groupBy(*keys).agg(_customers(df, "Count")).orderBy(*asc(*keys))


def duplication_summary(df: DataFrame) -> DataFrame:
    """ERROR findings per duplicate rule from a long exception table, zeros for any other table."""
    rules = [*DUPLICATE_RULES, ADDRESS_RULE[0]]
    if "rule_id" not in df.columns:
        counts, titles = [F.lit(0).cast("long").alias(r) for r in rules], rules
        one_row = df.limit(0).agg(F.count("*").alias("__none")).select(*counts)
    else:
        hit = F.col("status") == "ERROR"
        one_row = df.agg(*[F.count_if(hit & (F.col("rule_id") == r)).alias(r) for r in rules])
        titles = [r.replace("_", " ").title() for r in rules]
    return unpivot(one_row, [[F.lit(t), F.col(r)] for r, t in zip(rules, titles)], ["Duplicate Type", "Count"])


def coapplicant_overlap(df: DataFrame) -> DataFrame:
    """Rows whose co-applicant mobile is some applicant's mobile, against the rest.

    Both sides are counted per number before they meet, so a number on a third of the
    rows is one line in the join.
    """
    require(df, "mobile", "coapplicant_mobile")
    applicants = df.select(ref("mobile").cast("string").alias("number")).filter("number is not null").distinct()
    named = (
        df.groupBy(ref("coapplicant_mobile").cast("string").alias("number"))
        .agg(F.count("*").alias("rows"))
    )
    known = applicants.withColumn("known", F.lit(True))
    sums = named.join(known, "number", "left").agg(
        F.coalesce(F.sum(F.when(F.col("known"), F.col("rows"))), F.lit(0)).alias("hit"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("all"),
    )
    rows = [
        [F.lit("Co-applicant mobile matches"), F.col("hit")],
        [F.lit("No match"), F.col("all") - F.col("hit")],
    ]
    return unpivot(sums, rows, ["Overlap Status", "Count"])


def cluster_distribution(df: DataFrame) -> DataFrame:
    """Customers by size band of their UCID group, with the total of all bands on each line."""
    require(df, "ucid_size")
    size = amount(df, "ucid_size")
    band = F.when(size <= 1, "1 (Solo)").when(size <= 5, "2-5").when(size <= 10, "6-10").otherwise("10+")
    bands = (
        df.filter(size.isNotNull()).groupBy(band.alias("cluster_size_band"))
        .agg(_customers(df, "Customers in Band"))
    )
    total = F.sum("Customers in Band").over(Window.partitionBy())  # over at most four lines
    return bands.withColumn("Total Customers", total).orderBy("cluster_size_band")


def data_quality_summary(df: DataFrame) -> DataFrame:
    return missing_rates(df, [c for c in MASTER_FIELDS if c in df.columns])


def lan_concentration(df: DataFrame, top_n: int = 10) -> DataFrame:
    require(df, "lan", "customer_id")
    keys = [c for c in ("customer_id", "ucid") if c in df.columns]
    order = [*desc("Distinct LANs"), *asc(*keys)]
    largest = df.groupBy(*keys).agg(distinct_with_null(F.col("lan")).alias("Distinct LANs")).orderBy(*order).limit(top_n)
    place = F.row_number().over(Window.orderBy(*order)).alias("Rank")  # over top_n lines
    return largest.select(place, "customer_id", "Distinct LANs", *keys[1:])


# --- Compliance and fraud screens ----------------------------------------------------------------


def aadhaar_coverage(df: DataFrame) -> DataFrame:
    require(df, "aadhaar")
    one_row, [(present, missing, rows)] = field_fill(df, ["aadhaar"])
    covered = percent(present, rows)
    lines = [
        [F.lit("Present"), present, covered],
        [F.lit("Missing"), missing, rounded(F.lit(100.0) - percent(present, rows, 10), 2)],
        [F.lit("Total"), rows, F.lit(100.0)],
    ]
    return unpivot(one_row.filter("rows > 0"), lines, ["Coverage Status", "Count", "Percent"])


def _customer_flags(df: DataFrame, tests: dict, title: str) -> DataFrame:
    """One line per test with the customers it hits and their share of all customers.

    Rows are folded to one line per customer first; NULL is a customer of its own.
    Tests that hit nobody are left out.
    """
    per_customer = df.groupBy("customer_id").agg(*[c.alias(f"t{i}") for i, c in enumerate(tests.values())])
    counts = per_customer.agg(
        F.count("*").alias("all"), *[F.count_if(f"t{i}").alias(f"n{i}") for i in range(len(tests))]
    )
    rows = [
        [F.lit(name), F.col(f"n{i}"), share(F.col(f"n{i}"), F.col("all"))] for i, name in enumerate(tests)
    ]
    return unpivot(counts, rows, [title, "Customer Count", "Percent"]).filter(F.col("Customer Count") > 0)


def fraud_risk_flags(df: DataFrame) -> DataFrame:
    require(df, "customer_id")
    tests = {}
    for column, label in (("pan", "PAN"), ("aadhaar", "Aadhaar"), ("mobile", "Mobile")):
        if column in df.columns:
            tests[f"Missing {label}"] = F.bool_or(is_blank_raw(ref(column)))
    several = {}
    if "mobile" in df.columns and "ucid" in df.columns:
        several["Multiple Mobiles per Customer"] = "mobile"
    if "email" in df.columns:
        several["Multiple Emails per Customer"] = "email"
    for title, column in several.items():
        # two different values exist exactly when the smallest and largest differ
        tests[title] = F.coalesce(F.min(ref(column)) != F.max(ref(column)), F.lit(False))
    if not tests:
        raise NotAvailable("no identity columns available")
    return _customer_flags(df, tests, "Risk Category")


def coapplicant_concentration(df: DataFrame) -> DataFrame:
    """Co-applicants behind more than one customer; their numbers stay out of the result."""
    require(df, "coapplicant_mobile", "customer_id", "lan")
    return (
        df.filter(~is_blank_raw(ref("coapplicant_mobile")))
        .groupBy("coapplicant_mobile")
        .agg(
            distinct_with_null(F.col("customer_id")).alias("Primary_Applicants"),
            distinct_with_null(F.col("lan")).alias("Loan_Count"),
        )
        .filter(F.col("Primary_Applicants") > 1)
        .select(F.lit("Multiple Primary Links").alias("Concentration Type"), "Primary_Applicants", "Loan_Count")
        .orderBy(*desc("Loan_Count", "Primary_Applicants"))
    )


# Eleven characters, four letters, a zero and six letters or digits; earlier reports asked for nine
IFSC, NINE_CHARACTER_IFSC = "^[A-Z]{4}0[A-Z0-9]{6}$", "^[A-Z]{4}0[A-Z0-9]{4}$"


def bank_account_anomalies(df: DataFrame, ifsc_pattern: str = IFSC) -> DataFrame:
    """Customers with an account number or branch code of the wrong form."""
    require(df, "bank_account", "customer_id")
    length = F.length(ref("bank_account").cast("string"))
    tests = {"Invalid Account Length": F.coalesce(F.bool_or((length < 9) | (length > 18)), F.lit(False))}
    if "ifsc" in df.columns:
        ifsc = F.upper(ref("ifsc").cast("string"))
        tests["Invalid IFSC Format"] = F.coalesce(F.bool_or(~ifsc.rlike(ifsc_pattern)), F.lit(False))
        if "state" in df.columns:
            state = F.upper(ref("state").cast("string"))
            apart = F.substring(ifsc, 5, 2) != F.substring(state, 1, 2)
            tests["IFSC State Mismatch"] = F.coalesce(F.bool_or(apart), F.lit(False))
    return _customer_flags(df, tests, "Anomaly Type")


REPORTS = {
    "geographic_distribution": geographic_distribution,
    "kyc_completeness": kyc_completeness,
    "demographic_distribution": demographic_distribution,
    "duplication_summary": duplication_summary,
    "coapplicant_overlap": coapplicant_overlap,
    "cluster_distribution": cluster_distribution,
    "data_quality_summary": data_quality_summary,
    "lan_concentration": lan_concentration,
    "aadhaar_coverage": aadhaar_coverage,
    "fraud_risk_flags": fraud_risk_flags,
    "coapplicant_concentration": coapplicant_concentration,
    "bank_account_anomalies": bank_account_anomalies,
}


def run_customer_reports(df: DataFrame, keys=None, as_of=None) -> dict[str, ReportResult]:
    chosen = [k for k in REPORTS if keys is None or k in keys]
    return {
        k: plan_report(k, REPORTS[k], df, **({"as_of": as_of} if k == "demographic_distribution" else {}))
        for k in chosen
    }
