"""Exception tables and the audit tables that are counted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.documents import mask_sensitive
from ledgerlens.functions.severity import (
    CATEGORY_AUDIT,
    MISSING_LABELS,
    severity_name,
    severity_rank,
)
from ledgerlens.functions.values import is_blank_raw, percent, ref, share, text, unpivot
from ledgerlens.operators.ordering import number_rows
from ledgerlens.plans.engine import CATEGORIES, category_of, describe_rules
from ledgerlens.plans.exposure import field_fill
from ledgerlens.plans.report import NotAvailable, asc, desc, require

STATUSES = ("OK", "WARN", "ERROR")
WIDE_COLUMNS = ("overall_status", "exception_count", "exception_codes", "exception_descriptions")


def wide_exceptions(checked: DataFrame) -> DataFrame:
    """One row per input row: worst status, number of findings, and their codes and texts joined by |."""
    fired = F.col("exceptions")
    status = (
        F.when(F.exists(fired, lambda e: e["status"] == "ERROR"), "ERROR")
        .when(F.exists(fired, lambda e: e["status"] == "WARN"), "WARN")
        .otherwise("OK")
    )
    coded = F.filter(fired, lambda e: e["code"] != "")
    texts = F.filter(F.transform(fired, lambda e: e["desc"]), lambda d: d != "")
    wide = checked.withColumns(
        {
            "overall_status": status,
            "exception_count": F.size(coded),
            "exception_codes": F.array_join(F.transform(coded, lambda e: e["code"]), "|"),
            "exception_descriptions": F.array_join(texts, "|"),
        }
    )
    return mask_sensitive(wide.drop("exceptions"))


def long_exceptions(checked: DataFrame) -> DataFrame:
    """One row per finding."""
    row_num = F.col("_row_num") if "_row_num" in checked.columns else F.lit(None).cast("long")
    fired = checked.select(
        row_num.alias("_row_num"), text(checked, "customer_id").alias("customer_id") if "customer_id" not in checked.columns
        else F.col("customer_id").cast("string").alias("customer_id"),
        F.explode_outer("exceptions").alias("e"),  # no filter on the array is inferred below it
    ).filter(F.col("e").isNotNull())
    return fired.select(
        "_row_num", "customer_id", F.col("e.rule_id").alias("rule_id"), F.col("e.status").alias("status"),
        F.col("e.code").alias("exception_code"), F.col("e.desc").alias("exception_description"),
    )


def flat_annotations(checked: DataFrame, rule_ids) -> DataFrame:
    """Three columns per rule (_exc_<rule>_status, _code, _desc) in place of the array."""
    columns = {}
    by_rule = F.map_from_entries(F.transform("exceptions", lambda e: F.struct(e["rule_id"], e)))
    work = checked.withColumn("__by_rule", by_rule)
    for r in rule_ids:
        hit = F.try_element_at(F.col("__by_rule"), F.lit(r))
        columns[f"_exc_{r}_status"] = F.coalesce(hit["status"], F.lit("OK"))
        columns[f"_exc_{r}_code"] = F.coalesce(hit["code"], F.lit(""))
        columns[f"_exc_{r}_desc"] = F.coalesce(hit["desc"], F.lit(""))
    return work.withColumns(columns).drop("__by_rule", "exceptions")


def status_counts(wide: DataFrame) -> DataFrame:
    counts = wide.agg(*[F.count_if(F.col("overall_status") == s).alias(s) for s in STATUSES])
    return unpivot(counts, [[F.lit(s), F.col(s)] for s in STATUSES], ["status", "count"])


def exception_codes(wide: DataFrame, top_n: int | None = 10) -> DataFrame:
    """Frequency of each code in the joined code column, most frequent first."""
    code = F.explode(F.split("exception_codes", r"\|")).alias("exception_code")
    counts = (
        wide.select(code).select(F.trim("exception_code").alias("exception_code"))
        .filter("exception_code <> ''").groupBy("exception_code").agg(F.count("*").alias("count"))
        .orderBy(*desc("count"), *asc("exception_code"))
    )
    return counts if top_n is None else counts.limit(top_n)


def duplicate_breakdown(wide: DataFrame) -> DataFrame:
    return exception_codes(wide, None).filter(F.contains("exception_code", F.lit("DUPLICATE")))


def exception_summary(wide: DataFrame, top_n: int = 10) -> DataFrame:
    """Status counts, the total and the top codes in one (section, name, count) table."""
    status = status_counts(wide).select(F.lit("status").alias("section"), F.col("status").alias("name"), "count")
    total = wide.agg(F.count("*").alias("count")).select(F.lit("total"), F.lit("rows"), "count")
    codes = exception_codes(wide, top_n).select(F.lit("code"), "exception_code", "count")
    return status.union(total).union(codes)


def missing_summary(long: DataFrame, total_rows: int | DataFrame) -> DataFrame:
    """Missing-field findings by code with their share of all rows, one decimal."""
    whole = total_rows.agg(F.count("*")).scalar() if isinstance(total_rows, DataFrame) else F.lit(total_rows)
    label = F.create_map(*[F.lit(v) for pair in MISSING_LABELS.items() for v in pair])
    counts = (
        long.filter(F.col("exception_code").isin(*MISSING_LABELS))
        .groupBy(F.col("exception_code").alias("code"))
        .agg(F.count("*").alias("count"))
    )
    return counts.select(
        label[F.col("code")].alias("field"), "code", "count", share(F.col("count"), whole, 1).alias("pct")
    ).orderBy(*desc("count"), *asc("code"))


def missing_detail(long: DataFrame) -> DataFrame:
    return long.filter(F.col("exception_code").isin(*MISSING_LABELS)).select(
        "_row_num", "customer_id", "exception_code", "exception_description"
    )


def procedures(long: DataFrame, rule_ids, total_rows: DataFrame) -> DataFrame:
    """Each rule of the run with its audit texts, findings, share of rows and worst code severity."""
    categories, texts = category_of(), describe_rules()
    lines = []
    for i, r in enumerate(rule_ids):
        c = categories.get(r)
        objective, assertion, standard = CATEGORY_AUDIT.get(c, (None, None, None))
        lines.append((i + 1, r, texts[r], CATEGORIES[c][0] if c else None, objective, assertion, standard))
    schema = (
        "position int, rule_id string, description string, category string, objective string,"
        " assertion string, standard string"
    )
    rules = long.sparkSession.createDataFrame(lines, schema)
    seen = long.filter("status <> 'OK'").groupBy("rule_id").agg(
        F.count("*").alias("exceptions"), F.min(severity_rank(F.col("exception_code"))).alias("rank")
    )
    whole = total_rows.agg(F.count("*")).scalar()
    count = F.coalesce("exceptions", F.lit(0))
    return (
        rules.join(seen, "rule_id", "left")
        .select(
            "position", "rule_id", "description", "category", "objective", "assertion", "standard",
            F.coalesce(severity_name(F.col("rank")), F.lit("-")).alias("severity"),
            count.alias("exceptions"),
            share(count, whole).alias("exception_pct"),
        )
        .orderBy("position")
    )


def control_mapping(rule_ids) -> list[tuple]:
    """Category label, objective, assertion and standard of the categories a run touches."""
    used = {category_of().get(r) for r in rule_ids}
    return [(CATEGORIES[c][0], *CATEGORY_AUDIT[c]) for c in CATEGORIES if c in used]


def reconciliation(ingested: DataFrame, wide: DataFrame) -> DataFrame:
    """Rows ingested and analysed, status percentages and the exception rate on one line."""
    counts = wide.agg(
        F.count("*").alias("analysed"),
        *[F.count_if(F.col("overall_status") == s).alias(f"{s.lower()}_rows") for s in STATUSES],
    ).withColumn("ingested", ingested.agg(F.count("*")).scalar())
    exceptions = F.col("analysed") - F.col("ok_rows")
    return counts.select(
        "ingested", "analysed", (F.col("ingested") - F.col("analysed")).alias("difference"),
        *[F.col(f"{s.lower()}_rows") for s in STATUSES],
        *[share(F.col(f"{s.lower()}_rows"), F.col("analysed"), 1).alias(f"{s.lower()}_pct") for s in STATUSES],
        exceptions.alias("exception_rows"), share(exceptions, F.col("analysed"), 1).alias("exception_pct"),
    )


def detailed_exceptions(wide: DataFrame, max_rows: int | None = None) -> DataFrame:
    """All rows that are not OK (or the first max_rows), masked and numbered in order."""
    rows = mask_sensitive(wide.filter("overall_status <> 'OK'")).orderBy("_row_num")
    if max_rows is None:
        return number_rows(rows, "Ref #").select(F.col("Ref #").cast("int").alias("Ref #"), *[ref(c) for c in rows.columns])
    first = rows.limit(max_rows)
    numbered = F.row_number().over(Window.orderBy("_row_num"))  # over max_rows rows
    return first.select(numbered.alias("Ref #"), *[ref(c) for c in first.columns])


def control_tests(sample: DataFrame, wide: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Sampled rows (or the first max_rows) with their customer, loan and the control each one tests."""
    level, codes = F.col("criticality"), F.col("exception_codes")
    doubled = codes.contains("DUP")
    gaps = codes.contains("MISSING") | codes.contains("INCOMPLETE")
    first = sample if max_rows is None else sample.orderBy("sample_no").limit(max_rows)
    who = wide.select(
        "_row_num", *[text(wide, c).alias(c) for c in ("customer_id", "full_name", "lan")]
    )
    return first.join(who, "_row_num", "left").select(
        F.col("sample_no").alias("Sample#"),
        F.col("customer_id").alias("Customer_ID"),
        F.col("full_name").alias("Full_Name"),
        F.col("lan").alias("LAN"),
        F.col("_row_num").alias("Row_Num"),
        level.alias("Criticality"),
        F.col("selection_reason").alias("Selection_Reason"),
        F.when(level == "CRITICAL", "No duplicate / fraudulent customers")
        .when(level == "HIGH", "KYC data integrity")
        .otherwise("Data quality controls").alias("Control_Objective"),
        F.when(doubled, "Existence").when(gaps, "Completeness").otherwise("Accuracy").alias("Assertion"),
        F.when(doubled, "Duplicate checking")
        .when(level == "CRITICAL", "Identity fraud indicators")
        .otherwise("Data format & completeness").alias("Attribute_Tested"),
    ).orderBy("Sample#")


def field_completeness(wide: DataFrame) -> DataFrame:
    """Present and missing (NULL) values of every data column, worst first."""
    names = [
        c for c in wide.columns
        if not c.startswith(("_exc_", "exception_")) and c not in (*WIDE_COLUMNS, "exceptions")
    ]
    if not names:
        raise NotAvailable("No columns found")
    one_row, fills = field_fill(wide, names, blank=lambda c: c.isNull())
    rows = [
        [F.lit(c), present, missing, percent(missing, n)] for c, (present, missing, n) in zip(names, fills)
    ]
    table = unpivot(one_row.filter("rows > 0"), rows, ["Field", "Present", "Missing", "% Missing"])
    return table.orderBy(*desc("% Missing"), *asc("Field"))


def lorenz_points(wide: DataFrame) -> DataFrame:
    """Breakpoints of the concentration curve: rows with k findings, most first, and the running share.

    Rows are grouped by their number of findings before the running sum, so the window
    sees at most one line per rule; between breakpoints the curve is straight.
    """
    require(wide, "overall_status", "exception_count")
    n = F.col("exception_count").try_cast("long")
    groups = (
        wide.filter((F.col("overall_status") != "OK") & (n > 0))
        .groupBy(n.alias("findings")).agg(F.count("*").alias("rows"))
        .withColumn("amount", F.col("findings") * F.col("rows"))
    )
    upto = Window.orderBy(F.desc("findings")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return groups.select(
        "findings", "rows", F.sum("rows").over(upto).alias("rows_upto"),
        percent(F.sum("amount").over(upto), F.sum("amount").over(everything), 4).alias("cumulative_pct"),
    ).orderBy(F.desc("findings"))


def field_coverage(df: DataFrame) -> DataFrame:
    """Share of rows that have each of the six main identity fields."""
    names = [c for c in ("pan", "aadhaar", "mobile", "email", "dob", "voter_id") if c in df.columns]
    if not names:
        raise NotAvailable("no identity fields available")
    one_row, fills = field_fill(df, names, blank=is_blank_raw)
    rows = [[F.lit(c.upper()), share(p, n)] for c, (p, _, n) in zip(names, fills)]
    return unpivot(one_row, rows, ["field", "coverage_pct"])
