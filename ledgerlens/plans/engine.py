"""Rule selection and the single plan that runs the chosen rules over a table."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.values import ref
from ledgerlens.operators.ordering import number_rows
from ledgerlens.operators.skew import HOT_ROWS
from ledgerlens.plans.addresses import AddressBook
from ledgerlens.plans.duplicates import ADDRESS_RULE, DUPLICATE_RULES, address_findings, duplicate_findings
from ledgerlens.plans.identity import beneficiary_columns, single_name, ucid_columns, unique_customers
from ledgerlens.plans.row_rules import FINDING, PIN_RULES, ROW_RULES, Fields, no_findings, row_findings, with_pin_lookup
from ledgerlens.session import materialize, scratch

# Category -> (label, rules); users select by these names.
CATEGORIES = {
    "missing_data": (
        "Missing Data",
        "pan_missing aadhaar_missing voter_id_missing mobile_missing email_missing dob_missing pin_missing"
        " address_completeness".split(),
    ),
    "kyc_format": (
        "KYC & Document Format",
        "pan_format aadhaar_format voter_id_format passport_format dl_format mobile_format email_format"
        " dob_validity dob_age_range bank_account_invalid_length email_company_generic_domain".split(),
    ),
    "address_pin": ("Address & PIN", "pincode_exists state_pin_match district_pin_match".split()),
    "duplicates": ("Duplicate Detection", [*DUPLICATE_RULES, ADDRESS_RULE[0]]),
    "identity_grouping": ("Identity Grouping (UCID + Beneficiary)", ["ucid", "beneficiary_tagging"]),
}

# Order of findings within a row; ucid comes first because the duplicate rules read it.
RULE_ORDER = (
    "ucid bank_account_invalid_length beneficiary_tagging pan_duplicate aadhaar_duplicate mobile_duplicate"
    " bank_account_duplicate name_dob_duplicate voter_id_duplicate address_duplicate"
    " email_company_generic_domain pan_format aadhaar_format voter_id_format passport_format dl_format"
    " mobile_format email_format dob_validity dob_age_range pan_missing aadhaar_missing voter_id_missing"
    " mobile_missing email_missing dob_missing pin_missing pincode_exists state_pin_match"
    " district_pin_match address_completeness"
).split()

# Columns that keep their numeric type when a table is turned to text.
NUMERIC_COLUMNS = (
    "loan_amount outstanding_principal emi_amount age sanctioned_amount disbursed_amount outstanding_balance"
).split()


@dataclass
class UserRule:
    rule_id: str
    description: str
    build: Callable
    whole_table: bool = False


_USER_RULES: dict[str, UserRule] = {}


def register_rule(rule_id: str, description: str, build: Callable[[Fields], Column]) -> None:
    """Add a rule: a function of the row's fields giving a finding struct, or NULL when it passes."""
    if rule_id in RULE_ORDER or rule_id in _USER_RULES:
        raise ValueError(f"rule {rule_id!r} exists already")
    _USER_RULES[rule_id] = UserRule(rule_id, description, build)


def register_table_rule(rule_id: str, description: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Add a rule over the whole table: from the rows to (_row_num, finding), one line per row that fails."""
    if rule_id in RULE_ORDER or rule_id in _USER_RULES:
        raise ValueError(f"rule {rule_id!r} exists already")
    _USER_RULES[rule_id] = UserRule(rule_id, description, build, whole_table=True)


def unregister_rule(rule_id: str) -> None:
    _USER_RULES.pop(rule_id, None)


def describe_rules() -> dict[str, str]:
    texts = {
        "ucid": "rows of one person are grouped and agree in their documents",
        "beneficiary_tagging": "every row gets a customer key and a beneficiary group",
        ADDRESS_RULE[0]: ADDRESS_RULE[2],
        **{r: d for r, (d, _) in ROW_RULES.items()},
        **{r: d for r, (_, _, d, _) in DUPLICATE_RULES.items()},
        **{r.rule_id: r.description for r in _USER_RULES.values()},
    }
    return {r: texts[r] for r in [*RULE_ORDER, *_USER_RULES]}


def category_of() -> dict[str, str]:
    return {r: c for c, (_, rules) in CATEGORIES.items() for r in rules}


def select_rules(rules=None, categories=None, disabled=()) -> list[str]:
    """Rules in running order: the union of both selections (all when neither is given) less the disabled."""
    known = [*RULE_ORDER, *_USER_RULES]
    wanted = set(rules or ())
    for c in categories or ():
        if c not in CATEGORIES:
            raise ValueError(f"unknown category {c!r}")
        wanted |= set(CATEGORIES[c][1])
    unknown = wanted - set(known)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    if not rules and not categories:
        wanted = set(known)
    chosen = [r for r in known if r in wanted and r not in set(disabled)]
    if not chosen:
        raise ValueError("no rules selected")
    return chosen


def coerce_text(df: DataFrame) -> DataFrame:
    """Numeric columns as text, except amounts, ages and the row number."""
    keep = {*NUMERIC_COLUMNS, "_row_num", "ucid_size"}
    return df.select(
        *[
            ref(f.name).cast("string").alias(f.name)
            if isinstance(f.dataType, T.NumericType) and f.name not in keep
            else ref(f.name)
            for f in df.schema.fields
        ]
    )


def _one(finding: Column) -> Column:
    return F.when(finding.isNull(), no_findings()).otherwise(F.array(finding))


def run_rules(df: DataFrame, salt: str, *args, progress: Callable[[str], None] | None = None, **options) -> DataFrame:
    """Every row with an `exceptions` array of the findings of the selected rules, written once; see _run_rules for the options.

    Tables that were written on the way are deleted. `progress` is told each step as it begins.
    """
    with scratch() as keep:
        return keep(_run_rules(df, salt, *args, progress=progress or (lambda step: None), **options))


def _run_rules(
    df: DataFrame,
    salt: str,
    rules=None,
    categories=None,
    disabled=(),
    pin_master: DataFrame | None = None,
    as_of: datetime.date | None = None,
    scope: str = "person",
    heavy_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    id_by: str = "position",
    *,
    progress: Callable[[str], None],
) -> DataFrame:
    """Every row with its findings.

    Row rules are columns of one select. Cross-row rules work on narrow key tables and
    come back through one join on the row number. With `ucid` selected the result also
    has ucid and ucid_size, with `beneficiary_tagging` customer_key and group_id.
    """
    chosen = select_rules(rules, categories, disabled)
    base = coerce_text(df)
    if "_row_num" not in base.columns:
        base = number_rows(base)
    table = base
    parts: list[tuple[str, Column]] = []  # (rule the part is placed at, array of findings)

    addresses = None
    progress("addresses")
    if "address_line1" in base.columns and ("ucid" in chosen or ADDRESS_RULE[0] in chosen):
        addresses = AddressBook(base, heavy_rows, hot_rows)
    if "ucid" in chosen:
        progress("ucid")
        grouped = materialize(unique_customers(base, salt, addresses, hot_rows, id_by=id_by), "ucids")  # read twice below
        table = ucid_columns(table, grouped, single_name(base, salt, id_by))
        parts.append(("ucid", _one(F.col("__ucid_finding"))))
    if "beneficiary_tagging" in chosen:
        table = beneficiary_columns(table, salt)

    findings = None
    exact = [r for r in DUPLICATE_RULES if r in chosen]
    if exact:
        progress("duplicates")
        findings = duplicate_findings(table, exact, salt, scope, hot_rows)
    if ADDRESS_RULE[0] in chosen and addresses is not None:
        near = address_findings(addresses.duplicate_rows())
        findings = near if findings is None else findings.unionByName(near)
    for r in [u for u in _USER_RULES.values() if u.whole_table and u.rule_id in chosen]:
        own = r.build(table).select("_row_num", F.col("finding").cast(FINDING).alias("finding")).filter("finding IS NOT NULL")
        own = own.withColumn("finding", F.col("finding").withField("rule_id", F.lit(r.rule_id)))
        findings = own if findings is None else findings.unionByName(own)
    if findings is not None:
        place = {r: i for i, r in enumerate([*DUPLICATE_RULES, ADDRESS_RULE[0], *_USER_RULES])}
        spot = F.create_map(*[F.lit(v) for pair in place.items() for v in pair])
        listed = F.array_sort(F.collect_list(F.struct(spot[F.col("finding.rule_id")].alias("at"), "finding")))
        per_row = findings.groupBy("_row_num").agg(listed["finding"].alias("__shared_findings"))
        table = table.join(per_row, "_row_num", "left")
        parts.append(("pan_duplicate", F.coalesce("__shared_findings", no_findings())))

    if any(r in PIN_RULES for r in chosen):
        table = with_pin_lookup(table, pin_master)
    fields = Fields(table, as_of)
    order = {r: i for i, r in enumerate([*RULE_ORDER, *_USER_RULES])}
    cuts = [order["bank_account_invalid_length"], order["email_company_generic_domain"]]
    early = [r for r in chosen if r in ROW_RULES and order[r] <= cuts[0]]
    late = [r for r in chosen if r in ROW_RULES and order[r] >= cuts[1]]
    if early:
        parts.append((early[0], row_findings(fields, early)))
    if late:
        parts.append((late[0], row_findings(fields, late)))
    for r in _USER_RULES.values():
        if r.rule_id in chosen and not r.whole_table:
            parts.append((r.rule_id, _one(r.build(fields))))

    progress("rows")
    parts.sort(key=lambda p: order[p[0]])
    exceptions = F.concat(no_findings(), *[p[1] for p in parts])
    return materialize(Fields.unstage(fields.table.withColumn("exceptions", exceptions)), "checked")
