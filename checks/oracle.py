"""The same questions in plain SQL for the second engine, over the tables as they are given."""

from __future__ import annotations

from checks import fixed_values as fixed
from checks.views import view_sql
from ledgerlens.plans import engine, exposure, row_rules, sampling

AS_OF = "DATE '2024-12-31'"
SALT = "audit-salt"
LONGER_LINE = "BEHIND THE RAILWAY STATION NEAR BANYAN TREE SECOND CROSS"
BLOCK_ROWS = 5
ENGAGEMENT, RUN = "eng", "run"


MASTER_COLUMNS = (
    "customer_id full_name dob gender mobile email pan aadhaar voter_id passport driving_licence address_line1 city district state pincode"
    " bank_account ifsc lan coapplicant_mobile income branch_code dsa_code onboarding_date"
).split()


def _with(names: list[str], body: str, recursive: bool = False) -> str:
    """Prefix the derived views a query reads."""
    views = ",\n".join(f"{n} AS ({view_sql(n)})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{'' if body.lstrip().startswith(',') else chr(10)}{body}"


def _pct(part: str, whole: str, digits: int = 2) -> str:
    return (
        f"CAST(round(CAST(CAST(100.0 AS DOUBLE) * ({part}) / nullif(({whole}), 0) AS DECIMAL(38,10)), {digits})"
        " AS DOUBLE)"
    )


def _round(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _sum(column: str) -> str:
    return f"coalesce(CAST(sum({column}) AS DOUBLE), CAST(0 AS DOUBLE))"


def _distinct(column: str) -> str:
    return f"(count(DISTINCT {column}) + CAST(coalesce(max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT))"


# --- Exposure reports ----------------------------------------------------------------------------

HIGH = "regexp_matches(lower(coalesce({0}, '')), '" + fixed.HIGH_DPD + "')"
CLOSED = "regexp_matches(lower(coalesce({0}, '')), '" + fixed.CLOSED + "')"
LATEST = "(SELECT * FROM exposure WHERE business_date = (SELECT max(business_date) FROM exposure))"


def _grouped(source: str, keys: dict[str, str], measures: dict[str, str], extra: str = "") -> str:
    names = ", ".join(f'{k} AS "{t}"' for k, t in keys.items())
    values = ", ".join(f'{v} AS "{t}"' for t, v in measures.items())
    inner = f"SELECT {names}, {values} FROM {source} GROUP BY {', '.join(keys)}"
    return f"SELECT *{', ' + extra if extra else ''} FROM ({inner}) g"


def _exposure() -> dict[str, str]:
    loans, ead, prov = "count(loan_id)", _sum("ead"), _sum("total_provision")
    cover = _pct('"Total Provision"', '"Total EAD"') + ' AS "Coverage %"'
    product = {"scheme_id": "Product ID", "scheme_name": "Product Name"}
    q = {
        "ucid_lan": _grouped(LATEST, {"ucid": "UCID"}, {"LAN Count": loans, "Total EAD": ead, "Total Provision": prov}),
        "state_ead": _grouped(
            LATEST, {"state": "State"}, {"Loan Count": loans, "Total EAD": ead, "Total Provision": prov}, cover
        ),
        "disbursement": _grouped(
            "(SELECT *, substr(disbursement_date, 1, 7) AS m FROM exposure"
            " WHERE disbursement_date BETWEEN '1996-04-01' AND '1997-03-31')",
            {"m": "Disbursement Month", **product, "state": "State"},
            {"New Loans": loans, "Total Disbursed": _sum("disbursed_amount"), "Total Sanctioned": _sum("sanction_amount")},
        ),
        "product_ead": _grouped(
            LATEST, product,
            {"Loan Count": loans, "Total EAD": ead, "Total Provision": prov,
             "Outstanding Principal": _sum("outstanding_principal")},
            cover,
        ),
        "product_stage_dpd": _grouped(
            LATEST, {**product, "stage": "Stage", "dpd_bucket": "DPD Bucket"},
            {"Loan Count": loans, "Total EAD": ead, "Total Provision": prov},
            HIGH.format('"DPD Bucket"') + """ AND trim("Stage") = '1' AS "DPD-Stage Mismatch\"""",
        ),
        "stage_summary": _grouped(
            "exposure", {"stage": "stage"},
            {"Total EAD": ead, "Total Provision": prov, "Provision as per Policy": _sum("existing_provision"),
             "Additional Provision": _sum("additional_provision"), "Loan Count": loans},
            cover,
        ),
        "dpd_summary": _grouped(
            "exposure", {"dpd_bucket": "DPD Bucket"},
            {"Loan Count": loans, "Total EAD": ead, "Outstanding Principal": _sum("outstanding_principal"),
             "Total Provision": prov},
        ),
        "security": _grouped(
            "exposure", {"stage": "Stage"},
            {"Covered (Secured)": _sum("covered_portion"), "Uncovered (Unsecured)": _sum("uncovered_portion"),
             "Total EAD": ead},
            _pct('"Covered (Secured)"', '"Total EAD"') + ' AS "Security Coverage %"',
        ),
        "writeoff": _grouped(
            "exposure", {"written_off": "written_off", "stage": "stage"},
            {"Total EAD": ead, "Total Provision": prov, "Loan Count": loans},
        ),
        "sbu": _grouped(
            "exposure", {"sbu": "SBU", "sub_sbu": "Sub-SBU"},
            {"Total EAD": ead, "Total Provision": prov, "Loan Count": loans},
        ),
        "fvtpl": _grouped(
            "exposure", {"FVTPL": "FVTPL"}, {"Total EAD": ead, "Total Provision": prov, "Loan Count": loans}
        ),
    }
    columns = (
        "loan_id scheme_id scheme_name sbu sub_sbu state loan_status stage dpd_bucket disbursement_date business_date"
        " ead outstanding_principal sanction_amount disbursed_amount collateral_value covered_portion"
        " uncovered_portion existing_provision additional_provision total_provision written_off FVTPL ucid"
    ).split()
    dims = [d for d in fixed.PIVOT_DIMENSIONS if d in columns]
    measures = {
        t: "count(loan_id)" if c == "loan_id" else _sum(c)
        for c, t in fixed.PIVOT_MEASURES.items() if c in columns
    }
    q["pivot"] = _grouped("exposure", {d: d for d in dims}, measures)
    ratio = _round("CAST(additional_provision AS DOUBLE) / CAST(existing_provision AS DOUBLE)", 4)
    q["provision_check"] = f"""
SELECT loan_id AS "Loan ID", stage AS "Stage", dpd_bucket AS "DPD Bucket", ead AS "EAD",
 additional_provision AS "Additional Provision", CAST(existing_provision AS DOUBLE) AS "Policy Provision",
 r AS "Ratio (Addl/Policy)", r > 2 * (SELECT median(r) FROM p) AS "Outlier Flag" FROM p"""
    q["provision_check"] = (
        f", p AS (SELECT *, CASE WHEN existing_provision > 0 THEN {ratio} END AS r FROM exposure"
        f" WHERE additional_provision > 0)" + q["provision_check"]
    )
    q["negative_check"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "Column", count(*) AS "Total Rows", count(*) FILTER ({c} < 0) AS "Negative Count",
 count(*) FILTER ({c} IS NULL) AS "Null Count", count(*) FILTER ({c} < 0) > 0 AS "Has Issue" FROM exposure"""
        for c in fixed.SIGNED_COLUMNS if c in columns
    )
    q["stage_mismatch"] = f"""
SELECT loan_id AS "Loan ID", stage AS "Stage", dpd_bucket AS "DPD Bucket", loan_status AS "Loan Status", ead AS "EAD"
FROM exposure WHERE ({HIGH.format('dpd_bucket')} AND trim(stage) = '1')
 OR ({CLOSED.format('loan_status')} AND trim(stage) IN ('2', '3'))"""
    q["portfolio_concentration"] = f"""
SELECT CAST(row_number() OVER (ORDER BY e DESC, loan_id) AS INTEGER) AS "Rank", loan_id, e AS "Total EAD", n AS "Loan Count"
FROM (SELECT loan_id, {ead} AS e, {loans} AS n FROM exposure GROUP BY loan_id) ORDER BY e DESC, loan_id LIMIT 10"""
    for key, column in (("stage_distribution", "stage"), ("dpd_risk_distribution", "dpd_bucket"),
                        ("writeoff_recovery", "written_off")):
        q[key] = f'SELECT {column}, {_distinct("loan_id")} AS "Loan Count", {ead} AS "Total EAD" FROM exposure GROUP BY {column}'
    parts = {
        "collateral_coverage": ("collateral_value", "ead", "Coverage Type", "Covered", "Uncovered", "Total"),
        "provision_coverage": ("total_provision", "ead", "Coverage Type", "Provided", "Uncovered", "Total Exposure"),
        "sanction_disbursement": ("disbursed_amount", "sanction_amount", "Amount Type", "Disbursed", "Undrawn", "Sanctioned"),
    }
    for key, (part, whole, title, a, b, c) in parts.items():
        q[key] = f"""
, s AS (SELECT {_sum(part)} AS p, {_sum(whole)} AS w FROM exposure)
SELECT '{a}' AS "{title}", p AS "Amount", {_pct('p', 'w')} AS "Percent" FROM s
UNION ALL SELECT '{b}', w - p, {_round('100.0 - ' + _pct('p', 'w', 10), 2)} FROM s
UNION ALL SELECT '{c}', w, CAST(100 AS DOUBLE) FROM s"""
    q["data_quality_ead"] = _fill("exposure", [c for c in fixed.QUALITY_COLUMNS if c in columns])
    q["stats"] = f"""
SELECT {loans} AS total_loans, {ead} AS total_ead, {prov} AS total_provision,
 {_pct(prov, ead)} AS coverage_pct FROM exposure"""
    q["months"] = """
SELECT DISTINCT substr(business_date, 1, 7) AS month_key, strftime(CAST(business_date AS DATE), '%b %Y') AS label FROM exposure"""
    q["dates"] = "SELECT DISTINCT business_date FROM exposure"
    q["scaled"] = _grouped(
        LATEST, {"state": "State"},
        {"Loan Count": loans, "Total EAD": f"{ead} / 100000.0", "Total Provision": f"{prov} / 100000.0"},
        cover,
    )
    q["merged"] = f"""
SELECT _source_file, stage, {loans} AS loans, {ead} AS "Total EAD" FROM (
 SELECT *, 'feb' AS _source_file FROM exposure WHERE business_date = '2001-02-28'
 UNION ALL SELECT *, 'mar' FROM exposure WHERE business_date = '2001-03-31') GROUP BY _source_file, stage"""
    return {f"ead_{k}": _with(["exposure"], v) for k, v in q.items()}


def _fill(table: str, names: list[str]) -> str:
    """Present, missing and percent missing of text or numeric columns."""
    return " UNION ALL ".join(
        f"""SELECT '{c.replace('_', ' ').title()}' AS "Column", count(*) FILTER (length(CAST({c} AS VARCHAR)) > 0) AS "Present",
 count(*) - count(*) FILTER (length(CAST({c} AS VARCHAR)) > 0) AS "Missing",
 {_pct(f"count(*) - count(*) FILTER (length(CAST({c} AS VARCHAR)) > 0)", "count(*)")} AS "Percent Missing" FROM {table}"""
        for c in names
    )


# --- Row rules -----------------------------------------------------------------------------------


def _t(column: str) -> str:
    return f"trim(coalesce({column}, ''))"


def _check_digit(digits: str) -> str:
    """The dihedral check, unrolled over list literals."""
    product, powers = row_rules.doc._PRODUCT, row_rules.doc._POWERS
    value = "0"
    for i in range(12):
        digit = f"TRY_CAST(substr({digits}, {12 - i}, 1) AS INTEGER)"
        value = f"({product})[({value}) * 10 + ({powers})[{10 * (i % 8) + 1} + {digit}] + 1]"
    return value


def _rules() -> dict[str, list[tuple[str, str, str, str]]]:
    """rule -> [(condition, status, code, description)], the first match counts."""
    pan = f"upper({_t('pan')})"
    aadhaar = f"replace(replace({_t('aadhaar')}, ' ', ''), '-', '')"
    voter, passport = f"upper({_t('voter_id')})", f"upper({_t('passport')})"
    licence = f"replace(replace(upper({_t('driving_licence')}), '-', ''), ' ', '')"
    bare = f"replace(replace({_t('mobile')}, ' ', ''), '-', '')"
    mobile = f"regexp_replace({bare}, '^\\+91', '')"
    email, dob, pin, account = _t("email"), _t("dob"), _t("pincode"), _t("bank_account")
    born = (
        f"CAST(coalesce(try_strptime({dob}, '%Y-%m-%d'), try_strptime({dob}, '%d-%m-%Y'), try_strptime({dob}, '%d/%m/%Y'),"
        f" try_strptime({dob}, '%Y/%m/%d'), CASE WHEN length({dob}) = 8 THEN try_strptime({dob}, '%d%m%Y') END) AS DATE)"
    )
    age = (
        f"(year({AS_OF}) - year({born}) - CASE WHEN month({AS_OF}) * 100 + day({AS_OF})"
        f" < month({born}) * 100 + day({born}) THEN 1 ELSE 0 END)"
    )
    digits = f"length(regexp_replace({account}, '[^0-9]', '', 'g'))"
    domain = f"CASE WHEN instr({email}, '@') > 0 THEN substr(lower({email}), instr({email}, '@') + 1) ELSE '' END"
    stated = f"lower({_t('state')})"
    place = "lower(trim(CASE WHEN coalesce(district, '') = '' THEN coalesce(city, '') ELSE district END))"

    def listed(words) -> str:
        return ", ".join(f"'{w}'" for w in words)

    def missing(column, code, label, drop="") -> list:
        value = _t(column)
        for ch in drop:
            value = f"replace({value}, '{ch}', '')"
        return [(f"{value} = ''", "WARN", code, f"'{label} not provided'")]

    gaps = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN {_t(c)} = '' THEN '{c}' END" for c in ("address_line1", "city", "state", "pincode")
    ) + ")"
    return {
        "pan_missing": missing("pan", "PAN_MISSING", "PAN"),
        "aadhaar_missing": missing("aadhaar", "AADHAAR_MISSING", "Aadhaar", " -"),
        "voter_id_missing": missing("voter_id", "VOTER_ID_MISSING", "Voter ID"),
        "mobile_missing": missing("mobile", "MOBILE_MISSING", "Mobile number", " -+"),
        "email_missing": missing("email", "EMAIL_MISSING", "Email"),
        "dob_missing": missing("dob", "DOB_MISSING", "Date of birth"),
        "pin_missing": missing("pincode", "PIN_MISSING", "Pincode"),
        "address_completeness": [
            (f"{gaps} <> ''", "WARN", "ADDRESS_INCOMPLETE", f"'Address fields missing: ' || {gaps}")],
        "pan_format": [
            (f"{pan} <> '' AND NOT regexp_matches({pan}, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$')", "ERROR",
             "PAN_INVALID_FORMAT", f"'PAN ''' || {pan} || ''' does not match AAAAA9999A pattern'"),
            (f"{pan} <> '' AND instr('{fixed.PAN_ENTITIES}', substr({pan}, 4, 1)) = 0", "ERROR",
             "PAN_INVALID_ENTITY_CHAR",
             f"'PAN ''' || {pan} || ''' has unrecognised entity type character ''' || substr({pan}, 4, 1) || ''''"),
        ],
        "aadhaar_format": [
            (f"{aadhaar} <> '' AND NOT regexp_matches({aadhaar}, '^[0-9]{{12}}$')", "ERROR",
             "AADHAAR_INVALID_FORMAT", "'Aadhaar must be exactly 12 digits'"),
            (f"substr({aadhaar}, 1, 1) IN ('0', '1')", "ERROR", "AADHAAR_INVALID_PREFIX",
             "'Aadhaar cannot start with 0 or 1'"),
            (f"{aadhaar} <> '' AND {_check_digit(aadhaar)} <> 0", "ERROR", "AADHAAR_CHECKSUM_FAIL",
             "'Aadhaar Verhoeff checksum validation failed'"),
        ],
        "voter_id_format": [
            (f"{voter} <> '' AND NOT regexp_matches({voter}, '^[A-Z]{{3}}[0-9]{{7}}$')", "ERROR",
             "VOTER_ID_INVALID_FORMAT",
             f"'Voter ID ''' || {voter} || ''' must match pattern AAA9999999 (3 letters + 7 digits)'")],
        "passport_format": [
            (f"{passport} <> '' AND NOT regexp_matches({passport}, '^[A-PR-WY][0-9]{{7}}$')", "ERROR",
             "PASSPORT_INVALID_FORMAT",
             f"'Passport ''' || {passport} || ''' must be 1 letter (A-PR-WY) followed by 7 digits'")],
        "dl_format": [
            (f"{licence} <> '' AND NOT regexp_matches({licence}, '^[A-Z]{{2}}[0-9]{{7,}}$')", "ERROR",
             "DL_INVALID_FORMAT",
             f"'DL ''' || {licence} || ''' does not match expected pattern (SSRRYYYYNNNNNNN)'"),
            (f"{licence} <> '' AND substr({licence}, 1, 2) NOT IN ({listed(fixed.LICENCE_STATES)})", "ERROR",
             "DL_INVALID_STATE_CODE",
             f"'DL ''' || {licence} || ''' has unrecognised state code ''' || substr({licence}, 1, 2) || ''''"),
        ],
        "mobile_format": [
            (f"{mobile} <> '' AND NOT regexp_matches({mobile}, '^[6-9][0-9]{{9}}$')", "ERROR",
             "MOBILE_INVALID_FORMAT", f"'Mobile ''' || {mobile} || ''' must be 10 digits starting with 6-9'")],
        "email_format": [
            (f"{email} <> '' AND NOT regexp_matches({email}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')", "ERROR",
             "EMAIL_INVALID_FORMAT", f"'Email ''' || {email} || ''' is not a valid email address format'")],
        "dob_validity": [
            (f"{dob} <> '' AND {born} IS NULL", "ERROR", "DOB_INVALID_FORMAT",
             f"'DOB ''' || {dob} || ''' could not be parsed; expected YYYY-MM-DD or DD-MM-YYYY'"),
            (f"{born} >= {AS_OF}", "ERROR", "DOB_FUTURE_DATE", f"'DOB ''' || {dob} || ''' is a future date'"),
            (f"{age} > 100", "ERROR", "DOB_AGE_IMPLAUSIBLE",
             f"'DOB ''' || {dob} || ''' implies age ' || {age} || ' years, which is implausible'"),
            (f"{age} < 1", "ERROR", "DOB_AGE_TOO_YOUNG", f"'DOB ''' || {dob} || ''' implies age less than 1 year'"),
        ],
        "dob_age_range": [
            (f"{born} < {AS_OF} AND {age} < 18", "WARN", "DOB_AGE_OUT_OF_RANGE",
             f"'Age ' || {age} || ' years is below 18 (minimum lending age)'"),
            (f"{born} < {AS_OF} AND {age} > 65", "WARN", "DOB_AGE_OUT_OF_RANGE",
             f"'Age ' || {age} || ' years is above 65 (standard retirement age)'"),
        ],
        "bank_account_invalid_length": [
            (f"{account} <> '' AND ({digits} < 9 OR {digits} > 18)", "ERROR", "BANK_ACCOUNT_INVALID_LENGTH",
             f"'Bank account ''' || {account} || ''' has ' || {digits} || ' digits (valid range: 9-18)'")],
        "email_company_generic_domain": [
            (f"({domain}) IN ({listed(fixed.FREE_EMAIL_DOMAINS)})", "WARN", "EMAIL_COMPANY_GENERIC_DOMAIN",
             f"'Company email uses generic domain ''' || ({domain}) || ''' (consider business domain)'")],
        "pincode_exists": [
            (f"{pin} <> '' AND NOT regexp_matches({pin}, '^[0-9]{{6}}$')", "ERROR", "PIN_INVALID_FORMAT",
             f"'Pincode ''' || {pin} || ''' is not a valid 6-digit number'"),
            (f"{pin} <> '' AND m_pin IS NULL", "ERROR", "PIN_NOT_FOUND",
             f"'Pincode ''' || {pin} || ''' not found in India Post master directory'"),
        ],
        "state_pin_match": [
            (f"{stated} <> '' AND m_state <> {stated}", "ERROR", "STATE_PIN_MISMATCH",
             "'Stated state ''' || coalesce(state, '') || ''' does not match India Post master state ''' || m_state"
             f" || ''' for PIN ''' || {pin} || ''''")],
        "district_pin_match": [
            (f"{place} <> '' AND NOT contains({place}, m_district) AND NOT contains(m_district, {place})", "WARN",
             "DISTRICT_PIN_MISMATCH",
             f"'Stated district/city ''' || {place} || ''' may not match India Post district ''' || m_district"
             f" || ''' for PIN ''' || {pin} || ''''")],
    }


MASTER = """, located AS (
 SELECT c.*, p.pincode AS m_pin, p.state_name AS m_state, p.district AS m_district
 FROM customer_master c LEFT JOIN pin_master p ON p.pincode = trim(coalesce(c.pincode, '')))"""


def _rule_rows(rule: str, cases) -> str:
    """Findings of one rule as (_row_num, customer_id, rule_id, status, exception_code, exception_description)."""

    def case(column: int) -> str:
        quote = "'{}'" if column < 3 else "{}"
        whens = " ".join(f"WHEN {c[0]} THEN " + quote.format(c[column]) for c in cases)
        return f"CASE {whens} END"

    return (
        f"SELECT _row_num, customer_id, '{rule}' AS rule_id, {case(1)} AS status, {case(2)} AS exception_code,"
        f" {case(3)} AS exception_description FROM located WHERE " + " OR ".join(f"({c[0]})" for c in cases)
    )


def _row_rule_queries() -> dict[str, str]:
    rules = _rules()
    q = {}
    for rule, cases in rules.items():
        q[f"rule_{rule}"] = _with(["customer_master", "pin_master"], MASTER + "\n" + _rule_rows(rule, cases))
    return q


def _long_rows(rules: list[str] | None = None) -> str:
    known = _rules()
    ordered = [r for r in engine.RULE_ORDER if r in known and (rules is None or r in rules)]
    return " UNION ALL ".join(
        f"SELECT {i} AS seq, * FROM ({_rule_rows(r, known[r])})" for i, r in enumerate(ordered)
    )


LONG = MASTER + ", long AS (" + "{long}" + ")"
WIDE = """, folded AS (
 SELECT _row_num, max(CASE status WHEN 'ERROR' THEN 2 ELSE 1 END) AS worst, count(*) AS n,
  string_agg(exception_code, '|' ORDER BY seq) AS codes, string_agg(exception_description, '|' ORDER BY seq) AS descs
 FROM long GROUP BY _row_num),
wide AS (
 SELECT c.*, CASE worst WHEN 2 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'OK' END AS overall_status,
  CAST(coalesce(n, 0) AS INTEGER) AS exception_count, coalesce(codes, '') AS exception_codes,
  coalesce(descs, '') AS exception_descriptions
 FROM customer_master c LEFT JOIN folded USING (_row_num))"""


def _severity_case(code: str) -> str:
    whens = " ".join(
        f"WHEN {code} IN ({', '.join(repr(c) for c in fixed.SEVERITY_CODES[s].split())}) THEN {i}"
        for i, s in enumerate(fixed.SEVERITIES[:3])
    )
    return f"CASE {whens} ELSE 3 END"


def _named(rank: str) -> str:
    return "CASE " + rank + " " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(fixed.SEVERITIES)) + " END"


STRATA = (
    ", ranked AS (SELECT _row_num, min(" + _severity_case("exception_code") + ") AS r FROM long GROUP BY _row_num),"
    " strata AS (SELECT w.*, CASE WHEN r IS NULL THEN 'OK' ELSE " + _named("r") + " END AS stratum"
    " FROM wide w LEFT JOIN ranked USING (_row_num))"
)


def _sample_size(pop: str, exc: str) -> str:
    rate = f"(CASE WHEN {pop} > 0 THEN CAST({exc} AS DOUBLE) / {pop} ELSE 0 END)"
    rows = []
    low_pop = None
    for largest, sizes in fixed.SAMPLE_SIZES:
        low = 0.0
        for limit, size in zip(fixed.DEVIATION_BANDS, sizes):
            band = f"{rate} >= {low} AND {rate} < {limit}"
            inside = "" if largest is None else f" AND {pop} <= {largest}"
            above = "" if low_pop is None else f" AND {pop} > {low_pop}"
            rows.append(f"WHEN {band}{inside}{above} THEN {size}")
            low = limit
        low_pop = largest
    return (
        f"least(CAST(CASE {' '.join(rows)} ELSE greatest(20, CAST(floor(sqrt({pop})) AS BIGINT)) END AS BIGINT), {pop})"
    )


def _outputs() -> dict[str, str]:
    base = LONG.format(long=_long_rows()) + WIDE
    views = ["customer_master", "pin_master"]
    labels = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in fixed.MISSING_LABELS.items())
    codes = ", ".join(f"'{c}'" for c in fixed.MISSING_LABELS)
    rules = [r for r in engine.RULE_ORDER if r in _rules()]
    described, category = engine.describe_rules(), engine.category_of()

    def lit(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    procedures = ", ".join(
        f"({i + 1}, {lit(r)}, {lit(described[r])}, {lit(engine.CATEGORIES[category[r]][0])},"
        f" {', '.join(lit(x) for x in fixed.CATEGORY_AUDIT[category[r]])})"
        for i, r in enumerate(rules)
    )
    fields = (
        "_row_num customer_id full_name dob gender mobile email pan aadhaar voter_id passport driving_licence"
        " address_line1 city district state pincode bank_account ifsc lan coapplicant_mobile income branch_code"
        " dsa_code onboarding_date"
    ).split()
    masked = "CASE WHEN length(aadhaar) >= 5 THEN 'XXXXXXXX' || right(aadhaar, 4) ELSE aadhaar END"
    wide_masked = f"SELECT * REPLACE ({masked} AS aadhaar) FROM wide"
    status = "count(*) FILTER (overall_status = '{0}')"
    q = {
        "exc_long": "SELECT _row_num, customer_id, rule_id, status, exception_code, exception_description FROM long",
        "exc_wide": wide_masked,
        "exception_sinks": (
            f"SELECT 'wide' AS part, * FROM ({wide_masked}) UNION ALL BY NAME SELECT 'long' AS part, _row_num, customer_id, rule_id, status,"
            " exception_code, exception_description FROM long"
        ),
        "exc_status": " UNION ALL ".join(
            f"SELECT '{s}' AS status, {status.format(s)} AS count FROM wide" for s in ("OK", "WARN", "ERROR")
        ),
        "exc_codes": "SELECT exception_code, count(*) AS count FROM long GROUP BY ALL ORDER BY count DESC, exception_code LIMIT 10",
        "exc_missing": f"""
SELECT CASE exception_code {labels} END AS field, exception_code AS code, count(*) AS count,
 {_pct('count(*)', '(SELECT count(*) FROM wide)', 1)} AS pct FROM long WHERE exception_code IN ({codes}) GROUP BY exception_code""",
        "missing_detail": f"""
SELECT _row_num, customer_id, exception_code, exception_description FROM long WHERE exception_code IN ({codes})""",
        "exc_summary": f"""
SELECT 'status' AS section, s AS name, n AS count FROM ({' UNION ALL '.join(f"SELECT '{s}' AS s, {status.format(s)} AS n FROM wide" for s in ("OK", "WARN", "ERROR"))})
UNION ALL SELECT 'total', 'rows', count(*) FROM wide
UNION ALL SELECT 'code', * FROM (SELECT exception_code, count(*) AS c FROM long GROUP BY ALL ORDER BY c DESC, exception_code LIMIT 10)""",
        "exc_severity": f"""
SELECT stratum, count(*) AS rows FROM strata GROUP BY stratum""",
        "procedures": f"""
, rules AS (SELECT * FROM (VALUES {procedures}) v(position, rule_id, description, category, objective, assertion, standard)),
seen AS (SELECT rule_id, count(*) AS n, min({_severity_case('exception_code')}) AS r FROM long GROUP BY rule_id)
SELECT CAST(position AS INTEGER) AS position, rule_id, description, category, objective, assertion, standard,
 coalesce({_named('r')}, '-') AS severity, coalesce(n, 0) AS exceptions,
 coalesce({_pct('n', '(SELECT count(*) FROM wide)')}, CAST(0 AS DOUBLE)) AS exception_pct
FROM rules LEFT JOIN seen USING (rule_id)""",
        "reconciliation": f"""
, c AS (SELECT count(*) AS analysed, {', '.join(f"{status.format(s)} AS {s.lower()}" for s in ("OK", "WARN", "ERROR"))} FROM wide)
SELECT (SELECT count(*) FROM customer_master) AS ingested, analysed,
 (SELECT count(*) FROM customer_master) - analysed AS difference, ok AS ok_rows, warn AS warn_rows, error AS error_rows,
 {_pct('ok', 'analysed', 1)} AS ok_pct, {_pct('warn', 'analysed', 1)} AS warn_pct, {_pct('error', 'analysed', 1)} AS error_pct,
 analysed - ok AS exception_rows, {_pct('analysed - ok', 'analysed', 1)} AS exception_pct FROM c""",
        "detailed": f"""
SELECT CAST(row_number() OVER (ORDER BY _row_num) AS INTEGER) AS "Ref #", * FROM ({wide_masked})
WHERE overall_status <> 'OK' ORDER BY _row_num""",
        "completeness": " UNION ALL ".join(
            f"""SELECT '{c}' AS "Field", count({c}) AS "Present", count(*) - count({c}) AS "Missing",
 {_pct(f'count(*) - count({c})', 'count(*)')} AS "% Missing" FROM wide""" for c in fields
        ),
        "lorenz": f"""
, g AS (SELECT CAST(exception_count AS BIGINT) AS findings, count(*) AS rows FROM wide WHERE overall_status <> 'OK' GROUP BY 1)
SELECT findings, rows, CAST(sum(rows) OVER w AS BIGINT) AS rows_upto,
 {_pct('CAST(sum(findings * rows) OVER w AS DOUBLE)', '(SELECT CAST(sum(findings * rows) AS DOUBLE) FROM g)', 4)} AS cumulative_pct
FROM g WINDOW w AS (ORDER BY findings DESC ROWS UNBOUNDED PRECEDING)""",
        "field_coverage": " UNION ALL ".join(
            f"SELECT '{c.upper()}' AS field, {_pct(f'count(*) FILTER (length({c}) > 0)', 'count(*)')} AS coverage_pct FROM customer_master"
            for c in ("pan", "aadhaar", "mobile", "email", "dob", "voter_id")
        ),
        "sample_severity": " UNION ALL ".join(
            f"""SELECT '{s}' AS stratum, count(*) FILTER (stratum = '{s}') AS count,
 {_pct(f"count(*) FILTER (stratum = '{s}')", 'count(*)', 4)} AS percentage FROM strata""" for s in fixed.STRATA
        ),
        "sample_sizes": f"""
, s AS (SELECT branch_code, count(*) AS population, count(*) FILTER (overall_status <> 'OK') AS exceptions FROM wide GROUP BY 1)
SELECT *, {_sample_size('population', 'exceptions')} AS sample_size FROM s""",
    }
    seed = sampling.sample_seed(ENGAGEMENT, RUN)
    order = "CASE stratum " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(fixed.STRATA)) + " END"
    picks = f"""
, facts AS (SELECT count(*) AS n, count(*) FILTER (overall_status <> 'OK') AS x FROM wide),
sized AS (SELECT n, {_sample_size('n', 'x')} AS size FROM facts),
drawn AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS here,
 row_number() OVER (PARTITION BY stratum ORDER BY sha256('{seed}:' || CAST(_row_num AS VARCHAR)), _row_num) AS place FROM strata),
picked AS (SELECT d.* FROM drawn d, sized
 WHERE place <= least(here, greatest(1, CAST(floor(size * (CAST(here AS DOUBLE) / n)) AS BIGINT)))
 ORDER BY {order}, _row_num LIMIT (SELECT size FROM sized)),
sample AS (SELECT CAST(row_number() OVER (ORDER BY {order}, _row_num) AS INTEGER) AS sample_no, * FROM picked)"""
    reason = "stratum || ': ' || CASE WHEN exception_codes = '' THEN 'No specific code' ELSE split_part(exception_codes, '|', 1) END"
    q["sample_selected"] = picks + f"""
SELECT sample_no, _row_num, exception_codes, {reason} AS selection_reason, stratum AS criticality FROM sample"""
    q["control_tests"] = picks + f"""
SELECT sample_no AS "Sample#", coalesce(customer_id, '') AS "Customer_ID", full_name AS "Full_Name", lan AS "LAN", _row_num AS "Row_Num",
 stratum AS "Criticality", {reason} AS "Selection_Reason",
 CASE stratum WHEN 'CRITICAL' THEN 'No duplicate / fraudulent customers' WHEN 'HIGH' THEN 'KYC data integrity'
  ELSE 'Data quality controls' END AS "Control_Objective",
 CASE WHEN contains(exception_codes, 'DUP') THEN 'Existence'
  WHEN contains(exception_codes, 'MISSING') OR contains(exception_codes, 'INCOMPLETE') THEN 'Completeness'
  ELSE 'Accuracy' END AS "Assertion",
 CASE WHEN contains(exception_codes, 'DUP') THEN 'Duplicate checking' WHEN stratum = 'CRITICAL' THEN 'Identity fraud indicators'
  ELSE 'Data format & completeness' END AS "Attribute_Tested" FROM sample"""
    return {k: _with(views, base + STRATA + v) for k, v in q.items()}


# --- Identity and duplicates ---------------------------------------------------------------------

_UP = "upper(trim(coalesce({0}, '')))"
_DIGITS = "replace(replace(trim(coalesce(aadhaar, '')), ' ', ''), '-', '')"
KEYS = {
    "pan": _UP.format("pan"),
    "aadhaar": f"CASE WHEN length({_DIGITS}) = 12 THEN sha256('{SALT}' || {_DIGITS}) ELSE '' END",
    "mobile": "replace(replace(trim(coalesce(mobile, '')), ' ', ''), '-', '')",
    "bank_account": "trim(coalesce(bank_account, ''))",
    "name_dob": "CASE WHEN trim(coalesce(full_name, '')) <> '' AND trim(coalesce(dob, '')) <> ''"
    " THEN upper(trim(full_name)) || '|' || trim(dob) ELSE '' END",
    "voter_id": _UP.format("voter_id"),
}


def _keys(kinds, ucid: str = "''", lan: str = "coalesce(lan, '')") -> str:
    """, keys AS (...) with one line per non-blank key of a row."""
    parts = []
    for k in kinds:
        cid = "customer_id" if k == "pan" else "coalesce(customer_id, '')"
        parts.append(
            f"SELECT _row_num, '{k}' AS kind, {KEYS[k]} AS key, {cid} AS cid, {ucid} AS ucid, {lan} AS lan"
            " FROM customer_master"
        )
    return ", keys AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE key <> '')"


SHARED = """, listed AS (
 SELECT a.*, EXISTS (SELECT 1 FROM keys b WHERE b.kind = a.kind AND b.key = a.key AND b.cid <> a.cid AND b.cid <> '') AS in_list
 FROM keys a),
shared AS (SELECT l.* FROM listed l SEMI JOIN (SELECT kind, key FROM listed WHERE in_list) d ON d.kind = l.kind AND d.key = l.key),
ids AS (SELECT kind, key, list_sort(list(DISTINCT cid)) AS ids FROM shared WHERE cid <> '' GROUP BY ALL)"""
OTHERS = "list_filter(ids, lambda i: i <> coalesce(cid, ''))"
SHOWN = (
    f"array_to_string({OTHERS}[1:5], ', ') || CASE WHEN len({OTHERS}) > 5"
    f" THEN ' and ' || CAST(len({OTHERS}) - 5 AS VARCHAR) || ' more' ELSE '' END"
)


def _duplicate(rule: str) -> str:
    from ledgerlens.plans.duplicates import DUPLICATE_RULES

    kind, code, _, message = DUPLICATE_RULES[rule]
    key = "replace(key, '|', ' / ')" if kind == "name_dob" else "key"
    text = "'" + message.replace("'", "''") + "'"
    args = [SHOWN]
    if kind != "aadhaar":
        args.insert(0, key)
    for a in args:
        text = text.replace("%s", f"' || {a} || '", 1)
    return f"""SELECT _row_num, 'ERROR' AS status, '{code}' AS code, {text} AS "desc"
FROM {{rows}} r JOIN ids USING (kind, key) WHERE kind = '{kind}'"""


# Sharers of a row: other customers' rows with the same key (and group). The loan numbers
# clash when they repeat among the sharers or with the row itself.
SCOPED = """, rows AS (SELECT *, coalesce(cid, '') AS c FROM shared),
clash AS (
 SELECT a.kind, a.key, a._row_num, count(b.c) <> count(DISTINCT b.lan) OR coalesce(bool_or(b.lan = a.lan), false) AS clash
 FROM rows a LEFT JOIN rows b ON b.kind = a.kind AND b.key = a.key AND b.c <> a.c {extra}
 GROUP BY ALL),
spread AS (SELECT kind, key, count(DISTINCT ucid) AS ucids FROM rows GROUP BY ALL),
own AS (SELECT kind, key, ucid, bool_or(in_list) AS any_listed FROM rows GROUP BY ALL)
SELECT r._row_num, r.kind, r.key FROM rows r JOIN clash USING (kind, key, _row_num) JOIN spread USING (kind, key)
JOIN own ON own.kind = r.kind AND own.key = r.key AND own.ucid = r.ucid
WHERE clash OR r.ucid = '' OR {flag}"""

ADDRESS = """, words AS (
 SELECT _row_num, coalesce(customer_id, '') AS cid,
  list_sort(list_distinct(string_split_regex(upper(trim(address_line1)), '\\s+'))) AS tokens
 FROM customer_master WHERE trim(coalesce(address_line1, '')) <> ''),
sets AS (SELECT tokens, min(_row_num) AS first, min(cid) AS low, max(cid) AS high, count(*) AS n FROM words GROUP BY tokens),
long_words AS (SELECT first, unnest(list_filter(tokens, lambda t: length(t) >= 4)) AS w FROM sets),
met AS (SELECT a.first AS a, b.first AS b FROM long_words a JOIN long_words b ON a.w = b.w AND a.first <= b.first
 GROUP BY ALL HAVING count(*) >= 3),
near AS (SELECT a, b FROM met JOIN sets x ON x.first = a JOIN sets y ON y.first = b
 WHERE CAST(len(list_intersect(x.tokens, y.tokens)) AS DOUBLE)
  / (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens))) >= 0.85)"""

COMPONENTS = """, stars AS (
 SELECT k._row_num AS a, min(k._row_num) OVER (PARTITION BY kind, key) AS b FROM keys k),
same AS (SELECT w._row_num AS a, s.first AS b FROM words w JOIN sets s USING (tokens) JOIN near n ON n.a = s.first AND n.b = s.first),
edges AS (SELECT DISTINCT a, b FROM (SELECT * FROM stars UNION ALL SELECT * FROM same UNION ALL SELECT a, b FROM near) WHERE a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, label) AS (
 SELECT a, a FROM both_ways
 UNION
 SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.label < e.b),
member AS (SELECT node, min(label) AS component FROM reach GROUP BY node),
placed AS (SELECT c.*, coalesce(component, _row_num) AS component FROM customer_master c LEFT JOIN member ON node = _row_num),
named AS (SELECT component, count(*) AS n,
 substr(sha256(string_agg(CAST(_row_num - 1 AS VARCHAR), ',' ORDER BY _row_num)), 1, 16) AS ucid FROM placed GROUP BY component)"""


def _differs(column: str) -> str:
    return f"count(DISTINCT nullif({column}, '')) > 1"


KYC = ", kyc AS (SELECT component FROM placed GROUP BY component HAVING count(*) > 1 AND (" + " OR ".join(
    _differs(c) for c in (
        KEYS["pan"], KEYS["aadhaar"], KEYS["voter_id"], "lower(trim(coalesce(email, '')))", KEYS["mobile"],
        "upper(trim(coalesce(state, '')))", "trim(coalesce(pincode, ''))",
    )
) + "))"


def _identity() -> dict[str, str]:
    from ledgerlens.plans.duplicates import ADDRESS_RULE, DUPLICATE_RULES
    from ledgerlens.plans.link_keys import PERSON_KINDS

    cm = ["customer_master"]
    q = {}
    for rule, (kind, *_rest) in DUPLICATE_RULES.items():
        q[f"dup_{rule.removesuffix('_duplicate')}"] = _with(
            cm, _keys([kind]) + SHARED + "\n" + _duplicate(rule).format(rows="shared")
        )
    all_kinds = [k for k, *_ in DUPLICATE_RULES.values()]
    scoped = _keys(all_kinds, "coalesce(branch_code, '')", "onboarding_date") + SHARED
    q["dup_scope_person"] = _with(cm, scoped + SCOPED.format(extra="", flag="ucids > 1"))
    q["dup_scope_observed"] = _with(
        cm, scoped + SCOPED.format(extra="AND b.ucid = a.ucid AND b.in_list", flag="NOT any_listed")
    )
    flagged = """SELECT _row_num FROM words JOIN sets USING (tokens) JOIN (
 SELECT me, min(low) AS l, max(high) AS h FROM (
  SELECT a AS me, b AS other FROM near UNION SELECT b, a FROM near) p JOIN sets o ON o.first = other GROUP BY me) r
 ON r.me = first WHERE l <> h"""
    q["dup_address"] = _with(
        cm, ADDRESS + f"\nSELECT _row_num, 'WARN' AS status, 'ADDRESS_DUPLICATE' AS code, '{ADDRESS_RULE[3]}' AS \"desc\" FROM ({flagged})"
    )
    longer = "CASE WHEN address_line1 LIKE 'FLAT%' THEN address_line1 || ' " + LONGER_LINE + "' ELSE address_line1 END"
    q["dup_address_long"] = _with(
        cm, ADDRESS.replace("upper(trim(address_line1))", f"upper(trim({longer}))", 1)
        + f"\nSELECT _row_num, 'WARN' AS status, 'ADDRESS_DUPLICATE' AS code, '{ADDRESS_RULE[3]}' AS \"desc\" FROM ({flagged})"
    )
    people = _keys(PERSON_KINDS) + ADDRESS + COMPONENTS
    q["ucid"] = _with(
        cm, people + "\nSELECT _row_num, ucid, CAST(n AS INTEGER) AS ucid_size FROM placed JOIN named USING (component)", True
    )
    spelled = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(1))" for c in sorted(MASTER_COLUMNS))
    marks = ", ".join(
        f"CASE WHEN {KEYS[k]} <> '' THEN '0' || sha256(concat_ws('|', '{SALT}', '{k}', {KEYS[k]})) END" for k in PERSON_KINDS)
    q["ucid_key"] = _with(cm, people + f"""
, labelled AS (SELECT component, _row_num, coalesce(least({marks}), '1' || sha256(concat_ws('|', '{SALT}', {spelled}))) AS label FROM placed)
SELECT _row_num, substr(sha256(min(label) OVER g), 1, 16) AS ucid, CAST(count(*) OVER g AS INTEGER) AS ucid_size FROM labelled
WINDOW g AS (PARTITION BY component)""", True)
    q["ucid_blocks"] = _with(cm, people + f"""
, numbered AS (SELECT component, _row_num, (row_number() OVER (PARTITION BY component ORDER BY _row_num) - 1) // {BLOCK_ROWS} AS b FROM placed),
blocks AS (SELECT component, b, substr(sha256(string_agg(CAST(_row_num - 1 AS VARCHAR), ',' ORDER BY _row_num)), 1, 16) AS x FROM numbered GROUP BY ALL),
joined AS (SELECT component, substr(sha256(string_agg(x, ',' ORDER BY b)), 1, 16) AS name FROM blocks GROUP BY component)
SELECT _row_num, name AS ucid, CAST(n AS INTEGER) AS ucid_size FROM placed JOIN named USING (component) JOIN joined USING (component)""", True)
    q["ucid_kyc"] = _with(
        cm, people + KYC + """
SELECT _row_num, 'WARN' AS status, 'UCID_KYC_INCONSISTENT' AS code,
 'UCID ' || ucid || ' has conflicting KYC data (PAN, Aadhaar, Voter ID, email, mobile, state, or pincode)' AS "desc"
FROM placed JOIN named USING (component) SEMI JOIN kyc USING (component)""", True,
    )
    pan, aad, mob, ndb = KEYS["pan"], KEYS["aadhaar"], KEYS["mobile"], KEYS["name_dob"]
    token = "substr(sha256(coalesce(nullif(trim(customer_id), ''), CAST(_row_num AS VARCHAR))), 1, 16)"

    def best(p, a, m) -> str:
        return (
            f"CASE WHEN length({pan}) = 10 THEN 'PAN:' || {p} WHEN {aad} <> '' THEN 'ADH:' || {a}"
            f" WHEN length({mob}) = 10 THEN 'MOB:' || {m} WHEN {ndb} <> '' THEN 'NDB:' || substr(sha256({ndb}), 1, 16)"
            f" ELSE 'UNK:' || {token} END"
        )

    def short(x) -> str:
        return f"substr(sha256({x}), 1, 16)"

    q["beneficiary"] = _with(
        cm, f"""
SELECT _row_num, {best(short(pan), short(aad), short(mob))} AS customer_key,
 'GRP-' || upper(substr(sha256({best(pan, aad, mob)}), 1, 8)) AS group_id FROM customer_master""",
    )
    # all 31 rules together, the duplicates excused inside one person
    scoped_all = (
        people.replace(", keys AS", ", person_keys AS", 1).replace("FROM keys k)", "FROM person_keys k)")
        + KYC + MASTER
        + _keys(all_kinds, "u.ucid").replace(
            "FROM customer_master", "FROM (SELECT * FROM placed) c JOIN (SELECT component, ucid FROM named) u USING (component)")
        + SHARED + ", flagged AS (" + SCOPED.format(extra="", flag="ucids > 1").lstrip().removeprefix(",").strip()
        .replace("rows AS (", "WITH rows AS (", 1) + ")"
    )
    for name, rest in (("person", SCOPED.format(extra="", flag="ucids > 1")),
                       ("observed", SCOPED.format(extra="AND b.ucid = a.ucid AND b.in_list", flag="NOT any_listed"))):
        before = scoped_all[:scoped_all.index(KYC)] + _keys(all_kinds, "u.ucid").replace(
            "FROM customer_master", "FROM (SELECT * FROM placed) c JOIN (SELECT component, ucid FROM named) u USING (component)") + SHARED
        q[f"dup_{name}_ucid"] = _with(cm, before + rest, True)
    dup_rows = " UNION ALL ".join(
        f"SELECT r._row_num, '{rule}' AS rule_id, status, code, \"desc\" FROM ("
        + _duplicate(rule).format(rows="(SELECT s.* FROM shared s SEMI JOIN flagged f ON f._row_num = s._row_num AND f.kind = s.kind)")
        + ") r"
        for rule in DUPLICATE_RULES
    )
    q["audit_long"] = _with(
        ["customer_master", "pin_master"],
        scoped_all + f"""
SELECT _row_num, customer_id, rule_id, status, exception_code, exception_description FROM ({_long_rows()})
UNION ALL SELECT d._row_num, c.customer_id, d.rule_id, d.status, d.code, d."desc" FROM ({dup_rows}) d JOIN customer_master c USING (_row_num)
UNION ALL SELECT _row_num, customer_id, 'address_duplicate', 'WARN', 'ADDRESS_DUPLICATE', '{ADDRESS_RULE[3]}'
 FROM customer_master WHERE _row_num IN ({flagged})
UNION ALL SELECT _row_num, customer_id, 'ucid', 'WARN', 'UCID_KYC_INCONSISTENT',
 'UCID ' || ucid || ' has conflicting KYC data (PAN, Aadhaar, Voter ID, email, mobile, state, or pincode)'
FROM placed JOIN named USING (component) SEMI JOIN kyc USING (component)""",
        True,
    )
    bands = "CASE WHEN n <= 1 THEN '1 (Solo)' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' ELSE '10+' END"
    q["cm_cluster_distribution"] = _with(
        cm, people + f"""
, b AS (SELECT {bands} AS cluster_size_band, {_distinct('customer_id')} AS c FROM placed JOIN named USING (component) GROUP BY 1)
SELECT cluster_size_band, c AS "Customers in Band", CAST((SELECT sum(c) FROM b) AS BIGINT) AS "Total Customers" FROM b""", True,
    )
    return q


# --- Customer and forensic reports ---------------------------------------------------------------


def _name_similarity() -> str:
    """Pairs of profiles of one pincode by the matching-block ratio, whose blocks are found by recursion.

    The longest common part comes first, at its first place in a, then in b; what lies left and right of it is matched in the same way.
    """
    letters = "string_split('abcdefghijklmnopqrstuvwxyz ', '')"
    common = (
        f"list_sum(list_transform({letters}, lambda c: least(length(x.name) - length(replace(x.name, c, '')),"
        " length(y.name) - length(replace(y.name, c, '')))))"
    )

    def best(alo: str, ahi: str, blo: str, bhi: str) -> str:
        part = f"substr(b, {blo}, {bhi} - {blo})"
        return (
            f"list_max(flatten([[{{'k': k, 'i': -i, 'j': {blo} + instr({part}, substr(a, i, k)) - 1}}"
            f" for i in range({alo}, {ahi} - k + 1) if contains({part}, substr(a, i, k))]"
            f" for k in range(1, least({ahi} - {alo}, {bhi} - {blo}) + 1)]))"
        )

    return f"""
, lines AS (
 SELECT CASE WHEN trim(coalesce(pincode, '')) = '' THEN '_ALL_' ELSE trim(pincode) END AS block, trim(coalesce(full_name, '')) AS shown,
  trim(regexp_replace(lower(trim(coalesce(full_name, ''))), '[^a-z]+', ' ', 'g')) AS name, trim(coalesce(pan, '')) AS pan, _row_num FROM customer_master),
profiles AS (SELECT block, name, shown, pan, count(*) AS n, min(_row_num) AS pid FROM lines WHERE name <> '' GROUP BY ALL),
names AS (SELECT DISTINCT block, name FROM profiles),
close AS (
 SELECT DISTINCT x.name AS a, y.name AS b FROM names x JOIN names y ON x.block = y.block AND x.name <> y.name
 WHERE 2.0 * {common} / (length(x.name) + length(y.name)) >= 0.92),
found AS (
 SELECT a, b, CAST(1 AS BIGINT) AS alo, length(a) + 1 AS ahi, CAST(1 AS BIGINT) AS blo, length(b) + 1 AS bhi,
  {best("1", "length(a) + 1", "1", "length(b) + 1")} AS m FROM close
 UNION ALL
 SELECT a, b, s.alo, s.ahi, s.blo, s.bhi, {best("s.alo", "s.ahi", "s.blo", "s.bhi")} AS m
 FROM (SELECT a, b, unnest([
   {{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': m.j}},
   {{'alo': -m.i + m.k, 'ahi': ahi, 'blo': m.j + m.k, 'bhi': bhi}}]) AS s FROM found WHERE m IS NOT NULL)
 WHERE s.alo < s.ahi AND s.blo < s.bhi),
ratios AS (SELECT a, b, 2.0 * sum(m.k) / (length(a) + length(b)) AS ratio FROM found WHERE m IS NOT NULL GROUP BY a, b)
SELECT x.shown AS "Name A", y.shown AS "Name B", CAST(round(CAST(ratio AS DECIMAL(20,12)), 3) AS DOUBLE) AS "Similarity",
 CASE WHEN x.block = '_ALL_' THEN '' ELSE x.block END AS "Pincode",
 CAST(len(list_distinct(list_filter([x.pan, y.pan], lambda p: p <> ''))) AS INTEGER) AS "Distinct PAN", x.n * y.n AS "Row Pairs", 'HIGH' AS "Risk"
FROM profiles x JOIN profiles y ON x.block = y.block AND x.pid < y.pid JOIN ratios ON a = x.name AND b = y.name
WHERE ratio >= 0.92 AND NOT (x.pan <> '' AND x.pan = y.pan)"""


def _customer() -> dict[str, str]:
    from ledgerlens.plans.duplicates import ADDRESS_RULE, DUPLICATE_RULES

    columns = (
        "customer_id full_name dob gender mobile email pan aadhaar voter_id passport driving_licence address_line1"
        " city district state pincode bank_account ifsc lan"
    ).split()
    everyone = f"(SELECT {_distinct('customer_id')} FROM customer_master)"

    def blank(c: str) -> str:
        return f"({c} IS NULL OR length({c}) = 0)"

    def flags(title: str, tests: dict[str, str]) -> str:
        lines = " UNION ALL ".join(
            f"SELECT '{t}' AS \"{title}\", {_distinct('customer_id')} AS n FROM customer_master WHERE {c}"
            for t, c in tests.items()
        )
        return f"""SELECT "{title}", n AS "Customer Count", {_pct('n', everyone)} AS "Percent" FROM ({lines}) WHERE n > 0"""

    age = f"(({AS_OF} - CAST(try_strptime(dob, '%d-%m-%Y') AS DATE)) // 365)"
    q = {
        "geographic_distribution": f"""
SELECT state, district, {_distinct('customer_id')} AS "Customer Count" FROM customer_master WHERE state IS NOT NULL GROUP BY ALL""",
        "kyc_completeness": " UNION ALL ".join(
            f"""SELECT '{c.replace('_', ' ').title()}' AS "Field", count(*) FILTER (length({c}) > 0) AS "Present",
 count(*) - count(*) FILTER (length({c}) > 0) AS "Missing", {_pct(f'count(*) FILTER (length({c}) > 0)', 'count(*)')} AS "Percent Present"
FROM customer_master""" for c in fixed.KYC_FIELDS
        ),
        "demographic_distribution": f"""
SELECT CASE WHEN a < 26 THEN '18-25' WHEN a < 36 THEN '26-35' WHEN a < 51 THEN '36-50' WHEN a < 66 THEN '51-65' ELSE '65+' END AS age_bucket,
 gender, {_distinct('customer_id')} AS "Count" FROM (SELECT *, {age} AS a FROM customer_master WHERE regexp_matches(dob, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$'))
WHERE a BETWEEN 0 AND 120 GROUP BY ALL""",
        "duplication_summary": " UNION ALL ".join(
            f"SELECT '{r.replace('_', ' ').title()}' AS \"Duplicate Type\","
            f" (SELECT count(*) FROM (SELECT * FROM keys a WHERE kind = '{(DUPLICATE_RULES.get(r) or ('',))[0]}' AND EXISTS (SELECT 1 FROM hits h WHERE h.kind = a.kind AND h.key = a.key))) AS \"Count\""
            for r in [*DUPLICATE_RULES, ADDRESS_RULE[0]]
        ),
        "coapplicant_overlap": """
, n AS (SELECT count(*) AS hit FROM customer_master WHERE coapplicant_mobile IN (SELECT mobile FROM customer_master WHERE mobile IS NOT NULL))
SELECT 'Co-applicant mobile matches' AS "Overlap Status", hit AS "Count" FROM n
UNION ALL SELECT 'No match', (SELECT count(*) FROM customer_master) - hit FROM n""",
        "data_quality_summary": _fill("customer_master", columns),
        "lan_concentration": f"""
, g AS (SELECT customer_id, {_distinct('lan')} AS n FROM customer_master GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY n DESC, customer_id NULLS FIRST) AS INTEGER) AS "Rank", customer_id, n AS "Distinct LANs"
FROM g ORDER BY n DESC, customer_id NULLS FIRST LIMIT 10""",
        "aadhaar_coverage": f"""
, n AS (SELECT count(*) FILTER (length(aadhaar) > 0) AS p, count(*) AS t FROM customer_master)
SELECT 'Present' AS "Coverage Status", p AS "Count", {_pct('p', 't')} AS "Percent" FROM n
UNION ALL SELECT 'Missing', t - p, {_round('100.0 - ' + _pct('p', 't', 10), 2)} FROM n
UNION ALL SELECT 'Total', t, CAST(100 AS DOUBLE) FROM n""",
        "fraud_risk_flags": flags("Risk Category", {
            "Missing PAN": blank("pan"), "Missing Aadhaar": blank("aadhaar"), "Missing Mobile": blank("mobile"),
            "Multiple Emails per Customer": "customer_id IS NOT DISTINCT FROM (SELECT NULL) AND (SELECT count(DISTINCT email) FROM customer_master WHERE customer_id IS NULL) > 1"
            " OR customer_id IN (SELECT customer_id FROM customer_master GROUP BY 1 HAVING count(DISTINCT email) > 1)",
        }),
        "coapplicant_concentration": f"""
SELECT 'Multiple Primary Links' AS "Concentration Type", p AS "Primary_Applicants", l AS "Loan_Count" FROM (
 SELECT coapplicant_mobile, {_distinct('customer_id')} AS p, {_distinct('lan')} AS l FROM customer_master
 WHERE length(coapplicant_mobile) > 0 GROUP BY 1) WHERE p > 1""",
        "bank_account_anomalies": flags("Anomaly Type", {
            "Invalid Account Length": "length(bank_account) NOT BETWEEN 9 AND 18",
            "Invalid IFSC Format": "NOT regexp_matches(upper(ifsc), '^[A-Z]{4}0[A-Z0-9]{6}$')",
            "IFSC State Mismatch": "substr(upper(ifsc), 5, 2) <> substr(upper(state), 1, 2)",
        }),
    }
    hits = _keys([k for k, *_ in DUPLICATE_RULES.values()]) + """, hits AS (
 SELECT kind, key FROM keys GROUP BY ALL HAVING count(DISTINCT nullif(cid, '')) > 1 OR (count(DISTINCT nullif(cid, '')) = 1 AND count(*) FILTER (cid = '') > 0))"""
    q["duplication_summary"] = hits + "\n" + q["duplication_summary"]

    address = (
        "trim(regexp_replace(lower(concat_ws(' ', nullif(trim(address_line1), ''), nullif(trim(city), ''), nullif(trim(pincode), ''))),"
        " '[^a-z0-9]+', ' ', 'g'))"
    )
    q["address_clustering"] = f"""
SELECT a AS "Address (normalized)", n AS "Distinct Customers", l AS "Loan Accounts",
 CASE WHEN n > 2 THEN 'CRITICAL' ELSE 'HIGH' END AS "Risk" FROM (
 SELECT {address} AS a, count(DISTINCT nullif(trim(customer_id), '')) AS n, count(DISTINCT nullif(trim(lan), '')) AS l
 FROM customer_master GROUP BY 1) WHERE a <> '' AND n > 1"""
    thrown = ", ".join(f"'{d}'" for d in fixed.DISPOSABLE_DOMAINS)
    q["email_domain_anomalies"] = f"""
SELECT d AS "Email Domain", n AS "Distinct Customers",
 CASE WHEN x AND n > 10 THEN 'Disposable + Shared' WHEN x THEN 'Disposable Domain' ELSE 'Shared Domain' END AS "Anomaly Type",
 CASE WHEN x AND n > 10 THEN 'CRITICAL' WHEN x THEN 'HIGH' ELSE 'MEDIUM' END AS "Risk" FROM (
 SELECT trim(substr(lower(email), instr(email, '@') + 1)) AS d, count(DISTINCT nullif(trim(customer_id), '')) AS n,
  trim(substr(lower(email), instr(email, '@') + 1)) IN ({thrown}) AS x
 FROM customer_master WHERE contains(email, '@') GROUP BY ALL) WHERE d <> '' AND (x OR n > 10)"""
    documents = " UNION ALL ".join(
        f"SELECT '{t}' AS doc, _row_num, upper(trim({c})) AS v FROM customer_master WHERE trim(coalesce({c}, '')) <> ''"
        for c, t in fixed.DOCUMENTS.items()
    )
    q["sequential_kyc"] = f"""
, runs AS (SELECT *, regexp_extract_all(v, '[0-9]{{3,}}') AS found FROM ({documents})),
nums AS (SELECT doc, _row_num, v,
 CAST(list_filter(found, lambda x: length(x) = list_max(list_transform(found, lambda y: length(y))))[1] AS BIGINT) AS n
 FROM runs WHERE len(found) > 0),
steps AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY doc ORDER BY n, _row_num) = 1 THEN 0 ELSE 1 END AS fresh FROM nums),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY n, _row_num) AS island FROM steps),
ends AS (SELECT doc, count(*) AS len, arg_min(v, n) AS f, arg_max(v, n) AS l FROM islands GROUP BY doc, island HAVING count(*) >= 3)
SELECT doc AS "Document Type", len AS "Sequence Length",
 CASE WHEN doc = 'Aadhaar' THEN 'XXXXXXXX' || right(f, 4) ELSE f END AS "First Value",
 CASE WHEN doc = 'Aadhaar' THEN 'XXXXXXXX' || right(l, 4) ELSE l END AS "Last Value",
 CASE WHEN len >= 5 THEN 'CRITICAL' ELSE 'HIGH' END AS "Risk" FROM ends"""
    shares = ", ".join(f"({d + 1}, CAST({s} AS DOUBLE))" for d, s in enumerate(fixed.BENFORD_SHARES))
    q["income_benford"] = f"""
, d AS (SELECT CAST(regexp_extract(regexp_replace(income, '[^0-9]', '', 'g'), '^0*([1-9])', 1) AS INTEGER) AS digit
 FROM customer_master WHERE regexp_matches(income, '[1-9]')),
e AS (SELECT * FROM (VALUES {shares}) v(digit, share)),
c AS (SELECT e.digit, share, count(d.digit) AS n FROM e LEFT JOIN d USING (digit) GROUP BY ALL),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(abs(CAST(n AS DOUBLE) / (SELECT sum(n) FROM c) - share)) / 9 AS mad FROM c)
SELECT CAST(digit AS VARCHAR) AS "Digit", {_round('CAST(100.0 AS DOUBLE) * c.n / t.n', 2)} AS "Observed %",
 {_round('share * 100', 2)} AS "Expected %", c.n AS "Count" FROM c, t
UNION ALL SELECT 'MAD', {_round('mad', 5)}, CAST({fixed.BENFORD_ACCEPTABLE} AS DOUBLE), n FROM t
UNION ALL SELECT CASE WHEN mad <= {fixed.BENFORD_CLOSE} THEN 'Close conformity' WHEN mad <= {fixed.BENFORD_ACCEPTABLE}
 THEN 'Acceptable conformity' WHEN mad <= {fixed.BENFORD_MARGINAL} THEN 'Marginally acceptable'
 ELSE 'NON-CONFORMITY (investigate)' END, NULL, NULL, NULL FROM t"""
    blanks = " + ".join(
        f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 1 ELSE 0 END" for c in ("pan", "aadhaar", "mobile", "address_line1", "pincode")
    )
    q["kyc_by_branch"] = f"""
, s AS (SELECT coalesce(branch_code, '(blank)') AS seg, count(*) AS n, sum({blanks}) AS b FROM customer_master GROUP BY 1),
w AS (SELECT CAST(sum(b) AS DOUBLE) / (sum(n) * 5) AS p FROM s)
SELECT seg AS "Segment", n AS "Records", {_round('100.0 * (CAST(b AS DOUBLE) / (n * 5))', 2)} AS "Avg KYC Null %",
 {_round('100.0 * p', 2)} AS "Portfolio Avg %",
 CASE WHEN CAST(b AS DOUBLE) / (n * 5) > 2 * p THEN 'FLAG (>2x avg)' ELSE '' END AS "Flag" FROM s, w"""
    q["onboarding_velocity"] = f"""
, d AS (SELECT coalesce(branch_code, '(blank)') AS seg, onboarding_date AS day, count(*) AS n FROM customer_master GROUP BY ALL),
s AS (SELECT seg, avg(n) AS m, stddev_pop(n) AS sd FROM d GROUP BY seg)
SELECT seg AS "Segment", day AS "Date", n AS "New Customers", {_round('m', 2)} AS "Segment Mean",
 {_round('m + 3 * sd', 2)} AS "Threshold", 'HIGH' AS "Risk"
FROM d JOIN s USING (seg) WHERE n > m + 3 * sd AND n >= 3 ORDER BY n DESC, seg, day"""
    return {f"cm_{k}": _with(["customer_master"], v) for k, v in q.items()} | {
        "cm_name_similarity": _with(["customer_master"], _name_similarity(), True)}


# --- Loan book -----------------------------------------------------------------------------------


def _book() -> dict[str, str]:
    numeric = {c: f"fence_{c}" for c in fixed.OUTLIERS.values()}
    fences = ", ".join(
        f"""{name} AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
 SELECT max(CASE WHEN rn = CAST(floor(0.25 * (n - 1) + 0.5) AS BIGINT) THEN v END) AS q1,
  max(CASE WHEN rn = CAST(floor(0.75 * (n - 1) + 0.5) AS BIGINT) THEN v END) AS q3 FROM (
  SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) - 1 AS rn, count(*) OVER () AS n
  FROM loan_book WHERE {c} IS NOT NULL)))"""
        for c, name in numeric.items()
    )

    def outside(c: str) -> str:
        return f"({c} < (SELECT lo FROM {numeric[c]}) OR {c} > (SELECT hi FROM {numeric[c]}))"

    tests = {
        "DUPLICATE_LAN": "LAN IS NULL OR count(*) OVER (PARTITION BY LAN) > 1",
        "DUPLICATE_CUSTOMER": "CUSTOMER_ID IS NOT NULL AND count(*) OVER (PARTITION BY CUSTOMER_ID) > 1",
        "NULL_MANDATORY_FIELD": "LAN IS NULL OR CUSTOMER_ID IS NULL OR LOAN_DATE IS NULL OR SANCTIONED_AMT IS NULL OR LOAN_STATUS IS NULL",
        "INVALID_SANCTIONED_AMT": "SANCTIONED_AMT IS NULL OR SANCTIONED_AMT <= 0",
        "OUTSTANDING_EXCEEDS_SANCTIONED": "OUTSTANDING_AMT > SANCTIONED_AMT",
        "INVALID_INTEREST_RATE": "INTEREST_RATE IS NULL OR INTEREST_RATE <= 0 OR INTEREST_RATE > 36",
        "INVALID_TENURE": "TENURE_MONTHS IS NULL OR TENURE_MONTHS <= 0",
        "FUTURE_LOAN_DATE": f"CAST(LOAN_DATE AS DATE) > {AS_OF}",
        "IMPLAUSIBLY_OLD_DATE": "CAST(LOAN_DATE AS DATE) < DATE '1990-01-01'",
        "CLOSED_WITH_OUTSTANDING": "LOAN_STATUS = 'Closed' AND OUTSTANDING_AMT > 0",
        "STATUS_DPD_MISMATCH": "LOAN_STATUS IN ('NPA', 'Written-off') AND DPD = 0",
        "KYC_ISSUE": "KYC_STATUS IN ('Missing', 'Expired', 'Pending')",
        **{name: outside(c) for name, c in fixed.OUTLIERS.items()},
    }
    flags = ", ".join(f"CASE WHEN {tests[n]} THEN '{n}' END" for n in fixed.CLASSES)
    day = "(CAST(LOAN_DATE AS DATE) - DATE '1970-01-01')"
    base = f"""
, {fences},
b AS (SELECT *, concat_ws(';', {flags}) AS EXCEPTION_FLAGS FROM loan_book),
span AS (SELECT min({day}) AS lo, max({day}) AS hi FROM loan_book),
book AS (SELECT b.*, 0.25 + 0.75 * (CAST({day} - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE)) AS RECENCY_WEIGHT FROM b, span),
clean AS (SELECT * FROM book WHERE EXCEPTION_FLAGS = ''),
best AS (SELECT *, row_number() OVER (PARTITION BY PRODUCT, LOAN_STATUS, BRANCH ORDER BY RECENCY_WEIGHT DESC, ROW_ID) AS place FROM clean),
strata AS (SELECT ROW_ID, 'STRATA_COVERAGE:' || PRODUCT || '|' || LOAN_STATUS || '|' || BRANCH AS SELECTION_REASON FROM best WHERE place = 1),
pool AS (SELECT ROW_ID, ln((CAST(CAST('0x' || substr(sha256('{fixed.SEED}:' || CAST(ROW_ID AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 1.0)
  / {float(2**52 + 1)!r}) / RECENCY_WEIGHT AS draw FROM clean ANTI JOIN strata USING (ROW_ID))"""
    classes = (
        "DUPLICATE_LAN DUPLICATE_CUSTOMER NULL_MANDATORY_FIELD INVALID_SANCTIONED_AMT OUTSTANDING_EXCEEDS_SANCTIONED INVALID_INTEREST_RATE"
        " INVALID_TENURE FUTURE_LOAN_DATE IMPLAUSIBLY_OLD_DATE CLOSED_WITH_OUTSTANDING STATUS_DPD_MISMATCH KYC_ISSUE OUTLIER_SANCTIONED_AMT"
        " OUTLIER_OUTSTANDING_AMT OUTLIER_INTEREST_RATE"
    ).split()
    # the classes are served in order; each takes its ten newest rows that nobody has taken before
    served = "".join(
        f"""
, before_{i + 1} AS (SELECT * FROM before_{i} UNION ALL SELECT * FROM (
 SELECT ROW_ID, class FROM p WHERE class = '{n}' AND ROW_ID NOT IN (SELECT ROW_ID FROM before_{i}) ORDER BY place LIMIT 10))"""
        for i, n in enumerate(classes)
    )
    sampled = base + f"""
, c AS (SELECT ROW_ID, RECENCY_WEIGHT, unnest(string_split(EXCEPTION_FLAGS, ';')) AS class FROM book WHERE EXCEPTION_FLAGS <> ''),
p AS (SELECT class, ROW_ID, row_number() OVER (PARTITION BY class ORDER BY RECENCY_WEIGHT DESC, ROW_ID) AS place FROM c),
before_0 AS (SELECT ROW_ID, class FROM p WHERE false){served},
wanted AS (SELECT greatest(CAST(floor((SELECT count(*) FROM clean) * 0.005) AS BIGINT), 50) - (SELECT count(*) FROM strata) AS k),
drawn AS (
 SELECT ROW_ID, 'EXCEPTION:' || class AS SELECTION_REASON FROM before_{len(classes)}
 UNION ALL SELECT ROW_ID, SELECTION_REASON FROM strata
 UNION ALL SELECT ROW_ID, 'RANDOM' FROM (SELECT ROW_ID, row_number() OVER (ORDER BY draw DESC, ROW_ID) AS place FROM pool) WHERE place <= (SELECT k FROM wanted))"""
    q = {
        "sample_fences": f"{', ' + fences}\n" + " UNION ALL ".join(
            f"SELECT '{c}' AS measure, lo AS low, hi AS high FROM {name}" for c, name in numeric.items()
        ),
        "sample_quartiles_by_sketch": "\n" + " UNION ALL ".join(
            f"SELECT '{c}' AS measure, CAST({share} AS DOUBLE) AS share, count({c}) AS \"values\", true AS within_error FROM loan_book"
            for c in numeric for share in (0.25, 0.75)
        ),
        "sample_flags": base + """
SELECT ROW_ID, EXCEPTION_FLAGS, CAST(CASE WHEN EXCEPTION_FLAGS = '' THEN 0 ELSE 1 END AS TINYINT) AS IS_EXCEPTION FROM book""",
        "sample_weight": base + "\nSELECT ROW_ID, " + _round("RECENCY_WEIGHT", 8) + " AS RECENCY_WEIGHT FROM book",
        "sample_strata": base + "\nSELECT ROW_ID, SELECTION_REASON FROM strata",
        "sample_random": base + "\nSELECT ROW_ID, 'RANDOM' AS SELECTION_REASON FROM pool ORDER BY draw DESC, ROW_ID LIMIT 200",
        "sample_candidates": base + """
, c AS (SELECT ROW_ID, RECENCY_WEIGHT, unnest(string_split(EXCEPTION_FLAGS, ';')) AS class FROM book WHERE EXCEPTION_FLAGS <> ''),
p AS (SELECT class, ROW_ID, CAST(row_number() OVER (PARTITION BY class ORDER BY RECENCY_WEIGHT DESC, ROW_ID) AS INTEGER) AS place FROM c)
SELECT class, ROW_ID, place FROM p WHERE place <= 160""",
        "sample_book_rows": sampled + """
SELECT ROW_ID, SELECTION_REASON, EXCEPTION_FLAGS FROM drawn JOIN book USING (ROW_ID)""",
        "sample_summary": sampled + f"""
, shared AS ({' UNION ALL '.join(f"SELECT '{n}' AS class, count(*) AS m FROM (SELECT p.ROW_ID FROM p JOIN before_{i} ON before_{i}.ROW_ID = p.ROW_ID WHERE p.class = '{n}')" for i, n in enumerate(classes))})
SELECT 'found' AS figure, class, count(*) AS n FROM c GROUP BY class
UNION ALL SELECT 'sampled', c.class, least(10, count(DISTINCT t.ROW_ID) + any_value(m)) FROM (SELECT DISTINCT class FROM c) c JOIN shared USING (class)
 LEFT JOIN before_{len(classes)} t ON t.class = c.class GROUP BY c.class
UNION ALL SELECT 'population_total', '', count(*) FROM book
UNION ALL SELECT 'clean_records', '', count(*) FROM clean
UNION ALL SELECT 'exceptions_sampled', '', count(*) FROM before_{len(classes)}
UNION ALL SELECT 'strata_covered', '', count(*) FROM strata
UNION ALL SELECT 'random_sampled', '', count(*) FROM drawn WHERE SELECTION_REASON = 'RANDOM'
UNION ALL SELECT 'total_sample_size', '', count(*) FROM drawn""",
    }
    return {k: _with(["loan_book"], v) for k, v in q.items()}


EXPOSURE_COLUMNS = (
    "loan_id scheme_id scheme_name sbu sub_sbu state loan_status stage dpd_bucket disbursement_date business_date ead outstanding_principal"
    " sanction_amount disbursed_amount collateral_value covered_portion uncovered_portion existing_provision additional_provision total_provision"
    " written_off FVTPL ucid"
).split()
EXPOSURE_NUMBERS = EXPOSURE_COLUMNS[11:21]


def _sources() -> dict[str, str]:
    cm, columns = ["customer_master"], MASTER_COLUMNS
    texts = ", ".join(f"nullif({c}, '') AS {c}" for c in columns)
    mask = "CASE WHEN length(aadhaar) >= 5 THEN 'XXXXXXXX' || right(aadhaar, 4) ELSE aadhaar END"
    masked = f"{mask} AS aadhaar"
    return {
        "ingest_roundtrip": _with(cm, f"""
SELECT row_number() OVER (ORDER BY _row_num) AS _row_num, {texts} FROM customer_master"""),
        "ingest_multi_line": _with(cm, """
SELECT row_number() OVER (ORDER BY _row_num) AS _row_num, nullif(customer_id, '') AS customer_id, nullif(full_name, '') AS full_name, nullif(lan, '') AS lan,
 CASE WHEN _row_num % 3 = 0 THEN address_line1 || chr(10) || 'floor "' || _row_num || '"' || chr(10) || chr(10) || 'rear' ELSE nullif(address_line1, '') END
  AS address_line1, nullif(city, '') AS city FROM customer_master"""),
        "normalize_ead": _with(["exposure"], "SELECT " + ", ".join(
            f"CAST({c} AS DOUBLE) AS {c}" if c in EXPOSURE_NUMBERS else c for c in EXPOSURE_COLUMNS) + " FROM exposure"),
        "consolidate": _with(cm, f"""
SELECT CASE _row_num % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS layout, {texts} FROM customer_master
WHERE NOT (_row_num % 3 = 2 AND _row_num % 15 = 2)"""),
        "consolidate_rejects": _with(cm, f"""
SELECT 'c' AS layout, concat({" || ',' || ".join(f"coalesce({c}, '')" for c in columns)}, ',one,two') AS _raw, 'row does not fit the header' AS _reject_reason
FROM customer_master WHERE _row_num % 3 = 2 AND _row_num % 15 = 2"""),
        "null_counts": _with(cm, " UNION ALL ".join([
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM customer_master" for c in ["_row_num", *columns]
        ])),
        "pin_build": _with(["pin_master"], """
SELECT row_number() OVER (ORDER BY CAST(pincode AS BIGINT)) AS _row_num, pincode, district, state_name FROM pin_master WHERE length(pincode) = 6"""),
        "written_parquet": _with(cm, f"SELECT _row_num, {', '.join(masked if c == 'aadhaar' else c for c in columns)} FROM customer_master"),
        "dataset_csv": _with(cm, f"""
SELECT CAST(_row_num AS VARCHAR) AS _row_num, {', '.join(f"nullif({mask if c == 'aadhaar' else c}, '') AS {c}" for c in columns)},
 CAST((SELECT count(*) FROM customer_master) AS INTEGER) AS saved_rows FROM customer_master"""),
        "preview_first": _with(cm, f"""
SELECT CAST(_row_num AS VARCHAR) AS _row_num, {', '.join(masked if c == 'aadhaar' else c for c in columns)} FROM customer_master ORDER BY customer_master._row_num LIMIT 500"""),
        "pin_lookup": _with(["customer_master", "pin_master"], MASTER + """
SELECT _row_num, m_state AS state_name, m_district AS district FROM located WHERE m_pin IS NOT NULL"""),
    }


def _stacked(name: str, parts: dict[str, str]) -> str:
    """The rows of each named text under all their columns."""
    return " UNION ALL BY NAME ".join(f"SELECT '{k}' AS {name}, part.* FROM ({sql}) part" for k, sql in parts.items())


SCREENS = "address_clustering name_similarity email_domain_anomalies sequential_kyc income_benford kyc_by_branch onboarding_velocity".split()


def _runners(texts: dict[str, str]) -> dict[str, str]:
    from ledgerlens.plans.duplicates import DUPLICATE_RULES

    reports = _stacked("report", {k: texts[f"ead_{k}"] for k in exposure.REPORTS})
    codes = " ".join(f"WHEN '{kind}' THEN '{code}'" for kind, code, *_ in DUPLICATE_RULES.values())
    keys = _keys([kind for kind, *_ in DUPLICATE_RULES.values()])
    return {
        "ead_run_all": reports,
        "ead_report_files": reports,
        "screens_run_all": _stacked("screen", {k: texts[f"cm_{k}"] for k in SCREENS}),
        "screens_run_every": " UNION ALL ".join(f"SELECT '{k}' AS screen, count(*) AS rows FROM ({texts[f'cm_{k}']}) part" for k in SCREENS).replace(
            "n > 2 THEN 'CRITICAL'", "n > 10 THEN 'CRITICAL'").replace("a <> '' AND n > 1", "a <> '' AND n > 5"),
        "cm_geographic_merged": texts["cm_geographic_distribution"],
        "duplicate_breakdown": _with(["customer_master"], keys + SHARED + f"""
SELECT CASE kind {codes} END AS exception_code, count(*) AS count FROM shared JOIN ids USING (kind, key) GROUP BY 1"""),
    }


def oracle_sql() -> dict[str, str]:
    texts = {
        **_exposure(), **_row_rule_queries(), **_outputs(), **_identity(), **_customer(), **_book(), **_sources()
    }
    return {**texts, **_runners(texts)}
