"""The 22 rules that look at one row only, as Column expressions over one scan."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import documents as doc
from ledgerlens.functions.values import calendar_age, parse_date, strip, text, without

# Licence state codes, PAN entity characters, free e-mail providers.
LICENCE_STATES = (
    "AP AR AS BR CG GA GJ HR HP JH JK KA KL LA LD MH ML MN MP MZ NL OD PB PY RJ SK TN TS TR UK UP WB"
    " AN CH DD DL DN"
).split()
PAN_ENTITIES = "PFHBCAGLJT"
FREE_EMAIL_DOMAINS = (
    "gmail.com yahoo.com outlook.com hotmail.com aol.com icloud.com mail.com protonmail.com yandex.com"
    " rediffmail.com dataone.in airtelmail.com bsnl.in"
).split()

PIN_STATE, PIN_DISTRICT, PIN_KNOWN = "__pin_state", "__pin_district", "__pin_known"
FINDING = "struct<rule_id:string,status:string,code:string,desc:string>"


def email_domain(address: Column) -> Column:
    """Text after the first @, '' without one."""
    at = F.instr(address, "@")
    return F.when(at > 0, F.substr(address, at + 1)).otherwise("")


class Fields:
    """A frame with every normal form the rules test staged as a column of its own.

    Rules mention a form several times (test, age, message). Staging keeps the rule
    expressions small and each form is computed once per row; unused ones are pruned.
    """

    TEXTS = (
        "pan aadhaar voter_id mobile email dob pincode passport driving_licence bank_account"
        " address_line1 city state"
    ).split()

    def __init__(self, df: DataFrame, as_of: datetime.date | None = None):
        self.source = df
        self.as_of = F.lit(as_of) if as_of else F.current_date()
        stripped = df.withColumns({f"__{c}": strip(text(df, c)) for c in self.TEXTS})
        district = text(df, "district")
        formed = stripped.withColumns(
            {
                "__pan": F.upper("__pan"),
                "__aadhaar": without(F.col("__aadhaar"), " -"),
                "__voter_id": F.upper("__voter_id"),
                "__passport": F.upper("__passport"),
                "__driving_licence": without(F.upper("__driving_licence"), "- "),
                "__phone": F.regexp_replace(without(F.col("__mobile"), " -"), r"^\+91", ""),
                "__born": parse_date(F.col("__dob")),
                "__digits": F.length(F.regexp_replace("__bank_account", "[^0-9]", "")),
                "__domain": email_domain(F.lower("__email")),
                "__stated_state": F.lower("__state"),
                "__stated_place": F.lower(strip(F.when(district == "", text(df, "city")).otherwise(district))),
            }
        )
        self.table = formed.withColumns(
            {
                "__age": calendar_age(F.col("__born"), self.as_of),
                "__aadhaar_number": F.col("__aadhaar").try_cast("bigint"),
            }
        )

    def raw(self, name: str) -> Column:
        return text(self.source, name)

    def get(self, name: str, drop: str = "") -> Column:
        value = F.col(f"__{name}") if name in self.TEXTS else strip(self.raw(name))
        return without(value, drop) if drop else value

    def form(self, name: str) -> Column:
        return F.col(f"__{name}")

    @staticmethod
    def unstage(df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.startswith("__")])


def found(rule_id: str, status: str, code: str, desc: Column | str) -> Column:
    desc = F.lit(desc) if isinstance(desc, str) else desc
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(status).alias("status"),
        F.lit(code).alias("code"),
        desc.alias("desc"),
    )


def say(pattern: str, *parts: Column) -> Column:
    """The pattern with each %s replaced by a column; plain concatenation, which is cheaper than formatting."""
    pieces = pattern.split("%s")
    woven = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        woven += [part, F.lit(piece)]
    return F.concat(*woven)


class _Cases:
    """First matching case wins; the column is an array of that one finding, or empty."""

    def __init__(self, rule_id: str):
        self.rule_id, self.chain = rule_id, None

    def case(self, test: Column, status: str, code: str, desc) -> "_Cases":
        hit = F.array(found(self.rule_id, status, code, desc))
        self.chain = F.when(test, hit) if self.chain is None else self.chain.when(test, hit)
        return self

    def column(self) -> Column:
        return self.chain.otherwise(no_findings())


def no_findings() -> Column:
    return F.expr(f"cast(array() as array<{FINDING}>)")


def _missing(rule_id: str, column: str, label: str, drop: str = "") -> Callable[[Fields], Column]:
    def build(f: Fields) -> Column:
        return (
            _Cases(rule_id)
            .case(f.get(column, drop) == "", "WARN", rule_id.upper(), f"{label} not provided")
            .column()
        )

    return build


def address_completeness(f: Fields) -> Column:
    needed = ("address_line1", "city", "state", "pincode")
    gaps = F.array_compact(F.array(*[F.when(f.get(c) == "", F.lit(c)) for c in needed]))
    listed = F.concat(F.lit("Address fields missing: "), F.array_join(gaps, ", "))
    return _Cases("address_completeness").case(F.size(gaps) > 0, "WARN", "ADDRESS_INCOMPLETE", listed).column()


def pan_format(f: Fields) -> Column:
    pan = f.form("pan")
    entity = F.substring(pan, 4, 1)
    return (
        _Cases("pan_format")
        .case(
            (pan != "") & ~pan.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"),
            "ERROR", "PAN_INVALID_FORMAT", say("PAN '%s' does not match AAAAA9999A pattern", pan),
        )
        .case(
            (pan != "") & ~entity.isin(*PAN_ENTITIES),
            "ERROR", "PAN_INVALID_ENTITY_CHAR",
            say("PAN '%s' has unrecognised entity type character '%s'", pan, entity),
        )
        .column()
    )


def aadhaar_format(f: Fields) -> Column:
    digits = f.form("aadhaar")
    given = digits != ""
    return (
        _Cases("aadhaar_format")
        .case(given & ~digits.rlike("^[0-9]{12}$"), "ERROR", "AADHAAR_INVALID_FORMAT",
              "Aadhaar must be exactly 12 digits")
        .case(given & digits.rlike("^[01]"), "ERROR", "AADHAAR_INVALID_PREFIX",
              "Aadhaar cannot start with 0 or 1")
        .case(given & ~doc.checksum_ok("__aadhaar_number"), "ERROR", "AADHAAR_CHECKSUM_FAIL",
              "Aadhaar Verhoeff checksum validation failed")
        .column()
    )


def _pattern(rule_id, code, pattern, key, message) -> Callable[[Fields], Column]:
    def build(f: Fields) -> Column:
        value = key(f)
        return (
            _Cases(rule_id)
            .case((value != "") & ~value.rlike(pattern), "ERROR", code, say(message, value))
            .column()
        )

    return build


def dl_format(f: Fields) -> Column:
    licence = f.form("driving_licence")
    state = F.substring(licence, 1, 2)
    return (
        _Cases("dl_format")
        .case((licence != "") & ~licence.rlike(r"^[A-Z]{2}\d{2}\d{4}\d+$"), "ERROR", "DL_INVALID_FORMAT",
              say("DL '%s' does not match expected pattern (SSRRYYYYNNNNNNN)", licence))
        .case((licence != "") & ~state.isin(*LICENCE_STATES), "ERROR", "DL_INVALID_STATE_CODE",
              say("DL '%s' has unrecognised state code '%s'", licence, state))
        .column()
    )


def dob_validity(f: Fields) -> Column:
    raw = f.get("dob")
    born, age = f.form("born"), f.form("age")
    given = raw != ""
    return (
        _Cases("dob_validity")
        .case(given & born.isNull(), "ERROR", "DOB_INVALID_FORMAT",
              say("DOB '%s' could not be parsed; expected YYYY-MM-DD or DD-MM-YYYY", raw))
        .case(given & (born >= f.as_of), "ERROR", "DOB_FUTURE_DATE", say("DOB '%s' is a future date", raw))
        .case(given & (age > 100), "ERROR", "DOB_AGE_IMPLAUSIBLE",
              say("DOB '%s' implies age %s years, which is implausible", raw, age.cast("string")))
        .case(given & (age < 1), "ERROR", "DOB_AGE_TOO_YOUNG", say("DOB '%s' implies age less than 1 year", raw))
        .column()
    )


def dob_age_range(f: Fields) -> Column:
    born, age = f.form("born"), f.form("age")
    past = born < f.as_of
    shown = age.cast("string")
    return (
        _Cases("dob_age_range")
        .case(past & (age < 18), "WARN", "DOB_AGE_OUT_OF_RANGE",
              say("Age %s years is below 18 (minimum lending age)", shown))
        .case(past & (age > 65), "WARN", "DOB_AGE_OUT_OF_RANGE",
              say("Age %s years is above 65 (standard retirement age)", shown))
        .column()
    )


def bank_account_invalid_length(f: Fields) -> Column:
    account, digits = f.get("bank_account"), f.form("digits")
    return (
        _Cases("bank_account_invalid_length")
        .case((account != "") & ~digits.between(9, 18), "ERROR", "BANK_ACCOUNT_INVALID_LENGTH",
              say("Bank account '%s' has %s digits (valid range: 9-18)", account, digits.cast("string")))
        .column()
    )


def email_company_generic_domain(f: Fields) -> Column:
    domain = f.form("domain")
    return (
        _Cases("email_company_generic_domain")
        .case(domain.isin(*FREE_EMAIL_DOMAINS), "WARN", "EMAIL_COMPANY_GENERIC_DOMAIN",
              say("Company email uses generic domain '%s' (consider business domain)", domain))
        .column()
    )


def pincode_exists(f: Fields) -> Column:
    pin = f.get("pincode")
    return (
        _Cases("pincode_exists")
        .case((pin != "") & ~pin.rlike(r"^\d{6}$"), "ERROR", "PIN_INVALID_FORMAT",
              say("Pincode '%s' is not a valid 6-digit number", pin))
        .case((pin != "") & F.col(PIN_KNOWN).isNull(), "ERROR", "PIN_NOT_FOUND",
              say("Pincode '%s' not found in India Post master directory", pin))
        .column()
    )


def state_pin_match(f: Fields) -> Column:
    stated = f.form("stated_state")
    master = F.col(PIN_STATE)
    return (
        _Cases("state_pin_match")
        .case((stated != "") & (master != stated), "ERROR", "STATE_PIN_MISMATCH",
              say("Stated state '%s' does not match India Post master state '%s' for PIN '%s'",
                  f.raw("state"), master, f.get("pincode")))
        .column()
    )


def district_pin_match(f: Fields) -> Column:
    stated = f.form("stated_place")
    master = F.col(PIN_DISTRICT)
    apart = ~F.contains(stated, master) & ~F.contains(master, stated)
    return (
        _Cases("district_pin_match")
        .case((stated != "") & apart, "WARN", "DISTRICT_PIN_MISMATCH",
              say("Stated district/city '%s' may not match India Post district '%s' for PIN '%s'",
                  stated, master, f.get("pincode")))
        .column()
    )


# rule id -> (description, column builder). Messages are values that users filter and compare, so they are fixed.
ROW_RULES: dict[str, tuple[str, Callable[[Fields], Column]]] = {
    "pan_missing": ("a PAN is given", _missing("pan_missing", "pan", "PAN")),
    "aadhaar_missing": (
        "an Aadhaar number is given", _missing("aadhaar_missing", "aadhaar", "Aadhaar", " -")),
    "voter_id_missing": ("a voter card number is given", _missing("voter_id_missing", "voter_id", "Voter ID")),
    "mobile_missing": (
        "a phone number is given", _missing("mobile_missing", "mobile", "Mobile number", " -+")),
    "email_missing": ("an email address is given", _missing("email_missing", "email", "Email")),
    "dob_missing": ("a birth date is given", _missing("dob_missing", "dob", "Date of birth")),
    "pin_missing": ("a postal code is given", _missing("pin_missing", "pincode", "Pincode")),
    "address_completeness": (
        "street line, city, state and postal code are all given", address_completeness),
    "pan_format": ("PAN has five letters, four digits and a letter, with a known holder type", pan_format),
    "aadhaar_format": ("Aadhaar has twelve digits and a right check digit", aadhaar_format),
    "voter_id_format": (
        "voter card number has three letters and seven digits",
        _pattern("voter_id_format", "VOTER_ID_INVALID_FORMAT", "^[A-Z]{3}[0-9]{7}$",
                 lambda f: f.form("voter_id"),
                 "Voter ID '%s' must match pattern AAA9999999 (3 letters + 7 digits)")),
    "passport_format": (
        "passport number has a permitted letter and seven digits",
        _pattern("passport_format", "PASSPORT_INVALID_FORMAT", "^[A-PR-WY][0-9]{7}$",
                 lambda f: f.form("passport"),
                 "Passport '%s' must be 1 letter (A-PR-WY) followed by 7 digits")),
    "dl_format": ("licence number has a state, an office, a year and a serial", dl_format),
    "mobile_format": (
        "phone number has ten digits from a mobile range",
        _pattern("mobile_format", "MOBILE_INVALID_FORMAT", r"^[6-9]\d{9}$", lambda f: f.form("phone"),
                 "Mobile '%s' must be 10 digits starting with 6-9")),
    "email_format": (
        "email address has a name, one at sign and a dotted domain",
        _pattern("email_format", "EMAIL_INVALID_FORMAT", r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
                 lambda f: f.get("email"), "Email '%s' is not a valid email address format")),
    "dob_validity": ("birth date exists and gives an age of 1 to 100", dob_validity),
    "dob_age_range": ("age is 18 to 65", dob_age_range),
    "bank_account_invalid_length": (
        "account number has 9 to 18 digits", bank_account_invalid_length),
    "email_company_generic_domain": (
        "a company does not use a free mail domain", email_company_generic_domain),
    "pincode_exists": (
        "postal code has six digits and is in the directory", pincode_exists),
    "state_pin_match": (
        "state agrees with the directory's for the postal code", state_pin_match),
    "district_pin_match": (
        "district or city agrees with the directory's for the postal code",
        district_pin_match),
}
PIN_RULES = ("pincode_exists", "state_pin_match", "district_pin_match")


def with_pin_lookup(df: DataFrame, pin_master: DataFrame | None) -> DataFrame:
    """Attach the master's state and district for each row's PIN, once for all three PIN rules.

    The master is reduced to one line per six-digit code, so at most a million short
    lines are broadcast whatever is passed in. Without a master only the format of a
    PIN is judged.
    """
    if pin_master is None:
        none = F.lit(None).cast("string")
        return df.withColumns({PIN_STATE: none, PIN_DISTRICT: none, PIN_KNOWN: F.lit(True)})
    place = F.struct(F.col("state_name").alias("s"), F.col("district").alias("d"))
    order = F.col("_row_num") if "_row_num" in pin_master.columns else place
    lines = (
        pin_master.filter(F.col("pincode").rlike(r"^[0-9]{6}$"))
        .groupBy(F.col("pincode").alias("__pin"))
        .agg(F.min_by(place, order).alias("place"))
        .select("__pin", F.col("place.s").alias(PIN_STATE), F.col("place.d").alias(PIN_DISTRICT),
                F.lit(True).alias(PIN_KNOWN))
    )
    pin = strip(text(df, "pincode"))
    return df.join(F.broadcast(lines), pin == F.col("__pin"), "left").drop("__pin")


def row_findings(fields: Fields, rule_ids) -> Column:
    """Array of the findings of the chosen row rules, in the given order; for fields.table.

    The one-finding arrays are concatenated, which stays inside generated code where a
    filter over an array would not.
    """
    return F.concat(no_findings(), *[ROW_RULES[r][1](fields) for r in rule_ids])


def apply_row_rules(
    df: DataFrame, rule_ids=None, pin_master: DataFrame | None = None, as_of=None, column: str = "exceptions"
) -> DataFrame:
    """The chosen row rules (all by default) in one pass, as one array column.

    Findings come in the order of rule_ids. Works on batch and streaming frames. Write
    the result before deriving several tables from it: filters on those would otherwise
    be pushed down through every rule expression.
    """
    chosen = list(ROW_RULES) if rule_ids is None else list(rule_ids)
    looked_up = with_pin_lookup(df, pin_master) if set(chosen) & set(PIN_RULES) else df
    fields = Fields(looked_up, as_of)
    return Fields.unstage(fields.table.withColumn(column, row_findings(fields, chosen)))
