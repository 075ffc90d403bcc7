"""Exception-code severities and the category texts of the audit procedures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity of each exception code; any other code is LOW.
SEVERITY_CODES = {
    "CRITICAL": "UCID_KYC_INCONSISTENT PAN_DUPLICATE AADHAAR_DUPLICATE",
    "HIGH": "VOTER_ID_DUPLICATE ADDRESS_DUPLICATE BANK_ACCOUNT_DUPLICATE NAME_DOB_DUPLICATE MOBILE_DUPLICATE",
    "MEDIUM": "EMAIL_COMPANY_GENERIC_DOMAIN DOB_AGE_OUT_OF_RANGE BANK_ACCOUNT_INVALID_LENGTH"
    " PAN_INVALID_FORMAT PAN_INVALID_ENTITY_CHAR AADHAAR_INVALID_FORMAT AADHAAR_INVALID_PREFIX"
    " AADHAAR_CHECKSUM_FAIL VOTER_ID_INVALID_FORMAT PASSPORT_INVALID_FORMAT DL_INVALID_FORMAT"
    " DL_INVALID_STATE_CODE MOBILE_INVALID_FORMAT EMAIL_INVALID_FORMAT DOB_INVALID_FORMAT"
    " DOB_FUTURE_DATE DOB_AGE_IMPLAUSIBLE DOB_AGE_TOO_YOUNG PIN_INVALID_FORMAT PIN_NOT_FOUND"
    " PAN_MISSING AADHAAR_MISSING VOTER_ID_MISSING MOBILE_MISSING EMAIL_MISSING DOB_MISSING PIN_MISSING",
    "LOW": "DISTRICT_PIN_MISMATCH STATE_PIN_MISMATCH ADDRESS_INCOMPLETE",
}

# Worst first; the position is the rank used below.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
STRATA = SEVERITIES + ("OK",)

# Labels of the codes that mean a missing field.
MISSING_LABELS = {
    "PAN_MISSING": "PAN",
    "AADHAAR_MISSING": "Aadhaar",
    "VOTER_ID_MISSING": "Voter ID",
    "MOBILE_MISSING": "Mobile",
    "EMAIL_MISSING": "Email",
    "DOB_MISSING": "Date of Birth",
    "PIN_MISSING": "Pincode",
    "ADDRESS_INCOMPLETE": "Address (incomplete)",
}

# Objective, assertion and standard of each rule category.
CATEGORY_AUDIT = {
    "missing_data": ("Mandatory KYC fields captured", "Completeness", "RBI KYC"),
    "kyc_format": ("Customer identity is valid & verifiable", "Accuracy", "RBI KYC / ICAI"),
    "address_pin": ("Address is complete & valid", "Completeness", "RBI KYC / ICAI"),
    "duplicates": ("No duplicate / fictitious customers", "Existence", "NFRA fraud indicators"),
    "identity_grouping": ("Related parties identified", "Existence", "ICAI / NFRA"),
}


def severity_rank(code: Column) -> Column:
    """0 for CRITICAL up to 3 for LOW and for unknown codes."""
    rank = F.lit(SEVERITIES.index("LOW"))
    for level in ("MEDIUM", "HIGH", "CRITICAL"):
        rank = F.when(code.isin(SEVERITY_CODES[level].split()), SEVERITIES.index(level)).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STRATA]), rank)


def severity(code: Column) -> Column:
    return severity_name(severity_rank(code))
