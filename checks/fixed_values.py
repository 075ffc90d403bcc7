"""Fixed values that the SQL states for itself, so that a wrong list or limit in the library shows."""

from __future__ import annotations

# Column names, words, patterns, limits and texts of the reports and rules.
KYC_FIELDS = "pan aadhaar voter_id passport driving_licence mobile email dob".split()
CLOSED = 'closed|written off|writeoff|wo|write off|settled|foreclosed'
HIGH_DPD = '91|121|151|181|211|241|271|361|npa|sub|doubtful|loss'
PIVOT_DIMENSIONS = (
    "entity source_system_id scheme_id scheme_name branch_id branch_name state sbu sub_sbu channel_code "
    "channel_desc loan_status stage dpd_bucket written_off System ECL WriteOffSecuSelldown ProductID ProductName "
    "FVTPL FuturePoS_GL_ID FuturePOS_GL_Des Principle_DRS_GL_ID Principle_DRS_GL_Des INT_DRS_GL_ID INT_DRS_GL_DESC "
    "Accrued_Interest_GL_ID Accrued_Interest_GL_DESC Redemption_Premium_Debtors_GL_ID "
    "Redemption_Premium_Debtors_GL_DESC Accrued_Redemption_Premium_GL_ID Accrued_Redemption_Premium_GL_DESC "
    "Prepaid_GL_ID Prepaid_GL_DESC"
).split()
PIVOT_MEASURES = {'future_pos': 'Sum(FuturePOS)',
 'outstanding_principal': 'Sum(DrsPOS)',
 'outstanding_interest': 'Sum(DrsInt)',
 'accrued_interest': 'Sum(AccruedInterest)',
 'overdue_charges': 'Sum(OverDueCharges)',
 'gross_book_value': 'Sum(Gross_Loans_and_Advances)',
 'ead': 'Sum(EAD)',
 'mob': 'Sum(MOB)',
 'collateral_value': 'Sum(National_Asset_Value)',
 'covered_portion': 'Sum(Covered_Portion)',
 'uncovered_portion': 'Sum(Uncovered_Portion)',
 'existing_provision': 'Sum(Provsion_as_per_Policy)',
 'additional_provision': 'Sum(AdditionalProvision)',
 'total_provision': 'Sum(Total_Provision)',
 'sanction_amount': 'Sum(SANCTIONAMOUNT)',
 'disbursed_amount': 'Sum(DISBURSEDAMOUNT)',
 'loan_id': 'Count(AGREEMENTID_R)',
 'principal_paid': 'Sum(PrincipalPaid)',
 'interest_paid': 'Sum(InterestPaid)',
 'emi_amount': 'Sum(EMI Amount)'}
QUALITY_COLUMNS = (
    "loan_id stage dpd_bucket ead gross_book_value outstanding_principal collateral_value total_provision "
    "written_off"
).split()
SIGNED_COLUMNS = (
    "ead outstanding_principal outstanding_interest accrued_interest overdue_charges future_pos gross_book_value "
    "collateral_value covered_portion uncovered_portion existing_provision additional_provision total_provision "
    "sanction_amount disbursed_amount principal_paid interest_paid emi_amount mob Prepaid TotalDebtors "
    "Debtors_Redemption_Premium AccruedRedemptionPremium zero_90_days_interest zero_90_int_Final PROCESSINGFEES "
    "Unbanked"
).split()
BENFORD_ACCEPTABLE = 0.012
BENFORD_CLOSE = 0.006
BENFORD_MARGINAL = 0.015
BENFORD_SHARES = (0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046)
DISPOSABLE_DOMAINS = (
    "mailinator.com guerrillamail.com 10minutemail.com tempmail.com temp-mail.org throwawaymail.com yopmail.com "
    "trashmail.com getnada.com sharklasers.com dispostable.com fakeinbox.com maildrop.cc mintemail.com "
    "mailnesia.com spam4.me guerrillamailblock.com tempinbox.com emailondeck.com tempr.email"
).split()
DOCUMENTS = {'pan': 'PAN', 'aadhaar': 'Aadhaar', 'voter_id': 'Voter ID', 'passport': 'Passport', 'driving_licence': 'Driving Licence'}
CLASSES = (
    "DUPLICATE_LAN DUPLICATE_CUSTOMER NULL_MANDATORY_FIELD INVALID_SANCTIONED_AMT OUTSTANDING_EXCEEDS_SANCTIONED "
    "INVALID_INTEREST_RATE INVALID_TENURE FUTURE_LOAN_DATE IMPLAUSIBLY_OLD_DATE CLOSED_WITH_OUTSTANDING "
    "STATUS_DPD_MISMATCH KYC_ISSUE OUTLIER_SANCTIONED_AMT OUTLIER_OUTSTANDING_AMT OUTLIER_INTEREST_RATE"
).split()
OUTLIERS = {'OUTLIER_SANCTIONED_AMT': 'SANCTIONED_AMT',
 'OUTLIER_OUTSTANDING_AMT': 'OUTSTANDING_AMT',
 'OUTLIER_INTEREST_RATE': 'INTEREST_RATE'}
SEED = 42
FREE_EMAIL_DOMAINS = (
    "gmail.com yahoo.com outlook.com hotmail.com aol.com icloud.com mail.com protonmail.com yandex.com "
    "rediffmail.com dataone.in airtelmail.com bsnl.in"
).split()
LICENCE_STATES = (
    "AP AR AS BR CG GA GJ HR HP JH JK KA KL LA LD MH ML MN MP MZ NL OD PB PY RJ SK TN TS TR UK UP WB AN CH DD DL DN"
).split()
PAN_ENTITIES = 'PFHBCAGLJT'
DEVIATION_BANDS = (0.05, 0.1, 0.15, 0.2)
SAMPLE_SIZES = ((250, (47, 30, 20, 15)),
 (500, (47, 30, 20, 15)),
 (1000, (47, 30, 20, 15)),
 (5000, (76, 52, 34, 25)),
 (50000, (160, 100, 65, 50)),
 (500000, (195, 125, 80, 60)),
 (None, (195, 125, 80, 60)))
CATEGORY_AUDIT = {'missing_data': ('Mandatory KYC fields captured', 'Completeness', 'RBI KYC'),
 'kyc_format': ('Customer identity is valid & verifiable', 'Accuracy', 'RBI KYC / ICAI'),
 'address_pin': ('Address is complete & valid', 'Completeness', 'RBI KYC / ICAI'),
 'duplicates': ('No duplicate / fictitious customers', 'Existence', 'NFRA fraud indicators'),
 'identity_grouping': ('Related parties identified', 'Existence', 'ICAI / NFRA')}
MISSING_LABELS = {'PAN_MISSING': 'PAN',
 'AADHAAR_MISSING': 'Aadhaar',
 'VOTER_ID_MISSING': 'Voter ID',
 'MOBILE_MISSING': 'Mobile',
 'EMAIL_MISSING': 'Email',
 'DOB_MISSING': 'Date of Birth',
 'PIN_MISSING': 'Pincode',
 'ADDRESS_INCOMPLETE': 'Address (incomplete)'}
SEVERITIES = "CRITICAL HIGH MEDIUM LOW".split()
SEVERITY_CODES = {'CRITICAL': 'UCID_KYC_INCONSISTENT PAN_DUPLICATE AADHAAR_DUPLICATE',
 'HIGH': 'VOTER_ID_DUPLICATE ADDRESS_DUPLICATE BANK_ACCOUNT_DUPLICATE NAME_DOB_DUPLICATE MOBILE_DUPLICATE',
 'MEDIUM': 'EMAIL_COMPANY_GENERIC_DOMAIN DOB_AGE_OUT_OF_RANGE BANK_ACCOUNT_INVALID_LENGTH PAN_INVALID_FORMAT '
           'PAN_INVALID_ENTITY_CHAR AADHAAR_INVALID_FORMAT AADHAAR_INVALID_PREFIX AADHAAR_CHECKSUM_FAIL VOTER_ID_INVALID_FORMAT '
           'PASSPORT_INVALID_FORMAT DL_INVALID_FORMAT DL_INVALID_STATE_CODE MOBILE_INVALID_FORMAT EMAIL_INVALID_FORMAT '
           'DOB_INVALID_FORMAT DOB_FUTURE_DATE DOB_AGE_IMPLAUSIBLE DOB_AGE_TOO_YOUNG PIN_INVALID_FORMAT PIN_NOT_FOUND '
           'PAN_MISSING AADHAAR_MISSING VOTER_ID_MISSING MOBILE_MISSING EMAIL_MISSING DOB_MISSING PIN_MISSING',
 'LOW': 'DISTRICT_PIN_MISMATCH STATE_PIN_MISMATCH ADDRESS_INCOMPLETE'}
STRATA = "CRITICAL HIGH MEDIUM LOW OK".split()
