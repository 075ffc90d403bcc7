"""Canonical columns of the five report types.

Fixed values, one line per column: name, type, required mark (*), and the accepted
header names, which are compared without case and surrounding blanks. The canonical
name is listed only where it is itself an accepted header.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CUSTOMER_MASTER = """
customer_id        str * customer_id cust_id customerid customer_code cust_code client_id borrower_id applicant_id acct_id
full_name          str * full_name customer_name name borrower_name applicant_name first_name_last_name customer_full_name applicant_full_name
dob                str   dob date_of_birth birth_date dateofbirth d.o.b birthdate age date_birth
gender             str   gender sex
mobile             str   mobile mobile_no mobile_number phone phone_no contact_no contact_number
email              str   email email_id email_address emailid
pan                str   pan pan_no pan_number permanent_account_number pan_id taxpayer_id pan_code
aadhaar            str   aadhaar aadhaar_no aadhaar_number aadhar aadhar_no uid aadhar_id aadhaar_id
voter_id           str   voter_id voter_id_no epic_no epic_number voter_card electoral_id
passport           str   passport passport_no passport_number
driving_licence    str   driving_licence dl_no dl_number driving_license licence_no license_no
address_line1      str   address_line1 address1 address_line_1 addr1 address
address_line2      str   address_line2 address2 address_line_2 addr2
city               str   city city_name town
district           str   district district_name
state              str   state state_name st state_code state_abbr
pincode            str   pincode pin_code pin postal_code zip zipcode postal_pin pincode_no
bank_account       str   bank_account bank_account_no account_no account_number bank_acc account bank_account_number
ifsc               str   ifsc ifsc_code bank_ifsc ifsc_code_branch micr_code
lan                str * lan loan_agreement_number loan_account_no loan_id loan_no account_no_loan loan_account_number
coapplicant_mobile str   co_applicant_mobile coapplicant_phone coapp_mobile guarantor_mobile coapplicant_contact co_applicant_phone coapp_contact
income             str   income declared_income monthly_income annual_income gross_income net_income salary income_amount
branch_code        str   branch_code branch branch_id branch_name branch_no
dsa_code           str   dsa_code dsa dsa_id dsa_name agent_code sourcing_agent channel_code
onboarding_date    str   onboarding_date application_date creation_date customer_creation_date kyc_date sourcing_date onboard_date
"""

# written_off carries Yes/No texts in practice and is used as a dimension, so it stays text.
EAD_FILES = """
loan_id               str   * agreementno agreement_no loan_id lan loan_account_no account_no loanid agreementid agreementid_r
entity                str     entity company company_name
source_system_id      str     sourcesystemid source_system_id system_id
scheme_id             str     schemeid scheme_id productid product_id portfolio_code
scheme_name           str     schemename scheme_name productname product_name product
sbu                   str     sbu sub_business_unit segment business_unit
sub_sbu               str     subsbu sub_sbu sub_segment
branch_id             str     branchid branch_id branch_code
branch_name           str     branchname branch_name branch
state                 str     state state_name geography
channel_code          str     channelcode channel_code channel
channel_desc          str     channelcodedesc channel_desc channel_description sourcing_channel
loan_status           str     loanstatus loan_status status account_status
stage                 str     stage ecl_stage ind_as_stage ind_as_109_stage
dpd_bucket            str     dpdbucketing dpd_bucket dpd_band dpd_range days_past_due dpd
disbursement_date     str     disbursaldate disbursement_date disbursal_date disb_date disbursed_on
mob                   int     mob months_on_book tenure_months months_outstanding
sanction_amount       float   sanctionamount sanction_amount sanctioned_amount loan_amount
disbursed_amount      float   disbursedamount disbursed_amount disbursement_amount
outstanding_principal float   drspos outstanding_principal drs_pos principal_outstanding outstanding_pos os_principal
outstanding_interest  float   drsint outstanding_interest drs_int interest_outstanding os_interest
accrued_interest      float   accruedinterest accrued_interest accrued_int interest_accrued
overdue_charges       float   overduecharges overdue_charges cbc_unpaid odc_unpaid charges_overdue penal_charges
future_pos            float   futurepos future_pos future_principal lifetime_ead future_outstanding
gross_book_value      float   gross_loans_and_advances gross_book_value gross_loans gross_advances gbv
ead                   float   ead exposure_at_default exposure
collateral_value      float   national_asset_value collateral_value asset_value security_value nationalassetvalue
covered_portion       float   covered_portion secured_portion coveredportion
uncovered_portion     float   uncovered_portion unsecured_portion uncoveredportion
existing_provision    float   provsion_as_per_policy existing_provision provision_as_per_policy policy_provision
additional_provision  float   additionalprovision additional_provision management_overlay overlay
total_provision       float   total_provision ecl_provision total_ecl totalprovision
principal_paid        float   principalpaid principal_paid
interest_paid         float   interestpaid interest_paid
emi_amount            float   emi+amount emi_amount emi installment_amount emiamount
written_off           str     writtenoff written_off write_off_amount
otr_flag              str     otr_flag is_otr restructured rescheduled one_time_restructured
onan_flag             str     onan_flag is_onan once_npa_always_npa onan
business_date         str     businessdate business_date report_date as_of_date value_date business_dt
ucid                  str     ucid uniquecustomerid unique_customer_id customer_uid cif borrower_id customer_id
"""

COLLECTION_REPORT = """
loan_account_no  str   * loan_account_no lan loan_account loan_id
collection_date  str     collection_date payment_date receipt_date date
amount_collected float   amount_collected collected_amount payment_amount receipt_amount amount
collection_mode  str     collection_mode payment_mode mode_of_payment
agent_id         str     agent_id collector_id field_agent
dpd              int     dpd days_past_due overdue_days
"""

DISBURSEMENT_REPORT = """
loan_account_no     str   * loan_account_no lan loan_id
disbursement_date   str   * disbursement_date disbursal_date disb_date
disbursed_amount    float   disbursed_amount disbursement_amount amount loan_amount
beneficiary_name    str     beneficiary_name borrower_name customer_name
beneficiary_account str     beneficiary_account bank_account account_no
ifsc                str     ifsc ifsc_code
mode                str     mode disbursement_mode payment_mode
branch              str     branch branch_name branch_code
"""

TECHNICAL_WRITEOFF = """
loan_account_no         str   * loan_account_no lan loan_id account_no
writeoff_date           str     writeoff_date write_off_date wo_date date_of_writeoff
writeoff_amount         float   writeoff_amount write_off_amount wo_amount amount_written_off
outstanding_at_writeoff float   outstanding_at_writeoff outstanding principal_outstanding
writeoff_reason         str     writeoff_reason reason remarks
customer_id             str     customer_id cust_id borrower_id
"""

SPARK_TYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType()}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool
    aliases: tuple[str, ...]


def _parse(block: str) -> tuple[Field, ...]:
    fields = []
    for line in block.strip().splitlines():
        name, kind, *rest = line.split()
        required = rest[0] == "*"
        aliases = tuple(a.replace("+", " ") for a in (rest[1:] if required else rest))
        fields.append(Field(name, kind, required, aliases))
    return tuple(fields)


REPORT_TYPES: dict[str, tuple[Field, ...]] = {
    "customer_master": _parse(CUSTOMER_MASTER),
    "ead_files": _parse(EAD_FILES),
    "collection_report": _parse(COLLECTION_REPORT),
    "disbursement_report": _parse(DISBURSEMENT_REPORT),
    "technical_writeoff": _parse(TECHNICAL_WRITEOFF),
}


def struct_type(report_type: str) -> T.StructType:
    """The canonical Spark schema of a report type."""
    fields = REPORT_TYPES[report_type]
    return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type]) for f in fields])
