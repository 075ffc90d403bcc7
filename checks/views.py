"""Lender tables derived from the given star schema; one SQL text feeds both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import materialize

CUSTOMER_MASTER = """
SELECT o_orderkey + 1 AS _row_num,
 CASE WHEN c_custkey % 101 = 7 THEN NULL ELSE concat('C', lpad(CAST(c_custkey AS STRING), 8, '0')) END AS customer_id,
 translate(concat('Customer#', lpad(CAST(pk AS STRING), 9, '0')), '0123456789', 'abcdefghij') AS full_name,
 CASE pk % 12 WHEN 0 THEN '' WHEN 1 THEN 'not-a-date'
   WHEN 2 THEN concat('15-06-', CAST(1940 + pk % 75 AS STRING))
   WHEN 3 THEN concat('15/06/', CAST(1940 + pk % 75 AS STRING))
   WHEN 4 THEN '2099-01-01' WHEN 5 THEN '1880-01-01' WHEN 6 THEN '2024-11-30'
   ELSE concat(CAST(1940 + pk % 75 AS STRING), '-06-15') END AS dob,
 CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'O' END AS gender,
 CASE WHEN c_custkey % 41 = 0 THEN '' WHEN c_custkey % 43 = 0 THEN '5123456789'
   WHEN c_custkey % 7 = 0 THEN concat('+91', CAST(9000000000 + pk AS STRING))
   ELSE CAST(9000000000 + pk AS STRING) END AS mobile,
 CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('u', CAST(c_custkey AS STRING), '@gmail.com')
   WHEN 2 THEN concat('u', CAST(c_custkey AS STRING), '@mailinator.com') WHEN 3 THEN 'no-at-sign'
   ELSE concat('u', CAST(c_custkey AS STRING), '@corp', CAST(c_custkey % 40 AS STRING), '.in') END AS email,
 CASE WHEN c_custkey % 37 = 0 THEN '' WHEN c_custkey % 59 = 0 THEN 'ABC123' ELSE
   concat(chr(CAST(65 + pk % 26 AS INT)), chr(CAST(65 + (pk % 676 - pk % 26) / 26 AS INT)), 'C',
     CASE WHEN c_custkey % 97 = 3 THEN 'Z' ELSE 'P' END, 'K', lpad(CAST(pk % 10000 AS STRING), 4, '0'), 'A') END AS pan,
 CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 31 = 0 THEN '012345678901'
   WHEN c_custkey % 61 = 0 THEN '12345' ELSE CAST(200000000000 + pk * 7919 AS STRING) END AS aadhaar,
 CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN 'AB123'
   ELSE concat('ABC', lpad(CAST(pk AS STRING), 7, '0')) END AS voter_id,
 CASE WHEN c_custkey % 2 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'Q1234567'
   ELSE concat('A', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS passport,
 CASE WHEN c_custkey % 5 < 2 THEN '' WHEN c_custkey % 53 = 0 THEN 'ZZ0120100000001' WHEN c_custkey % 89 = 0 THEN 'MH-1'
   ELSE concat('MH12', '2011', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS driving_licence,
 CASE WHEN c_custkey % 60 = 2 THEN concat('FLAT', CAST(pk AS STRING), ' ', {long_line}) ELSE
   concat('PLOT', CAST(pk AS STRING), ' TOWER', CAST(pk % 997 AS STRING), ' LANE', CAST(pk % 499 AS STRING), ' MAIN STREET') END AS address_line1,
 CASE WHEN c_custkey % 100 IN (50, 51) THEN 'TWIN TOWN' WHEN c_custkey % 47 = 0 THEN '' ELSE r_name END AS city,
 CASE WHEN c_custkey % 71 = 0 THEN 'ELSEWHERE' ELSE lower(r_name) END AS district,
 CASE WHEN c_custkey % 67 = 0 THEN 'wrongstate' ELSE lower(n_name) END AS state,
 CASE WHEN c_custkey % 100 IN (50, 51) THEN CAST(110001 + pk % 40 AS STRING) WHEN c_custkey % 73 = 0 THEN '999999' WHEN c_custkey % 79 = 0 THEN '11000' WHEN c_custkey % 103 = 0 THEN ''
   ELSE CAST(110001 + c_nationkey * 1000 + c_custkey % 40 AS STRING) END AS pincode,
 CASE WHEN c_custkey % 83 = 0 THEN '12345' ELSE CAST(100000000000 + pk * 104729 AS STRING) END AS bank_account,
 CASE WHEN c_custkey % 87 = 5 THEN 'SBIN01234' ELSE concat('SBIN0', lpad(CAST(c_nationkey AS STRING), 6, '0')) END AS ifsc,
 concat('LN', lpad(CAST(o_orderkey - CASE WHEN o_orderkey % 400 = 1 THEN 1 ELSE 0 END AS STRING), 10, '0')) AS lan,
 CASE WHEN o_orderkey % 10 = 0 THEN CAST(9000000000 + o_orderkey % 300 AS STRING) ELSE NULL END AS coapplicant_mobile,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS income,
 concat('BR', lpad(CAST(c_nationkey AS STRING), 3, '0')) AS branch_code,
 c_mktsegment AS dsa_code,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS onboarding_date
FROM (SELECT *, c_custkey - CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END AS pk FROM {customer}) c
JOIN {orders} ON o_custkey = c_custkey
JOIN {nation} ON n_nationkey = c_nationkey
JOIN {region} ON r_regionkey = n_regionkey
"""

# twenty words that many lines share; they differ in the flat alone
CUSTOMER_MASTER = CUSTOMER_MASTER.replace("{long_line}", "'" + " ".join(
    f"{word}{part}" for word in ("NORTH", "GARDEN", "TEMPLE", "BRIDGE", "CANAL") for part in ("GATE", "WING", "ROAD", "VIEW")) + "'")

PIN_MASTER = """
SELECT DISTINCT CAST(110001 + c_nationkey * 1000 + c_custkey % 40 AS STRING) AS pincode,
 lower(r_name) AS district, lower(n_name) AS state_name
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey
"""

EXPOSURE = """
SELECT concat('L', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS loan_id,
 p_brand AS scheme_id, p_type AS scheme_name, c_mktsegment AS sbu, o_orderpriority AS sub_sbu, n_name AS state,
 CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'Settled' END AS loan_status,
 CASE l_returnflag WHEN 'N' THEN '1' WHEN 'R' THEN '2' ELSE '3' END AS stage,
 CASE WHEN l_quantity <= 10 THEN '0-30' WHEN l_quantity <= 20 THEN '31-60' WHEN l_quantity <= 30 THEN '61-90'
   WHEN l_quantity <= 40 THEN '91-120' ELSE 'NPA' END AS dpd_bucket,
 CAST(CAST(l_shipdate AS DATE) AS STRING) AS disbursement_date,
 CASE WHEN l_linenumber % 2 = 0 THEN '2001-02-28' ELSE '2001-03-31' END AS business_date,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS ead,
 CAST(l_extendedprice AS DECIMAL(18,2)) - 100 * CAST(l_quantity AS INT) AS outstanding_principal,
 CAST(l_extendedprice AS DECIMAL(18,2)) + 1000 AS sanction_amount,
 CAST(l_extendedprice AS DECIMAL(18,2)) + 500 AS disbursed_amount,
 CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) - 300 END AS collateral_value,
 CAST(l_quantity AS INT) * 100 AS covered_portion, CAST(l_quantity AS INT) * 10 AS uncovered_portion,
 CAST(l_quantity AS INT) * 20 AS existing_provision,
 CASE WHEN l_partkey % 5 = 0 THEN CAST(l_suppkey % 90 AS INT) * 10 ELSE 0 END AS additional_provision,
 CAST(l_quantity AS INT) * 20 + CASE WHEN l_partkey % 5 = 0 THEN CAST(l_suppkey % 90 AS INT) * 10 ELSE 0 END AS total_provision,
 CASE WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'No' END AS written_off,
 CASE WHEN l_discount > 0.05 THEN 'Y' ELSE 'N' END AS FVTPL,
 concat('U', CAST(c_custkey AS STRING)) AS ucid
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
JOIN {nation} ON n_nationkey = c_nationkey JOIN {part} ON p_partkey = l_partkey
"""

LOAN_BOOK = """
SELECT o_orderkey AS ROW_ID,
 CASE WHEN o_orderkey % 500 = 3 THEN NULL ELSE concat('LAN', lpad(CAST(o_orderkey - CASE WHEN o_orderkey % 100 = 1 THEN 1 ELSE 0 END AS STRING), 10, '0')) END AS LAN,
 CASE WHEN o_orderkey % 40 = 0 THEN concat('CUST', lpad(CAST(o_custkey AS STRING), 8, '0')) ELSE concat('CUST-', CAST(o_orderkey AS STRING)) END AS CUSTOMER_ID,
 CASE WHEN o_orderkey % 700 = 5 THEN '2027-01-01' WHEN o_orderkey % 700 = 6 THEN '1985-06-15' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS LOAN_DATE,
 CASE WHEN o_orderkey % 600 = 7 THEN 0 WHEN o_orderkey % 600 = 8 THEN 900000000 ELSE CAST(floor(o_totalprice) AS BIGINT) + 50000 END AS SANCTIONED_AMT,
 CASE WHEN o_orderkey % 600 = 9 THEN 2 * CAST(floor(o_totalprice) AS BIGINT) + 100000 WHEN o_orderkey % 600 = 10 THEN 800000000
   WHEN o_orderstatus = 'F' AND o_orderkey % 90 <> 4 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS OUTSTANDING_AMT,
 CASE WHEN o_orderkey % 650 = 11 THEN 0.0 WHEN o_orderkey % 650 = 12 THEN 75.0 ELSE 8.0 + o_orderkey % 13 END AS INTEREST_RATE,
 CASE WHEN o_orderkey % 650 = 13 THEN 0 ELSE 12 * (1 + o_orderkey % 7) END AS TENURE_MONTHS,
 CASE WHEN o_orderkey % 20 = 14 THEN 'NPA' WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Active' END AS LOAN_STATUS,
 CASE WHEN o_orderkey % 20 = 14 AND o_orderkey % 3 <> 0 THEN 90 ELSE 0 END AS DPD,
 o_orderpriority AS PRODUCT, concat('BR', CAST(c_nationkey AS STRING)) AS BRANCH,
 CASE o_orderkey % 60 WHEN 15 THEN 'Expired' WHEN 16 THEN 'Pending' WHEN 17 THEN 'Missing' ELSE 'Complete' END AS KYC_STATUS
FROM {orders} JOIN {customer} ON c_custkey = o_custkey
"""

VIEWS = {
    "customer_master": CUSTOMER_MASTER,
    "pin_master": PIN_MASTER,
    "exposure": EXPOSURE,
    "loan_book": LOAN_BOOK,
}
# the table that has a view's rows and the key by which it is dealt: that of its join with the next largest table, which then needs no deal of its own
DEALT = {"customer_master": ("orders", "o_custkey"), "exposure": ("lineitem", "l_orderkey"), "loan_book": ("orders", "o_custkey")}
# Tables that a view's rows meet before they are dealt. Where they are too large to be broadcast, parts then cost the lines one deal and customers
# the orders one; in the order of the text the much longer and more lines would be dealt once more for each of them.
MET = {"exposure": {
    "lineitem": ("{lineitem} JOIN {part} ON p_partkey = l_partkey", ["part"]),
    "orders": ("{orders} JOIN ({customer} JOIN {nation} ON n_nationkey = c_nationkey) ON c_custkey = o_custkey", ["customer", "nation"]),
}}
ROW_BYTES = 64  # of a dealt row, roughly
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")


_WRITTEN: dict[tuple, DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the Parquet tables of one scale directory.

    It is written once per session, as an extract is ingested once before it is
    audited, and read back as Parquet by every query. The given files have a single
    row group each, so the rows are dealt anew before they are derived, into parts whose number grows with the table: the few
    columns of the given table travel, not the many texts made from them, and rows of a customer or an order stay together.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(spark.sql(VIEWS[name].format(**_sources(spark, sf_dir, name))), name)
    return _WRITTEN[key]


def _sources(spark: SparkSession, sf_dir: str, name: str) -> dict[str, str]:
    """What stands for each table in the text of a view."""
    given = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    tables = dict(given)
    for table, (joined, others) in MET.get(name, {}).items():
        tables[table] = f"(SELECT * FROM {joined.format(**given)})"
        for other in others:
            tables[other] = "(SELECT 1 AS met)"  # its columns are there by now, so the text's own condition holds for every row
    if name in DEALT:
        table, by = DEALT[name]
        tables[table] = f"(SELECT /*+ REBALANCE({_parts(spark, given[table])}, {by}) */ * FROM {tables[table]})"
    return tables


def _parts(spark: SparkSession, table: str) -> int:
    """Parts for a table's rows: joins behind the deal keep their number, so it grows with the table (small ones are put together as they run)."""
    rows = spark.sql(f"SELECT count(*) FROM {table}").first()[0]
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes").lower()).groups()
    size = int(number) << 10 * " kmgt".index(unit or " ")
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * ROW_BYTES // size))


def view_sql(name: str) -> str:
    """The same text over tables that are already registered by name."""
    return VIEWS[name].format(**{t: t for t in TABLES})
