import datetime
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.session import work_dir
from ledgerlens.plans import engine, outputs
from ledgerlens.plans.row_rules import ROW_RULES, apply_row_rules

AS_OF = datetime.date(2024, 12, 31)
PINS = {"pincode": ["110001", "110001", "560001"], "district": ["central delhi", "other", "bengaluru urban"],
        "state_name": ["delhi", "delhi", "karnataka"]}

CASES = [
    ("pan_missing", {"pan": " \t"}, "PAN_MISSING"),
    ("pan_missing", {"pan": "X"}, None),
    ("aadhaar_missing", {"aadhaar": " - -"}, "AADHAAR_MISSING"),
    ("mobile_missing", {"mobile": "+ -"}, "MOBILE_MISSING"),
    ("pan_format", {"pan": " abcpk1234a "}, None),
    ("pan_format", {"pan": "ABC123"}, "PAN_INVALID_FORMAT"),
    ("pan_format", {"pan": "ABCZK1234A"}, "PAN_INVALID_ENTITY_CHAR"),
    ("pan_format", {"pan": ""}, None),
    ("aadhaar_format", {"aadhaar": "12345"}, "AADHAAR_INVALID_FORMAT"),
    ("aadhaar_format", {"aadhaar": "0123 4567-8901"}, "AADHAAR_INVALID_PREFIX"),
    ("aadhaar_format", {"aadhaar": "200000000000"}, "AADHAAR_CHECKSUM_FAIL"),
    ("aadhaar_format", {"aadhaar": "2341 2341 2346"}, None),
    ("voter_id_format", {"voter_id": "abc1234567"}, None),
    ("voter_id_format", {"voter_id": "AB1234567"}, "VOTER_ID_INVALID_FORMAT"),
    ("passport_format", {"passport": "Q1234567"}, "PASSPORT_INVALID_FORMAT"),
    ("dl_format", {"driving_licence": "MH-12 20110000001"}, None),
    ("dl_format", {"driving_licence": "ZZ1220110000001"}, "DL_INVALID_STATE_CODE"),
    ("dl_format", {"driving_licence": "MH-1"}, "DL_INVALID_FORMAT"),
    ("mobile_format", {"mobile": "+91 98765-43210"}, None),
    ("mobile_format", {"mobile": "5123456789"}, "MOBILE_INVALID_FORMAT"),
    ("email_format", {"email": "no-at-sign"}, "EMAIL_INVALID_FORMAT"),
    ("email_format", {"email": "a@b.in"}, None),
    ("dob_validity", {"dob": "31-02-1990"}, "DOB_INVALID_FORMAT"),
    ("dob_validity", {"dob": "1990-01/02"}, "DOB_INVALID_FORMAT"),
    ("dob_validity", {"dob": " 1-2-1990 "}, None),
    ("dob_validity", {"dob": "15061990"}, None),
    ("dob_validity", {"dob": "1990/6/15"}, None),
    ("dob_validity", {"dob": "2024-12-31"}, "DOB_FUTURE_DATE"),
    ("dob_validity", {"dob": "01/01/1880"}, "DOB_AGE_IMPLAUSIBLE"),
    ("dob_validity", {"dob": "2024-01-01"}, "DOB_AGE_TOO_YOUNG"),
    ("dob_age_range", {"dob": "2007-01-01"}, "DOB_AGE_OUT_OF_RANGE"),
    ("dob_age_range", {"dob": "2006-12-31"}, None),
    ("dob_age_range", {"dob": "1958-01-01"}, "DOB_AGE_OUT_OF_RANGE"),
    ("bank_account_invalid_length", {"bank_account": "12-34 5678"}, "BANK_ACCOUNT_INVALID_LENGTH"),
    ("bank_account_invalid_length", {"bank_account": "123456789012345678901"}, "BANK_ACCOUNT_INVALID_LENGTH"),
    ("email_company_generic_domain", {"email": "X@Gmail.com"}, "EMAIL_COMPANY_GENERIC_DOMAIN"),
    ("email_company_generic_domain", {"email": "x@corp.in"}, None),
    ("pincode_exists", {"pincode": "11000"}, "PIN_INVALID_FORMAT"),
    ("pincode_exists", {"pincode": "999999"}, "PIN_NOT_FOUND"),
    ("pincode_exists", {"pincode": " 560001"}, None),
    ("state_pin_match", {"pincode": "110001", "state": " DELHI"}, None),
    ("state_pin_match", {"pincode": "110001", "state": "goa"}, "STATE_PIN_MISMATCH"),
    ("state_pin_match", {"pincode": "999999", "state": "goa"}, None),
    ("district_pin_match", {"pincode": "560001", "district": "", "city": "Bengaluru"}, None),
    ("district_pin_match", {"pincode": "560001", "district": "  ", "city": "Mysuru"}, None),
    ("district_pin_match", {"pincode": "560001", "district": "Mysuru", "city": "Bengaluru"}, "DISTRICT_PIN_MISMATCH"),
    ("address_completeness", {"address_line1": "x", "city": " ", "state": "s", "pincode": ""}, "ADDRESS_INCOMPLETE"),
]


@pytest.fixture(scope="module")
def pins(frame):
    return frame(PINS)


def test_row_rules_case_by_case(spark, frame, pins):
    names = sorted({c for _, row, _ in CASES for c in row})
    columns = {"case": [str(i) for i in range(len(CASES))]}
    columns.update({n: [row.get(n) for _, row, _ in CASES] for n in names})
    checked = apply_row_rules(frame(columns), None, pins, AS_OF)
    got = {
        int(r["case"]): {e["rule_id"]: e["code"] for e in r["exceptions"]}
        for r in checked.select("case", "exceptions").collect()
    }
    for i, (rule, row, code) in enumerate(CASES):
        assert got[i].get(rule) == code, (rule, row, got[i])


def test_incomplete_address_lists_fields_in_order(frame):
    df = frame({"address_line1": [None], "city": ["x"], "state": [""], "pincode": ["1"]})
    [row] = apply_row_rules(df, ["address_completeness"]).collect()
    assert row["exceptions"][0]["desc"] == "Address fields missing: address_line1, state"


@pytest.mark.parametrize("columns", [{"some_unrelated_col": ["x"]}, {"pan": [None], "dob": [None]}])
def test_absent_and_null_columns_count_as_blank(frame, columns):
    [row] = apply_row_rules(frame(columns), None, None, AS_OF).collect()
    codes = {e["code"] for e in row["exceptions"]}
    assert {"PAN_MISSING", "PIN_MISSING", "ADDRESS_INCOMPLETE"} <= codes
    assert not any(e["status"] == "ERROR" for e in row["exceptions"])


def test_empty_table(frame):
    df = frame({"pan": ["x"]}).limit(0)
    assert engine.run_rules(df, "salt", as_of=AS_OF).count() == 0


def test_rule_selection():
    assert len(engine.select_rules()) == 31
    assert engine.select_rules()[0] == "ucid"
    assert engine.select_rules(["pan_format"], ["address_pin"], ["state_pin_match"]) == [
        "pan_format", "pincode_exists", "district_pin_match"]
    assert sorted(r for _, rules in engine.CATEGORIES.values() for r in rules) == sorted(engine.RULE_ORDER)
    assert [len(rules) for _, rules in engine.CATEGORIES.values()] == [8, 11, 3, 7, 2]
    for bad in ({"rules": ["nope"]}, {"categories": ["nope"]}, {"rules": ["ucid"], "disabled": ["ucid"]}):
        with pytest.raises(ValueError):
            engine.select_rules(**bad)


def test_user_rule_takes_part(frame):
    def no_vowel(f):
        from ledgerlens.plans.row_rules import found

        return F.when(~f.get("full_name").rlike("[aeiou]"), found("no_vowel", "WARN", "NO_VOWEL", "odd name"))

    engine.register_rule("no_vowel", "names without vowels", no_vowel)
    try:
        df = frame({"_row_num": [1, 2], "full_name": ["xyz", "ann"]}, "_row_num long, full_name string")
        got = engine.run_rules(df, "salt", rules=["no_vowel"]).orderBy("_row_num").collect()
        assert [[e["code"] for e in r["exceptions"]] for r in got] == [["NO_VOWEL"], []]
    finally:
        engine.unregister_rule("no_vowel")


def test_outputs_agree_and_mask(frame, pins):
    df = frame(
        {"_row_num": [1, 2, 3], "customer_id": ["A", "B", "C"], "pan": ["bad", "ABCPK1234A", ""],
         "aadhaar": ["234123412346", "200000000000", None], "email": ["a@gmail.com", "b@corp.in", "x"]},
        "_row_num long, customer_id string, pan string, aadhaar string, email string",
    )
    rules = ["pan_format", "aadhaar_format", "pan_missing", "aadhaar_missing", "email_company_generic_domain"]
    checked = engine.run_rules(df, "salt", rules=rules, pin_master=pins)
    wide = {r["_row_num"]: r for r in outputs.wide_exceptions(checked).collect()}
    long = outputs.long_exceptions(checked).collect()
    assert wide[1]["exception_codes"] == "EMAIL_COMPANY_GENERIC_DOMAIN|PAN_INVALID_FORMAT"
    assert [wide[i]["overall_status"] for i in (1, 2, 3)] == ["ERROR", "ERROR", "WARN"]
    assert sum(r["exception_count"] for r in wide.values()) == len(long) == 5
    assert wide[1]["aadhaar"] == "XXXXXXXX2346"
    counts = {r["status"]: r["count"] for r in outputs.status_counts(outputs.wide_exceptions(checked)).collect()}
    assert counts == {"OK": 0, "WARN": 1, "ERROR": 2}
    flat = outputs.flat_annotations(checked, rules).filter("_row_num = 1").first()
    assert (flat["_exc_pan_format_status"], flat["_exc_pan_missing_status"]) == ("ERROR", "OK")
    assert len(ROW_RULES) == 22


def test_row_rules_on_a_stream(spark, frame, tmp_path):
    from ledgerlens.streaming import apply_row_rules as on_stream

    source = str(tmp_path / "in")
    frame({"pan": ["bad", "ABCPK1234A"]}).write.parquet(source)
    stream = spark.readStream.schema("pan string").parquet(source)
    query = on_stream(stream, ["pan_format"]).writeStream.format("memory").queryName("checked_rows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(size(exceptions)) from checked_rows").first()[0] == 1


def test_a_run_leaves_only_its_result(spark):
    folder = os.path.join(work_dir(spark), spark.sparkContext.applicationId)
    df = spark.createDataFrame(
        [(i, f"C{i}", "ABCPK1234A" if i < 3 else "", "12 Long Street Near Temple", f"L{i}") for i in range(1, 6)],
        "_row_num long, customer_id string, pan string, address_line1 string, lan string")
    before, steps = set(os.listdir(folder)) if os.path.isdir(folder) else set(), []
    checked = engine.run_rules(df, "s", rules=["ucid", "pan_duplicate", "address_duplicate", "pan_format"], progress=steps.append)
    assert len(set(os.listdir(folder)) - before) == 1 and checked.count() == 5
    assert steps == ["addresses", "ucid", "duplicates", "rows"]


def test_table_rules_see_all_rows(spark):
    def repeated(rows):
        many = rows.groupBy("city").count().filter("count > 1").select("city")
        said = F.struct(F.lit("").alias("rule_id"), F.lit("WARN").alias("status"), F.lit("CITY").alias("code"), F.lit("shared city").alias("desc"))
        return rows.join(many, "city").select("_row_num", said.alias("finding"))

    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "_row_num long, city string")
    engine.register_table_rule("city_shared", "cities with several rows", repeated)
    try:
        got = {r["_row_num"]: [(e["rule_id"], e["code"]) for e in r["exceptions"]] for r in engine.run_rules(df, "s", rules=["city_shared", "pan_missing"]).collect()}
    finally:
        engine.unregister_rule("city_shared")
    assert [("city_shared", "CITY") in got[i] for i in (1, 2, 3)] == [True, False, True]


def test_work_folder_is_required_on_a_cluster():
    class Context:
        master, applicationId = "yarn", "x"

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError):
        work_dir(Session)


def test_findings_of_a_stream_are_appended_once(spark, frame, tmp_path):
    from ledgerlens.streaming import start_exceptions

    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for pans in (["bad", "ABCPK1234A"], ["worse"]):
        frame({"pan": pans, "customer_id": ["C"] * len(pans)}).write.mode("append").parquet(source)
        stream = spark.readStream.schema("pan string, customer_id string").parquet(source)
        start_exceptions(stream, folder, ["pan_format"], availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{folder}/exceptions").collect()
    assert sorted(r["exception_code"] for r in got) == ["PAN_INVALID_FORMAT"] * 2
