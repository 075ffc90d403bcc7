import datetime
import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from checks import views
from ledgerlens.plans import customer, exposure, forensic
from ledgerlens.plans.report import NotAvailable
from ledgerlens.sources import sinks

AS_OF = datetime.date(2024, 12, 31)


@pytest.fixture(scope="module")
def book(spark):
    rows = [
        ("L1", "P1", "1", "0-30", "Active", "2024-02-29", "2024-01-15", "100.5", 10.0, 4.0, "50"),
        ("L2", "P1", "1", "91-120", "Active", "2024-03-31", "2024-02-15", "200", 0.0, 5.0, None),
        ("L3", None, "2", "npa", "Closed", "2024-03-31", "2024-03-15", "abc", 6.0, 2.0, "30"),
        ("L3", "P2", "3", None, None, "2024-03-31", "bad", None, None, 0.0, "-5"),
    ]
    return spark.createDataFrame(
        rows, "loan_id string, scheme_id string, stage string, dpd_bucket string, loan_status string, business_date string,"
        " disbursement_date string, ead string, additional_provision double, existing_provision double, collateral_value string",
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_last_snapshot_forms(spark, book):
    assert exposure.last_snapshot(book).count() == 3
    words = spark.createDataFrame([("b",), ("a",), (None,)], "business_date string")
    assert rows(exposure.last_snapshot(words)) == [("b",)]
    empty = spark.createDataFrame([(None,)], "business_date string")
    assert exposure.last_snapshot(empty).count() == 1
    dates = spark.createDataFrame([(AS_OF,), (datetime.date(2024, 1, 1),)], "business_date date")
    assert rows(exposure.last_snapshot(dates)) == [(AS_OF,)]


def test_sums_tolerate_text_and_nothing(book):
    got = {r["stage"]: r for r in exposure.report(book, "stage_summary").collect()}
    assert got["1"]["Total EAD"] == 300.5 and got["2"]["Total EAD"] == 0.0 and got["3"]["Loan Count"] == 1


def test_nulls_sort_first(book):
    assert [r["DPD Bucket"] for r in exposure.report(book, "dpd_summary").collect()] == [None, "0-30", "91-120", "npa"]


def test_flags_and_mismatch(book):
    flagged = exposure.report(book, "product_stage_dpd").filter("`DPD-Stage Mismatch`").collect()
    assert [r["DPD Bucket"] for r in flagged] == ["91-120"]
    assert sorted(r["Loan ID"] for r in exposure.report(book, "stage_mismatch").collect()) == ["L2", "L3"]


def test_distinct_counts_include_null(spark):
    df = spark.createDataFrame([("1", None, 1.0), ("1", "A", 1.0), ("1", "A", 1.0)], "stage string, loan_id string, ead double")
    assert rows(exposure.report(df, "stage_distribution")) == [("1", 2, 3.0)]


def test_provision_outlier_uses_twice_the_median(book):
    got = {r["Loan ID"]: r for r in exposure.report(book, "provision_check").collect()}
    assert (got["L1"]["Ratio (Addl/Policy)"], got["L3"]["Ratio (Addl/Policy)"]) == (2.5, 3.0)
    assert not got["L1"]["Outlier Flag"] and set(got) == {"L1", "L3"}


def test_period_ignores_bad_bounds(book):
    assert exposure.disbursement(book, "2024-02-01", "nonsense").count() == 2
    assert exposure.disbursement(book).count() == 3


def test_pivot_counts_loan_ids_of_any_form(book):
    assert sum(r["Count(AGREEMENTID_R)"] for r in exposure.report(book, "pivot").collect()) == book.filter("loan_id IS NOT NULL").count()
    assert {r["Count(AGREEMENTID_R)"] for r in exposure.pivot(book, numeric_ids_only=True).collect()} == {0}


def test_all_reports_plan_or_explain(spark, book):
    results = exposure.run_exposure_reports(book)
    assert len(results) == 23
    assert results["fvtpl"].df is None and results["fvtpl"].note
    assert results["fvtpl"].as_frame(spark).columns == ["note"]
    for key, result in results.items():
        if result.df is not None:
            result.df.count()


def test_units(book):
    scaled = exposure.scale_units(exposure.report(book, "stage_summary"), "lakh").orderBy("stage").first()
    assert scaled["Total EAD"] == 300.5 / 1e5 and scaled["Loan Count"] == 2
    assert not exposure.is_monetary("Loan_Count") and exposure.is_monetary("Total EAD")


def test_merge_widens_types(spark):
    a = spark.createDataFrame([(1, "x")], "ead int, s string")
    b = spark.createDataFrame([(2.5, 7, "z")], "ead double, s int, extra string")
    merged = exposure.merge_extracts({"a": a, "b": b})
    assert sorted(rows(merged.select("ead", "s", "_source_file"))) == [(1.0, "x", "a"), (2.5, "7", "b")]


def test_customer_reports(spark):
    df = spark.createDataFrame(
        [("A", "KA", "15-06-1990", "M", "91", "92", "P", "L1", "SBIN0KA12"), ("A", "KA", "15-06-1990", "M", "91", None, "", "L2", "bad"),
         (None, None, "1990-06-15", "F", None, "91", None, "L2", None), ("B", "KA", "15-06-2030", "F", "93", "91", "Q", "L3", "SBIN0KA12")],
        "customer_id string, state string, dob string, gender string, mobile string, coapplicant_mobile string, pan string,"
        " lan string, ifsc string",
    )
    assert rows(customer.geographic_distribution(df)) == [("KA", 2)]
    assert rows(customer.demographic_distribution(df, AS_OF)) == [("26-35", "M", 1)]
    assert rows(customer.coapplicant_overlap(df)) == [("Co-applicant mobile matches", 2), ("No match", 2)]
    assert rows(customer.coapplicant_concentration(df)) == [("Multiple Primary Links", 2, 2)]
    assert dict((r[0], r[1]) for r in rows(customer.fraud_risk_flags(df))) == {"Missing PAN": 2, "Missing Mobile": 1}
    assert rows(customer.lan_concentration(df, 1)) == [(1, "A", 2)]
    with pytest.raises(NotAvailable):
        customer.cluster_distribution(df)
    sized = df.selectExpr("customer_id", "int(1 + 5 * (case customer_id when 'A' then 1 else 0 end)) ucid_size")
    assert rows(customer.cluster_distribution(sized)) == [("1 (Solo)", 2, 3), ("6-10", 1, 3)]


def runs_by_hand(numbers):
    out, run = [], [numbers[0]]
    for before, after in zip(numbers, numbers[1:]):
        if after - before == 1:
            run.append(after)
        else:
            out.append(len(run))
            run = [after]
    return sorted(n for n in [*out, len(run)] if n >= 3)


@pytest.mark.parametrize("digits", [1, 2, 5])
def test_document_runs_break_at_ties(spark, monkeypatch, digits):
    monkeypatch.setattr(forensic, "STRETCH_DIGITS", digits)
    rng = random.Random(digits)
    numbers = sorted(rng.choice(range(100, 190)) for _ in range(90))
    df = spark.createDataFrame([(i, f"ab{n}c") for i, n in enumerate(numbers)], "_row_num long, pan string")
    got = sorted(r["Sequence Length"] for r in forensic.sequential_documents(df).collect())
    assert got == runs_by_hand(numbers)


def test_aadhaar_runs_are_masked(spark):
    df = spark.createDataFrame([(i, str(200000000000 + i)) for i in range(5)], "_row_num long, aadhaar string")
    [row] = forensic.sequential_documents(df).collect()
    assert row["First Value"] == "XXXXXXXX0000" and row["Risk"] == "CRITICAL"


def test_similar_names_match_all_pairs(spark):
    rng = random.Random(2)
    first = ["ramesh kumar", "sunita devi sharma", "li", "abdul rahman khan bahadur", "jo"]
    people = []
    for i in range(70):
        name = list(rng.choice(first))
        for _ in range(rng.randrange(3)):
            spot = rng.randrange(len(name))
            name[spot : spot + rng.randrange(2)] = rng.choice("abcd xyz")
        people.append((i, "".join(name).title(), rng.choice(["560001", "110001", ""]), rng.choice(["", f"P{i % 9}"])))
    df = spark.createDataFrame(people, "_row_num long, full_name string, pincode string, pan string")
    got = {(r["Name A"], r["Name B"], r["Pincode"], r["Similarity"]) for r in forensic.name_similarity(df, top_n=None).collect()}

    def key(name):
        return " ".join("".join(c if c.isascii() and c.isalpha() else " " for c in name.lower()).split())

    firsts = {}
    for i, name, pin, pan in people:
        firsts.setdefault((pin, name.strip(), pan), i)
    wanted, order = set(), sorted(firsts.items(), key=lambda kv: kv[1])
    for x, ((pin, a, pa), _) in enumerate(order):
        for (pin2, b, pb), _ in order[x + 1 :]:
            if pin == pin2 and key(a) and key(b) and key(a) != key(b) and not (pa and pa == pb):
                score = SequenceMatcher(None, key(a), key(b)).ratio()
                if score >= 0.92:
                    wanted.add((a, b, pin, round(score, 3)))
    assert got == wanted and wanted


def test_benford_needs_thirty_values(spark):
    few = spark.createDataFrame([("100",)] * 29, "income string")
    assert forensic.income_benford(few).count() == 0
    many = spark.createDataFrame([("0,100",)] * 30, "income string")
    got = forensic.income_benford(many).collect()
    assert got[0]["Observed %"] == 100.0 and got[-1]["Digit"].startswith("NON-CONFORMITY")


def test_velocity_finds_the_spike(spark):
    quiet = [("B1", f"2024-01-{d:02d}") for d in range(1, 29)]
    df = spark.createDataFrame(quiet + [("B1", "2024-02-01")] * 20, "branch_code string, onboarding_date string")
    [row] = forensic.onboarding_velocity(df).collect()
    assert (row["Date"], row["New Customers"]) == ("2024-02-01", 20)


def test_shared_addresses_and_domains(spark):
    rows_ = [(f"C{i}", "12, Main-Road", "Pune", f"c{i}@mailinator.com") for i in range(11)]
    df = spark.createDataFrame(rows_, "customer_id string, address_line1 string, city string, email string")
    [a] = forensic.address_clustering(df).collect()
    assert (a[0], a["Distinct Customers"], a["Risk"]) == ("12 main road pune", 11, "CRITICAL")
    [d] = forensic.email_domain_anomalies(df).collect()
    assert d["Anomaly Type"] == "Disposable + Shared"


def test_template_names_make_few_candidates(spark):
    rng, counts = random.Random(3), []
    for n in (250, 500, 1000):
        rows_ = [(i, "", "rajesh kumar " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))) for i in range(n)]
        names = spark.createDataFrame(rows_, "pid long, block string, name string")
        counts.append(forensic.name_pair_candidates(names, 0.92).count())
    print(counts)
    assert counts[2] < 1000


def test_similar_names_have_a_small_plan(spark, capsys):
    rows_ = [(i, "", "rajesh kumar" + " of the long name" * (i % 4)) for i in range(8)]
    names = spark.createDataFrame(rows_, "pid long, block string, name string")
    capsys.readouterr()
    forensic.name_pair_candidates(names, 0.92).explain(True)
    assert len(capsys.readouterr().out) < 40_000


def test_document_runs_of_any_length(spark):
    base = int("9" * 38 + "99997")
    values = [str(base + i) for i in range(7)] + [f"X{100 + i:05d}" for i in (0, 1, 2, 5)] + ["0099999", "0100000", "0100001"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "_row_num long, voter_id string")
    got = {(r["Sequence Length"], r["First Value"], r["Last Value"]) for r in forensic.sequential_documents(df).collect()}
    assert got == {(7, str(base), str(base + 6)), (3, "X00100", "X00102"), (3, "0099999", "0100001")}


def test_last_snapshot_prunes(spark, book, tmp_path):
    sinks.write_parquet(book, str(tmp_path / "book"), partition_by=("business_date",))
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(str(tmp_path / "book"))
    plan = exposure.last_snapshot(back)._jdf.queryExecution().executedPlan().toString()
    assert "business_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    flat = str(tmp_path / "flat")
    sinks.write_parquet(book, flat)
    plan = exposure.report(spark.read.parquet(flat), "product_stage_dpd")._jdf.queryExecution().executedPlan().toString()
    assert "business_date" in plan.split("PushedFilters: [")[1].split("ReadSchema")[0]


def test_distinct_counts_merge_by_part(spark):
    from ledgerlens.operators.bitmaps import DistinctCounts

    rng = random.Random(8)
    rows = [(m, rng.choice(["A", "B", None]), rng.choice([None, *[f"c{i}" for i in range(70)]])) for m in range(4) for _ in range(60)]
    df = spark.createDataFrame(rows, "month int, state string, customer string")
    counts = DistinctCounts("customer", ("state",))
    for m in range(4):
        counts.add(df.filter(f"month = {m}"))
    for chosen in (None, [0], [1, 3]):
        got = {r["state"]: r["n"] for r in counts.counts("n", chosen).collect()}
        wanted = {}
        for m, state, customer in rows:
            if chosen is None or m in chosen:
                wanted.setdefault(state, set()).add(customer)
        assert got == {k: len(v) for k, v in wanted.items()}
    seen = [r["value"] for d in counts.dictionaries for r in d.collect()]
    assert len(seen) == len(set(seen))


def test_group_reports_share_one_pass(spark, book):
    results = exposure.run_exposure_reports(book)
    able = [k for k in exposure.GROUPINGS if results[k].df is not None]
    assert len(able) > 5 and results["ucid_lan"].note == "ucid column not available"
    for key in able:
        alone = exposure.report(book, key)
        assert sorted(map(tuple, results[key].df.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str), key
        assert results[key].df.dtypes == alone.dtypes
    read = {f for k in able for f in results[k].df.inputFiles()}
    assert all("exposure-sums" in f for f in read) and len({f.rsplit("/", 2)[1] for f in read}) == 1
    lacking = exposure.run_exposure_reports(book.drop("stage", "business_date"), ["stage_summary", "product_ead"])
    assert lacking["stage_summary"].df is None and lacking["product_ead"].df.count() == 3


def test_loan_reports_share_one_line_a_loan(spark, book):
    more = spark.createDataFrame([(None, "1", "npa", "7"), (None, None, "npa", "1"), ("L1", "2", "0-30", "300"), ("L9", "1", "0-30", None)],
                                 "loan_id string, stage string, dpd_bucket string, ead string")
    both = book.unionByName(more, allowMissingColumns=True).selectExpr("*", "stage = '1' AS written_off")
    shared = [*exposure.LOAN_KEYS, "portfolio_concentration"]
    results = exposure.run_exposure_reports(both)
    for key in shared:
        own = exposure.report(both, key)
        assert rows(results[key].df) == rows(own) and results[key].df.dtypes == own.dtypes, key
        assert "/loans-" in str(results[key].df.inputFiles()) or "distinct" not in results[key].df._jdf.queryExecution().optimizedPlan().toString(), key
    lacking = exposure.run_exposure_reports(both.drop("stage"), shared)
    assert lacking["stage_distribution"].note and lacking["dpd_risk_distribution"].df.count() == 4


def test_keys_of_many_values_keep_their_own_count(spark):
    book = spark.range(300).selectExpr("concat('L', id % 100) AS loan_id", "cast(id % 90 AS string) AS stage", "cast(id % 7 AS string) AS dpd_bucket", "1.5D AS ead")
    results = exposure.run_exposure_reports(book, [*exposure.LOAN_KEYS, "portfolio_concentration"])
    for key in ("stage_distribution", "dpd_risk_distribution", "portfolio_concentration"):
        assert rows(results[key].df) == rows(exposure.report(book, key)), key


@pytest.mark.parametrize("name, key, derived", [("exposure", "l_orderkey", "loan_id"), ("customer_master", "o_custkey", "full_name"), ("loan_book", "o_custkey", "LOAN_DATE")])
def test_views_deal_given_rows_not_derived_ones(spark, monkeypatch, name, key, derived):
    plans = []
    monkeypatch.setattr(views, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    monkeypatch.setattr(views, "_WRITTEN", {})
    views.view(spark, "/root/testdata/sf0.001", name)
    above, below = plans[0].split("RebalancePartitions", 1)
    assert key in below.splitlines()[0] and derived in above and derived not in below


def test_pivot_sends_one_number_for_all_dimensions(spark):
    book = spark.range(2000).selectExpr(
        "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '' ELSE concat('sché', id % 13) END AS state", "CASE WHEN id % 5 > 0 THEN concat('Z', id % 11) END AS stage",
        "CAST(id % 3 AS STRING) AS sbu", "CAST(id AS DECIMAL(18,2)) / 4 AS ead", "CASE WHEN id % 9 > 0 THEN concat('L', id) END AS loan_id")
    pivot = exposure.pivot(book)
    dims = ["state", "sbu", "stage"]
    plain = book.groupBy(*dims).agg({"ead": "sum", "loan_id": "count"}).selectExpr(*dims, "CAST(`sum(ead)` AS DOUBLE)", "`count(loan_id)`")
    assert rows(pivot) == rows(plain.orderBy(*[f"`{d}`" for d in dims])) and len(rows(pivot)) > 400
    found = [r[:3] for r in map(tuple, pivot.collect())]
    assert found == sorted(found, key=lambda r: [(v is not None, v) for v in r])
    assert "hashpartitioning(__code" in pivot._jdf.queryExecution().executedPlan().toString()
    mixed = exposure.pivot(book.withColumn("sbu", book.sbu.cast("int")))  # a key that is no text keeps the plain plan
    assert [tuple(r) for r in mixed.selectExpr("state", "CAST(sbu AS STRING)", "stage", "`Sum(EAD)`", "`Count(AGREEMENTID_R)`").collect()] == [tuple(r) for r in pivot.collect()]
    assert exposure.pivot(book.limit(0)).collect() == []


def test_exposure_lines_are_dealt_once_for_parts_and_once_for_orders(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(views, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    monkeypatch.setattr(views, "_WRITTEN", {})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        views.view(spark, "/root/testdata/sf0.001", "exposure")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plans[0].splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "l_orderkey" in line)
    depth, over = len(lines[at]), []
    for line in reversed(lines[:at + 1]):  # the nodes above the scan
        inset = len(line) - len(line.lstrip(" :+-"))
        if inset < depth:
            depth = inset
            over.append(line)
    assert [line.split("(")[1].split("#")[0] for line in over if "Exchange hashpartitioning" in line] == ["l_partkey", "l_orderkey"]
