import csv
import io
import random

import pytest

from checks import queries
from ledgerlens.plans import exposure, forensic
from ledgerlens.session import materialize, work_dir
from ledgerlens.sources import csv_files, mapping, pin_master, sinks
from ledgerlens.sources.schemas import REPORT_TYPES, struct_type


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_keeps_digits_and_quarantines(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'cust_id;Borrower_Name;account_no;lan;extra\nC1;"A; B";123456789012345678901;L1;x\nbroken\nC2;B;007;L2;y\n')
    data = csv_files.ingest_csv(spark, path, "customer_master")
    rows = {r["customer_id"]: r for r in data.accepted.collect()}
    assert rows["C1"]["bank_account"] == "123456789012345678901" and rows["C1"]["full_name"] == "A; B"
    assert rows["C2"]["bank_account"] == "007" and rows["C2"]["extra"] == "y"
    assert sorted(r["_row_num"] for r in rows.values()) == [1, 2]
    assert [r["_raw"] for r in data.rejected.collect()] == ["broken"]


def test_header_matching():
    assert mapping.exact_mapping([" PAN_No ", "Foo"], "customer_master") == {" PAN_No ": "pan"}
    assert mapping.exact_mapping(["EMI Amount", "BusinessDate"], "ead_files") == {"EMI Amount": "emi_amount", "BusinessDate": "business_date"}
    suggested = mapping.suggest_mapping(["custmer_id", "zzzz"], "customer_master", 0.8)
    assert suggested == {"custmer_id": ("customer_id", 0.95)}
    assert len(REPORT_TYPES["customer_master"]) == 25 and len(struct_type("ead_files")) == 40


def test_normalize(spark):
    df = spark.createDataFrame([("L1", "12.5", "x")], "AgreementNo string, EAD string, other string")
    out = mapping.normalize(df, "ead_files")
    assert out.dtypes == [("loan_id", "string"), ("ead", "double"), ("other", "string")]
    skipped = mapping.normalize(df, "ead_files", {"AgreementNo": "loan_id", "EAD": "__skip__"})
    assert skipped.columns == ["loan_id", "EAD", "other"]
    with pytest.raises(ValueError):
        mapping.normalize(df, "ead_files", {"AgreementNo": "loan_id", "other": "loan_id"})
    assert mapping.normalize(df, "unknown").columns == df.columns
    fuzzy = mapping.normalize(df.withColumnRenamed("other", "dpd_buckets"), "ead_files", threshold=0.8)
    assert fuzzy.columns == ["loan_id", "ead", "dpd_bucket"]


def test_validate(spark):
    df = spark.createDataFrame([("C1", None), ("C2", "x")], "customer_id string, foo string")
    facts = mapping.validate(df, "customer_master")
    assert facts.missing_required == ["full_name", "lan"] and facts.unmapped == ["foo"]
    assert facts.nulls == {"customer_id": 0, "foo": 1} and not facts.ok
    assert not mapping.validate(df.limit(0), "unknown").ok


def test_consolidate_aligns_layouts(spark, tmp_path):
    a = write(tmp_path / "a.csv", "id,name,city\n1,ann,Pune\n")
    b = write(tmp_path / "b.csv", "Name,naam2,id\nbob,zz,2\n")
    merged = csv_files.consolidate(spark, [a, b]).accepted
    got = {r["id"]: (r["name"], r["city"], r["_source_file"]) for r in merged.collect()}
    assert got == {"1": ("ann", "Pune", "a.csv"), "2": ("bob", None, "b.csv")}
    assert csv_files.align(["naam"], ["name"], 0.6) == {"name": "naam"}
    assert csv_files.align(["qqq"], ["name"], 0.6) == {"name": None}
    assert csv_files.unified_columns([["A", "b"], ["a", "C"]]) == ["A", "b", "C"]
    assert csv_files.header_signature(["x", "y"]) == csv_files.header_signature(["y", "x"])


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", "customer_id,full_name\nC1,ANN\nC9,x,y\n")
    write(folder / "b.csv", "full_name,customer_id\nBOB,C2\n")
    write(folder / "c.csv", "customer_id;full_name\nC3;CAT\n")
    write(folder / "d.csv", "full_name,city\nDAN,Pune\n")
    write(folder / "e.csv", "")
    want = {("C1", "ANN", None), ("C2", "BOB", None), ("C3", "CAT", None), (None, "DAN", "Pune")}
    for data in (csv_files.consolidate(spark, [str(folder)]), csv_files.read_csv(spark, str(folder))):
        assert {(r["customer_id"], r["full_name"], r["city"]) for r in data.accepted.collect()} == want
        [reject] = data.rejected.collect()
        assert (reject["_raw"], reject["_source_file"]) == ("C9,x,y", "a.csv")
    numbered = csv_files.ingest_csv(spark, str(folder), "customer_master").accepted.orderBy("_row_num").collect()
    assert [(r["_row_num"], r["full_name"]) for r in numbered] == [(1, "ANN"), (2, "BOB"), (3, "CAT"), (4, "DAN")]
    with pytest.raises(ValueError):
        csv_files.read_csv(spark, str(folder / "e.csv"))


@pytest.mark.parametrize("split", ["20000", "128m"])
def test_rows_are_numbered_in_file_order(spark, tmp_path, split):
    paths, line = [], 0
    for name, rows in (("z", 3000), ("a", 10), ("m", 5000)):
        text = ["lan,full_name"]
        for i in range(rows):
            line += 1
            text.append(f"{line}," + "x" * (line % 97))
            if i % 500 == 7:
                text.append("one,two,three")
        paths.append(write(tmp_path / f"{name}.csv", "\n".join(text) + "\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        data = csv_files.ingest_csv(spark, paths, "customer_master")
        assert data.accepted.count() == line and data.accepted.filter("_row_num <> CAST(lan AS LONG)").count() == 0
        assert data.rejected.count() == 6 + 1 + 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_every_sink_masks(spark, tmp_path):
    df = spark.createDataFrame([("2341 2341 2346", ["a", "b"])], "Aadhar_No string, tags array<string>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()[:] == ("XXXXXXXX2346", "a|b")
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert sinks.read_parquet(spark, str(tmp_path / "p")).first()[0] == "XXXXXXXX2346"
    assert sinks.preview(df).first()[0] == "XXXXXXXX2346"


def test_reports_are_written_and_failures_noted(spark, tmp_path):
    book = spark.createDataFrame([("1", "L1", 5.0)], "stage string, loan_id string, ead double")
    results = exposure.run_exposure_reports(book, ["stage_summary", "fvtpl", "stage_mismatch"])
    paths = sinks.write_reports(results, str(tmp_path))
    assert set(paths) == {"stage_summary"}
    assert "not available" in results["fvtpl"].note


def test_pin_master(spark, tmp_path):
    path = write(tmp_path / "pins.csv", "Pincode,OfficeName,District,StateName,CircleName\n110001,GPO, Central Delhi ,DELHI,Delhi\n1100,x,y,z,w\n")
    [row] = pin_master.build_pin_master(spark, path).collect()
    assert (row["pincode"], row["district"], row["state_name"]) == ("110001", "central delhi", "delhi")


def test_preview_query_shows_the_first_rows_of_the_whole_view(spark, monkeypatch):
    view = spark.range(1, 1201).selectExpr("1201 - id AS _row_num", "'234123412346' AS aadhaar").repartition(7)
    monkeypatch.setattr(queries, "view", lambda *_: view)
    got = queries.queries()["preview_first"](spark, "").collect()
    assert sorted(int(r["_row_num"]) for r in got) == list(range(1, 501)) and {r["aadhaar"] for r in got} == {"XXXXXXXX2346"}


def test_every_screen_is_run_and_counted(spark, monkeypatch):
    people = [(i, name, "560001", f"P{i}") for i, name in enumerate(["Anita Sharma", "Anita Sharmaa", "Zubin Quox"])]
    view = spark.createDataFrame(people, "_row_num long, full_name string, pincode string, pan string")
    monkeypatch.setattr(queries, "view", lambda *_: view)
    got = {r["screen"]: r["rows"] for r in queries.queries()["screens_run_every"](spark, "").collect()}
    assert set(got) == set(forensic.SCREENS) and got["name_similarity"] == forensic.name_similarity(view, top_n=None).count() == 1


def test_every_layout_is_written_by_several_tasks(spark, monkeypatch):
    view = spark.range(1, 901).selectExpr("id AS _row_num", "concat('C', id) AS customer_id", "'x' AS lan")
    monkeypatch.setattr(queries, "view", lambda *_: view)
    seen = []
    real = csv_files.consolidate
    monkeypatch.setattr(csv_files, "consolidate", lambda s, paths: seen.extend(paths) or real(s, paths))
    assert queries.queries()["consolidate"](spark, "").count() == 840
    assert [len(spark.read.text(p).inputFiles()) for p in seen] == [5, 5, 5]


def test_sniffing_respects_quotes():
    assert csv_files.sniff('"a;b;c;d",x\n"1;2",3\n') == csv_files.Layout(("a;b;c;d", "x"), ",")
    assert csv_files.sniff('name\n"Pune, India; near"\n') == csv_files.Layout(("name",), ",")
    assert csv_files.sniff("a|b|c\n1|2,5|3\n4|5,5|6\n") == csv_files.Layout(("a", "b", "c"), "|")
    assert csv_files.sniff('"x\ny";z\n1;2\n') == csv_files.Layout(("x\ny", "z"), ";")
    assert csv_files.sniff("") == csv_files.Layout((), ",")
    assert csv_files.sniff("a;b\n", ",") == csv_files.Layout(("a;b",), ",")


def test_many_files_are_read_by_their_headers(spark, tmp_path):
    import gzip

    for i in range(300):
        write(tmp_path / f"f{i:04d}.csv", f"id;name\n{i};n{i}\n" if i % 3 else f"name,id\nn{i},{i}\n")
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"id|name\n300|n300\n"))
    write(tmp_path / "empty.csv", "")
    data = csv_files.read_csv(spark, str(tmp_path))
    assert {(r["id"], r["name"]) for r in data.accepted.collect()} == {(str(i), f"n{i}") for i in range(301)}
    assert data.rejected.count() == 0


@pytest.mark.parametrize("split", ["200b", "1000b", "128m"])
def test_quoted_line_breaks_across_splits(spark, tmp_path, split):
    rng, rows = random.Random(6), []
    for i in range(400):
        note = rng.choice(["plain", "two\nlines", 'a "quoted" word', "many\n\n\nbreaks, and\n\"more\"\n", "x" * 150 + "\n" + "y" * 150, "", "\n"])
        rows.append((str(i), note, f"L{i}"))
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("customer_id", "address_line1", "lan"), *rows])
    text = out.getvalue() + "\n   \nbroken,row\n"
    path = write(tmp_path / "a.csv", text)
    with open(path, "ab") as f:
        f.write(b'last,"open\nquote')
    second = write(tmp_path / "b.csv", 'customer_id,address_line1,lan\nB1,"x\ny",LB\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        data = csv_files.ingest_csv(spark, [path, second], "customer_master", multi_line=True)
        got = sorted((r["_row_num"], r["customer_id"], r["address_line1"] or "", r["lan"]) for r in data.accepted.collect())
        rejected = sorted(r["_raw"] for r in data.rejected.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i + 1, *r) for i, r in enumerate([*rows, ("B1", "x\ny", "LB")])]
    assert rejected == ["broken,row", 'last,"open\nquote']


def _checked_view(spark, name):
    from checks import views

    key = (spark.sparkContext.applicationId, "/root/testdata/sf0.001", name)
    views._WRITTEN.pop(key, None)
    return views.view(spark, key[1], name), lambda: views._WRITTEN.pop(key, None)


def test_views_are_dealt_into_parts_by_size(spark):
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "32k", "adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        book, forget = _checked_view(spark, "exposure")
        assert len(book.inputFiles()) > 2 * spark.sparkContext.defaultParallelism
        forget()
    finally:
        for k, v in kept.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_more_rows_make_more_files(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 100)
    got = queries.queries()["ingest_roundtrip"](spark, "/root/testdata/sf0.001")
    rows = got.count()
    assert got.select("_row_num").distinct().count() == rows == got.agg({"_row_num": "max"}).first()[0]
    folder = f"{work_dir(spark)}/extracts-{spark.sparkContext.applicationId}/ingest"
    assert len(spark.read.text(folder).inputFiles()) == -(-rows // 100)


def test_intermediate_tables_are_packed(spark):
    wide = spark.range(200_000).selectExpr("concat('C', lpad(cast(id as string), 8, '0')) AS id", "concat('CUSTOMER ', cast(id % 97 * 7919 as string)) AS name")
    files = materialize(wide.coalesce(1), "packed").inputFiles()
    assert [f.endswith(".zstd.parquet") for f in files] == [True]
