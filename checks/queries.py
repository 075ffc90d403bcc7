"""One callable per operator over the lender views; each returns a lazy or written DataFrame."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import BLOCK_ROWS, ENGAGEMENT, LONGER_LINE, RUN, SALT
from checks.views import view
from ledgerlens.functions.values import rounded
from ledgerlens.operators import bitmaps, sketches
from ledgerlens.plans import customer, duplicates, engine, exposure, forensic, identity, loan_book, outputs
from ledgerlens.plans import row_rules, sampling
from ledgerlens.plans.addresses import AddressBook
from ledgerlens.session import materialize, row_count, work_dir
from ledgerlens.sources import csv_files, mapping, pin_master, sinks

AS_OF = datetime.date(2024, 12, 31)
RANK_ERROR = 0.005
FILE_ROWS = 250_000
Query = Callable[[SparkSession, str], DataFrame]


def _exposure_query(key: str, **options) -> Query:
    return lambda spark, sf: exposure.report(view(spark, sf, "exposure"), key, **options)


def _on(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(view(spark, sf, name))


def _stacked(name: str, frames: dict[str, DataFrame]) -> DataFrame:
    """The rows of several frames under all their columns, told apart by a column of that name."""
    merged = None
    for key, frame in frames.items():
        one = frame.select(F.lit(key).alias(name), "*")
        merged = one if merged is None else merged.unionByName(one, allowMissingColumns=True)
    return merged


def _exposure_queries() -> dict[str, Query]:
    options = {"disbursement": {"period_from": "1996-04-01", "period_to": "1997-03-31"}}
    q = {f"ead_{k}": _exposure_query(k, **options.get(k, {})) for k in exposure.REPORTS}

    def merged(spark, sf):
        book = view(spark, sf, "exposure")
        months = {"feb": "2001-02-28", "mar": "2001-03-31"}
        both = exposure.merge_extracts({m: book.filter(F.col("business_date") == d) for m, d in months.items()})
        return both.groupBy("_source_file", "stage").agg(
            F.count("loan_id").alias("loans"), F.sum("ead").cast("double").alias("Total EAD")
        )

    def run_all(spark, sf):
        """Every report through the runner: its rows, or the note why it has none."""
        results = exposure.run_exposure_reports(view(spark, sf, "exposure"), None, "1996-04-01", "1997-03-31")
        return _stacked("report", {k: r.as_frame(spark) for k, r in results.items()})

    def report_files(spark, sf):
        """Every report written as CSV and read back."""
        results = exposure.run_exposure_reports(view(spark, sf, "exposure"), None, "1996-04-01", "1997-03-31")
        paths = sinks.write_reports(results, f"{work_dir(spark)}/reports-{spark.sparkContext.applicationId}")
        read = {k: spark.read.schema(results[k].df.schema).option("header", True).csv(path) for k, path in paths.items()}
        return _stacked("report", read)

    q["ead_run_all"] = run_all
    q["ead_report_files"] = report_files
    q["ead_stats"] = _on("exposure", exposure.summary_stats)
    q["ead_months"] = _on("exposure", exposure.snapshot_months)
    q["ead_dates"] = _on("exposure", exposure.snapshot_dates)
    q["ead_scaled"] = _on("exposure", lambda e: exposure.scale_units(exposure.report(e, "state_ead"), "lakh").select(
        "State", "Loan Count", "Total EAD", "Total Provision", "Coverage %"))
    q["ead_merged"] = merged
    return q


# --- Rules ---------------------------------------------------------------------------------------


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """All row rules over the whole customer master, written once."""
    chosen = [r for r in engine.RULE_ORDER if r in row_rules.ROW_RULES]
    master = view(spark, sf, "customer_master")
    return materialize(row_rules.apply_row_rules(master, chosen, view(spark, sf, "pin_master"), AS_OF), "checked")


def _rule_query(rule: str) -> Query:
    def run(spark, sf):
        pins = view(spark, sf, "pin_master")
        return outputs.long_exceptions(
            row_rules.apply_row_rules(view(spark, sf, "customer_master"), [rule], pins, AS_OF)
        )

    return run


def _wide(spark, sf) -> DataFrame:
    return outputs.wide_exceptions(_checked(spark, sf))


def _long(spark, sf) -> DataFrame:
    return outputs.long_exceptions(_checked(spark, sf))


def _output_queries() -> dict[str, Query]:
    rules = [r for r in engine.RULE_ORDER if r in row_rules.ROW_RULES]

    def exc_severity(spark, sf):
        return sampling.with_stratum(_wide(spark, sf)).groupBy("stratum").agg(F.count("*").alias("rows"))

    def control_tests(spark, sf):
        wide = _wide(spark, sf)
        return outputs.control_tests(sampling.select_sample(wide, ENGAGEMENT, RUN), wide)

    return {
        "exc_long": _long,
        "exc_wide": _wide,
        "exc_status": lambda s, d: outputs.status_counts(_wide(s, d)),
        "exc_codes": lambda s, d: outputs.exception_codes(_wide(s, d)),
        "exc_missing": lambda s, d: outputs.missing_summary(_long(s, d), view(s, d, "customer_master")),
        "missing_detail": lambda s, d: outputs.missing_detail(_long(s, d)),
        "exc_summary": lambda s, d: outputs.exception_summary(_wide(s, d)),
        "exc_severity": exc_severity,
        "procedures": lambda s, d: outputs.procedures(_long(s, d), rules, view(s, d, "customer_master")),
        "reconciliation": lambda s, d: outputs.reconciliation(view(s, d, "customer_master"), _wide(s, d)),
        "detailed": lambda s, d: outputs.detailed_exceptions(_wide(s, d)),
        "completeness": lambda s, d: outputs.field_completeness(_wide(s, d)),
        "lorenz": lambda s, d: outputs.lorenz_points(_wide(s, d)),
        "field_coverage": _on("customer_master", outputs.field_coverage),
        "sample_severity": lambda s, d: sampling.stratum_summary(_wide(s, d)),
        "sample_sizes": lambda s, d: sampling.segment_sample_sizes(_wide(s, d), "branch_code"),
        "sample_selected": lambda s, d: sampling.select_sample(_wide(s, d), ENGAGEMENT, RUN),
        "control_tests": control_tests,
    }


# --- Identity and duplicates ---------------------------------------------------------------------


def _finding(df: DataFrame) -> DataFrame:
    return df.select("_row_num", "finding.status", "finding.code", "finding.desc")


def _duplicate_query(rule: str) -> Query:
    return _on("customer_master", lambda m: _finding(duplicates.duplicate_findings(m, [rule], SALT, "none")))


def _scope_query(scope: str) -> Query:
    kinds = [k for k, *_ in duplicates.DUPLICATE_RULES.values()]

    def run(master: DataFrame) -> DataFrame:
        grouped = master.withColumns({"ucid": F.col("branch_code"), "lan": F.col("onboarding_date")})
        return duplicates.flagged_rows(grouped, kinds, SALT, scope).select("_row_num", "kind", "key")

    return _on("customer_master", run)


def _with_ucid(master: DataFrame) -> DataFrame:
    return identity.ucid_columns(master, identity.unique_customers(master, SALT, AddressBook(master)))


def _ucid_by_key(master: DataFrame) -> DataFrame:
    """Names by identity key, found with the rows numbered the other way round."""
    turned = master.withColumn("_row_num", F.lit(10 ** 12) - F.col("_row_num"))
    grouped = identity.unique_customers(turned, SALT, AddressBook(turned), id_by="key")
    named = identity.ucid_columns(turned, grouped, identity.single_name(turned, SALT, "key"))
    return named.select((F.lit(10 ** 12) - F.col("_row_num")).alias("_row_num"), "ucid", "ucid_size")


def _ucid_by_blocks(master: DataFrame) -> DataFrame:
    grouped = identity.unique_customers(master, SALT, AddressBook(master), listed_members=BLOCK_ROWS)
    named = identity.ucid_columns(master, grouped, identity.single_name(master, SALT, listed_members=BLOCK_ROWS))
    return named.select("_row_num", "ucid", "ucid_size")


def _audit(spark, sf) -> DataFrame:
    return engine.run_rules(
        view(spark, sf, "customer_master"), SALT, pin_master=view(spark, sf, "pin_master"), as_of=AS_OF
    )


def _with_longer_lines(master: DataFrame) -> DataFrame:
    """The lines that differ in the flat alone, with thirty words."""
    line = F.col("address_line1")
    return master.withColumn("address_line1", F.when(line.startswith("FLAT"), F.concat(line, F.lit(f" {LONGER_LINE}"))).otherwise(line))


def _identity_queries() -> dict[str, Query]:
    q = {f"dup_{r.removesuffix('_duplicate')}": _duplicate_query(r) for r in duplicates.DUPLICATE_RULES}
    q["dup_scope_person"] = _scope_query("person")
    q["dup_scope_observed"] = _scope_query("observed")
    q["dup_address"] = _on(
        "customer_master", lambda m: _finding(duplicates.address_findings(AddressBook(m).duplicate_rows()))
    )
    q["dup_address_long"] = _on("customer_master", lambda m: _finding(duplicates.address_findings(AddressBook(_with_longer_lines(m)).duplicate_rows())))
    q["ucid"] = _on("customer_master", lambda m: _with_ucid(m).select("_row_num", "ucid", "ucid_size"))
    q["ucid_key"] = _on("customer_master", _ucid_by_key)
    q["ucid_blocks"] = _on("customer_master", _ucid_by_blocks)
    for scope in ("person", "observed"):
        q[f"dup_{scope}_ucid"] = _on("customer_master", lambda m, scope=scope: duplicates.flagged_rows(
            _with_ucid(m), [k for k, *_ in duplicates.DUPLICATE_RULES.values()], SALT, scope).select("_row_num", "kind", "key"))
    q["ucid_kyc"] = _on("customer_master", lambda m: _with_ucid(m).filter("__ucid_finding is not null").select(
        "_row_num", "__ucid_finding.status", "__ucid_finding.code", "__ucid_finding.desc"))
    q["beneficiary"] = _on(
        "customer_master", lambda m: identity.beneficiary_columns(m, SALT).select("_row_num", "customer_key", "group_id")
    )
    q["audit_long"] = lambda s, d: outputs.long_exceptions(_audit(s, d))
    return q


# --- Customer, forensic and loan book ------------------------------------------------------------


def _customer_queries() -> dict[str, Query]:
    q = {f"cm_{k}": _on("customer_master", build) for k, build in {**customer.REPORTS, **forensic.SCREENS}.items()}
    q["cm_demographic_distribution"] = _on(
        "customer_master", lambda m: customer.demographic_distribution(m, as_of=AS_OF)
    )
    # one customer per address is the rule in these tables, so the screen starts at two
    q["cm_address_clustering"] = _on("customer_master", lambda m: forensic.address_clustering(m, threshold=1))
    q["cm_cluster_distribution"] = _on("customer_master", lambda m: customer.cluster_distribution(_with_ucid(m)))

    def duplication(spark, sf):
        master = view(spark, sf, "customer_master")
        rows = duplicates.duplicate_findings(master, list(duplicates.DUPLICATE_RULES), SALT, "none")
        return customer.duplication_summary(rows.select("finding.rule_id", "finding.status"))

    q["cm_duplication_summary"] = duplication

    def breakdown(spark, sf):
        """Rows per duplicate code of the whole master."""
        checked = engine.run_rules(view(spark, sf, "customer_master"), SALT, list(duplicates.DUPLICATE_RULES), scope="none")
        return outputs.duplicate_breakdown(outputs.wide_exceptions(checked))

    q["duplicate_breakdown"] = breakdown

    def screens(spark, sf):
        """Every screen through the runner, with the one option that the tables need."""
        results = forensic.run_screens(view(spark, sf, "customer_master"), options={"address_clustering": {"threshold": 1}})
        return _stacked("screen", {k: r.as_frame(spark) for k, r in results.items()})

    def every_screen(spark, sf):
        """Every screen through the runner with its own options, counted."""
        results = forensic.run_screens(view(spark, sf, "customer_master"))
        counted = [r.as_frame(spark).agg(F.count("*").alias("rows")).select(F.lit(k).alias("screen"), "rows") for k, r in results.items()]
        merged = counted[0]
        for frame in counted[1:]:
            merged = merged.unionByName(frame)
        return merged

    def merged_months(spark, sf):
        """Customers by place, from bitmaps added year by year."""
        placed = view(spark, sf, "customer_master").filter(F.col("state").isNotNull())
        year = F.substring("onboarding_date", 1, 4)
        counts = bitmaps.DistinctCounts("customer_id", ("state", "district"))
        for y in sorted(r[0] for r in placed.select(year.alias("y")).distinct().collect()):  # a few years
            counts.add(placed.filter(year == y))
        return counts.counts("Customer Count")

    q["cm_geographic_merged"] = merged_months
    q["screens_run_all"] = screens
    q["screens_run_every"] = every_screen
    return q


def _book(spark, sf) -> DataFrame:
    flagged = loan_book.detect_exceptions(view(spark, sf, "loan_book"), AS_OF)
    return loan_book.recency_weight(flagged)[0]


def _book_queries() -> dict[str, Query]:
    def fences(spark, sf):
        columns = list(loan_book.OUTLIERS.values())
        numbers = view(spark, sf, "loan_book").select(*[F.col(c).cast("double").alias(c) for c in columns])
        found = loan_book.iqr_fences(numbers, columns)
        return spark.createDataFrame(
            [(c, low, high) for c, (low, high) in found.items()], "measure string, low double, high double"
        )

    def quartiles_by_sketch(spark, sf):
        """Quartiles from sketches kept per branch and merged, and whether their true ranks are within the stated error."""
        columns = list(loan_book.OUTLIERS.values())
        book = view(spark, sf, "loan_book")
        kept = materialize(sketches.quantile_sketches(book, columns, RANK_ERROR, ("BRANCH",)), "branch-sketches")
        both = F.array(*[F.struct(F.lit(q).alias("share"), sketches.quantile("sketch", q).alias("value")) for q in (0.25, 0.75)])
        wanted = materialize(sketches.merged_sketches(kept).select("measure", "values", F.inline(both)), "sketched-quartiles")
        stacked = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("own")) for c in columns])
        ranks = book.select(F.inline(stacked)).join(F.broadcast(wanted), "measure").groupBy("measure", "share", "values").agg(
            F.count_if(F.col("own") < F.col("value")).alias("below"), F.count_if(F.col("own") <= F.col("value")).alias("upto"))
        slack = RANK_ERROR * F.col("values")
        inside = (F.col("below") <= F.col("share") * F.col("values") + slack) & (F.col("upto") >= F.col("share") * F.col("values") - slack)
        return ranks.select("measure", "share", "values", inside.alias("within_error"))

    def random(spark, sf):
        clean = _book(spark, sf).filter("IS_EXCEPTION = 0")
        pool = clean.join(loan_book.sample_strata(clean).select("ROW_ID"), "ROW_ID", "left_anti")
        return loan_book.sample_random(pool, 200).select("ROW_ID", "SELECTION_REASON")

    def summary(spark, sf):
        """The figures behind the sample, one a line."""
        figures = loan_book.audit_sample(view(spark, sf, "loan_book"), AS_OF)[1]
        names = "population_total clean_records exceptions_sampled strata_covered random_sampled total_sample_size".split()
        lines = [(n, "", figures[n]) for n in names]
        for name, one in figures["per_class"].items():
            if one["found"]:
                lines += [("found", name, one["found"]), ("sampled", name, one["sampled"])]
        return spark.createDataFrame(lines, "figure string, class string, n long")

    return {
        "sample_fences": fences,
        "sample_quartiles_by_sketch": quartiles_by_sketch,
        "sample_flags": lambda s, d: loan_book.detect_exceptions(view(s, d, "loan_book"), AS_OF).select(
            "ROW_ID", "EXCEPTION_FLAGS", "IS_EXCEPTION"),
        "sample_weight": lambda s, d: loan_book.recency_weight(view(s, d, "loan_book"))[0].select(
            "ROW_ID", rounded(F.col("RECENCY_WEIGHT"), 8).alias("RECENCY_WEIGHT")),
        "sample_strata": lambda s, d: loan_book.sample_strata(_book(s, d).filter("IS_EXCEPTION = 0")).select(
            "ROW_ID", "SELECTION_REASON"),
        "sample_random": random,
        "sample_candidates": lambda s, d: loan_book.class_candidates(_book(s, d)),
        "sample_book_rows": lambda s, d: loan_book.audit_sample(view(s, d, "loan_book"), AS_OF)[0].select(
            "ROW_ID", "SELECTION_REASON", "EXCEPTION_FLAGS"),
        "sample_summary": summary,
        "sample_book": lambda s, d: loan_book.audit_sample(view(s, d, "loan_book"), AS_OF)[0],
    }


# --- Sources -------------------------------------------------------------------------------------


def _source_queries() -> dict[str, Query]:
    def folder(spark: SparkSession, name: str) -> str:
        return f"{work_dir(spark)}/extracts-{spark.sparkContext.applicationId}/{name}"

    def export(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(path)

    def files_of(master: DataFrame) -> int:
        """Five files, or more where they would hold over FILE_ROWS rows of the master."""
        return max(5, math.ceil((row_count(master) or master.count()) / FILE_ROWS))

    def spread(df: DataFrame, path: str, files: int = 5, **options) -> None:
        """Several files whose names follow the order of the rows."""
        df.repartitionByRange(files, "_row_num").sortWithinPartitions("_row_num").drop("_row_num").write.mode("overwrite").options(
            header=True, **options).csv(path)

    def ingest_roundtrip(spark, sf):
        """All columns and the numbers, which follow the files whatever their splits."""
        path = folder(spark, "ingest")
        names = {"customer_id": "Cust_ID", "full_name": "Borrower_Name", "bank_account": "Account_No", "lan": "Loan_Account_No"}
        master = view(spark, sf, "customer_master")
        spread(master.withColumnsRenamed(names), path, files_of(master))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")  # many splits a file, packed by size
        try:
            # the plan is made here, with these splits
            return materialize(csv_files.ingest_csv(spark, path, "customer_master").accepted, "ingested")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    def normalize_ead(spark, sf):
        """Every column as text, some by another accepted name."""
        book = view(spark, sf, "exposure")
        names = {"loan_id": "AgreementNo", "stage": "ECL_Stage", "ead": "Exposure", "written_off": "WrittenOff", "sanction_amount": "Sanctioned_Amount"}
        texts = book.select(*[F.col(c).cast("string").alias(names.get(c, c)) for c in book.columns])
        return mapping.normalize(texts, "ead_files")

    def layouts(spark, sf) -> csv_files.CsvData:
        """The customer master in three layouts: headers in another order, another delimiter, and one with broken lines."""
        master = view(spark, sf, "customer_master")
        columns = [c for c in master.columns if c != "_row_num"]
        a, b, c = (folder(spark, f"layout-{x}") for x in "abc")
        files = files_of(master)
        spread(master.filter("_row_num % 3 = 0"), a, files)
        spread(master.filter("_row_num % 3 = 1").select("_row_num", *reversed(columns)), b, files, sep=";")
        line = F.concat_ws(",", *[F.coalesce(F.col(n), F.lit("")) for n in columns])
        broken = F.when(F.col("_row_num") % 15 == 2, F.concat(line, F.lit(",one,two"))).otherwise(line)
        lines = master.filter("_row_num % 3 = 2").select("_row_num", broken.alias("value"))
        head = ",".join(columns)

        def headed(batches):
            """A header in front of the lines of every file."""
            for number, batch in enumerate(batches):
                if not number:
                    yield pa.record_batch([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
                yield batch

        ordered = lines.repartitionByRange(files, "_row_num").sortWithinPartitions("_row_num").select("value")
        ordered.mapInArrow(headed, "value string").write.mode("overwrite").text(c)
        return csv_files.consolidate(spark, [a, b, c])

    def layout() -> Column:
        return F.regexp_extract("_source_path", "/layout-([abc])/", 1).alias("layout")

    def consolidate(spark, sf):
        merged = layouts(spark, sf).accepted
        return merged.select("*", layout()).drop("_source_file", "_source_path")

    def consolidate_rejects(spark, sf):
        return layouts(spark, sf).rejected.select(layout(), "_raw", "_reject_reason")

    def ingest_multi_line(spark, sf):
        """Quoted line breaks and quotes in a column, in files of many splits."""
        path = folder(spark, "multi-line")
        broken = F.when(F.col("_row_num") % 3 == 0, F.concat("address_line1", F.lit('\nfloor "'), F.col("_row_num").cast("string"), F.lit('"\n\nrear')))
        master = view(spark, sf, "customer_master")
        lines = master.select(
            "_row_num", "customer_id", "full_name", "lan", F.coalesce(broken, "address_line1").alias("address_line1"), "city")
        spread(lines, path, files_of(master), escape='"')
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        try:
            return materialize(csv_files.ingest_csv(spark, path, "customer_master", multi_line=True).accepted, "ingested")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    def null_counts(spark, sf):
        facts = mapping.validate(view(spark, sf, "customer_master"), "customer_master")
        return spark.createDataFrame(list(facts.nulls.items()), "column string, nulls long")

    def pin_build(spark, sf):
        """The directory from its CSV form, in file order."""
        path = folder(spark, "pins")
        pins = view(spark, sf, "pin_master").select(
            F.col("pincode").alias("Pincode"), F.concat(F.lit("  "), F.upper("district")).alias("District"),
            F.upper("state_name").alias("StateName"), F.col("pincode").cast("long").alias("_row_num"))
        spread(pins, path)
        return pin_master.build_pin_master(spark, path)

    def written_parquet(spark, sf):
        path = folder(spark, "canonical")
        sinks.write_parquet(view(spark, sf, "customer_master"), path)
        return sinks.read_parquet(spark, path)

    def dataset_csv(spark, sf):
        """A named dataset saved, exported as CSV and dropped."""
        name, path = "ledgerlens_check_dataset", folder(spark, "dataset")
        sinks.save_dataset(view(spark, sf, "customer_master"), name)
        sinks.export_dataset(spark, name, path)
        rows = sinks.load_dataset(spark, name).count()
        sinks.drop_dataset(spark, name)
        return spark.read.option("header", True).csv(path).withColumn("saved_rows", F.lit(rows))

    def exception_sinks(spark, sf):
        """Both exception tables written and read back."""
        path = folder(spark, "exceptions")
        checked = _checked(spark, sf)
        sinks.write_exceptions(outputs.wide_exceptions(checked), outputs.long_exceptions(checked), path)
        wide, long = (sinks.read_parquet(spark, f"{path}/{part}") for part in ("wide", "long"))
        return _stacked("part", {"wide": wide, "long": long})

    def preview_first(spark, sf):
        """The operator's own number of rows, of the whole view."""
        return sinks.preview(view(spark, sf, "customer_master").orderBy("_row_num"))

    def pin_lookup(spark, sf):
        located = row_rules.with_pin_lookup(view(spark, sf, "customer_master"), view(spark, sf, "pin_master"))
        return located.filter(F.col(row_rules.PIN_KNOWN)).select(
            "_row_num", F.col(row_rules.PIN_STATE).alias("state_name"), F.col(row_rules.PIN_DISTRICT).alias("district")
        )

    return {
        "ingest_roundtrip": ingest_roundtrip,
        "ingest_multi_line": ingest_multi_line,
        "normalize_ead": normalize_ead,
        "consolidate": consolidate,
        "consolidate_rejects": consolidate_rejects,
        "pin_build": pin_build,
        "written_parquet": written_parquet,
        "dataset_csv": dataset_csv,
        "exception_sinks": exception_sinks,
        "preview_first": preview_first,
        "null_counts": null_counts,
        "pin_lookup": pin_lookup,
    }


def queries() -> dict[str, Query]:
    return {
        **_exposure_queries(),
        **{f"rule_{r}": _rule_query(r) for r in row_rules.ROW_RULES},
        **_output_queries(),
        **_identity_queries(),
        **_customer_queries(),
        **_book_queries(),
        **_source_queries(),
    }
