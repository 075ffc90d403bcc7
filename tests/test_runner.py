"""The runners: what becomes a note and what is raised."""

import pytest
from pyspark.errors import PythonException

from ledgerlens.plans import forensic
from ledgerlens.plans.report import NotAvailable, ReportResult
from ledgerlens.sources import sinks


def _lost(batches):
    raise MemoryError("worker out of memory")
    yield from batches


def test_lost_job_is_no_row(spark, monkeypatch, tmp_path):
    """A screen that runs jobs while it is planned: their failure must not become a row of the result."""
    frame = spark.range(3).selectExpr("id AS _row_num")
    monkeypatch.setitem(forensic.SCREENS, "name_similarity", lambda df: df.mapInArrow(_lost, df.schema).localCheckpoint())
    with pytest.raises(PythonException):
        forensic.run_screens(frame, ["name_similarity"])
    with pytest.raises(PythonException):
        sinks.write_reports({"lost": ReportResult("lost", frame.mapInArrow(_lost, frame.schema))}, str(tmp_path))


def test_unusable_columns_are_a_note(spark, monkeypatch):
    def lacking(df):
        raise NotAvailable("full_name column not available")

    monkeypatch.setitem(forensic.SCREENS, "name_similarity", lacking)
    monkeypatch.setitem(forensic.SCREENS, "income_benford", lambda df: df.select("absent"))
    notes = {k: r.note for k, r in forensic.run_screens(spark.range(3), ["name_similarity", "income_benford"]).items()}
    assert notes["name_similarity"] == "full_name column not available" and notes["income_benford"].startswith("Error: ")


def test_report_is_worked_out_once(spark, tmp_path):
    """A report was run to see whether it is empty, and again to be written."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches

    frame = spark.range(0, 3, 1, 1).mapInArrow(counted, "id long")
    results = {"held": ReportResult("held", frame), "none": ReportResult("none", spark.range(0))}
    assert sinks.write_reports(results, str(tmp_path)) == {"held": f"{tmp_path}/held"}
    assert runs.value == 1 and results["none"].note == "No rows found" and not (tmp_path / "none").exists()
    assert spark.read.option("header", True).csv(f"{tmp_path}/held").count() == 3
