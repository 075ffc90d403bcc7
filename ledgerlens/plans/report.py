"""What a report is: a lazy frame, or a reason why it cannot run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PythonException, QueryExecutionException, UnknownException
from pyspark.sql import DataFrame

# What Spark raises when a job is lost (memory, executors, Python workers), in contrast to columns or values that a report can't use.
JOB_FAILURES = (Py4JError, PythonException, QueryExecutionException, UnknownException, MemoryError)


class NotAvailable(Exception):
    """A report cannot run on these columns; the message says what is missing."""


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise NotAvailable(f"{' and '.join(missing)} column not available")


@dataclass
class ReportResult:
    key: str
    df: DataFrame | None
    note: str | None = None

    def as_frame(self, spark) -> DataFrame:
        """The report itself, or a one-row `note` frame in its place."""
        if self.df is not None:
            return self.df
        return spark.createDataFrame([(self.note,)], "note string")


def plan_report(key: str, build: Callable[..., DataFrame], df: DataFrame, **options) -> ReportResult:
    """Build one lazy report; a failure stays with that report and becomes its note, but a lost job is raised, as it says nothing about the report."""
    try:
        return ReportResult(key, build(df, **options))
    except NotAvailable as reason:
        return ReportResult(key, None, str(reason))
    except JOB_FAILURES:
        raise
    except Exception as error:  # a broken report must not take the others down
        return ReportResult(key, None, f"Error: {error}")


def asc(*names: str):
    from pyspark.sql import functions as F

    return [F.col(f"`{n}`").asc_nulls_first() for n in names]


def desc(*names: str):
    from pyspark.sql import functions as F

    return [F.col(f"`{n}`").desc_nulls_first() for n in names]
