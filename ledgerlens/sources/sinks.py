"""Writers. Every one masks Aadhaar-like columns first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.documents import mask_sensitive
from ledgerlens.functions.values import ref
from ledgerlens.plans.report import JOB_FAILURES, ReportResult
from ledgerlens.session import remove

FILES_PER_FOLDER = 16


def write_parquet(df: DataFrame, path: str, masked: bool = True, partition_by: tuple[str, ...] = ()) -> None:
    """ZSTD Parquet. Canonical datasets that rules will read again are written with masked=False.

    Partitioning exposure by business_date lets the last-snapshot reports read one folder. A partitioned table is dealt by
    those columns and by row hash first, so a folder gets few files and none comes from one task alone.
    """
    out = mask_sensitive(df) if masked else df
    if partition_by:
        spread = F.pmod(F.xxhash64(*[ref(c) for c in out.columns]), F.lit(FILES_PER_FOLDER))
        out = out.repartition(*[ref(c) for c in partition_by], spread)
    out.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by | because CSV has no nested values."""
    flat = []
    for f in df.schema.fields:
        column = ref(f.name)
        if f.dataType.typeName() == "array":
            column = F.array_join(column.cast("array<string>"), "|").alias(f.name)
        flat.append(column)
    mask_sensitive(df.select(*flat)).write.mode("overwrite").option("header", True).csv(path)


def write_exceptions(wide: DataFrame, long: DataFrame, folder: str, fmt: str = "parquet") -> None:
    write = write_csv if fmt == "csv" else write_parquet
    write(wide, f"{folder}/wide")
    write(long, f"{folder}/long")


def write_reports(results: dict[str, ReportResult], folder: str) -> dict[str, str]:
    """One CSV folder per report that has rows; returns {key: path}.

    Reports are small by nature except row listings, which keep their partitions. A
    report that fails while running is noted and the rest go on; a lost job is raised.
    """
    paths = {}
    for key, result in results.items():
        if result.df is None:
            continue
        try:
            seen = Observation()  # counted while writing, so a report is worked out once
            write_csv(result.df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{folder}/{key}")
            if seen.get["rows"]:
                paths[key] = f"{folder}/{key}"
            else:
                remove(result.df.sparkSession, f"{folder}/{key}")
                result.note = "No rows found"
        except JOB_FAILURES:
            raise
        except Exception as error:
            result.note = f"Error: {error}"
    return paths


# --- Named datasets ------------------------------------------------------------------------------


def save_dataset(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").saveAsTable(name)


def load_dataset(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def drop_dataset(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def export_dataset(spark: SparkSession, name: str, path: str) -> None:
    write_csv(spark.table(name), path)


def preview(df: DataFrame, rows: int = 500) -> DataFrame:
    """The first rows as text, for display."""
    return mask_sensitive(df).limit(rows).select(*[ref(c).cast("string").alias(c) for c in df.columns])
