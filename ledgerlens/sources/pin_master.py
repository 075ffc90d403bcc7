"""The PIN-code directory the address rules look up, from a user-supplied CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.values import ref
from ledgerlens.sources import csv_files

# Headers of the directory and the names they get here.
COLUMNS = {
    "Pincode": "pincode",
    "District": "district",
    "StateName": "state_name",
    "CircleName": "circle_name",
    "OfficeName": "office_name",
}


def build_pin_master(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lower-case, trimmed directory lines with six-character codes, in file order by _row_num."""
    files = csv_files.list_files(spark, [path] if isinstance(path, str) else list(path))
    raw = csv_files._read(spark, files, False, ",").accepted
    tidy = [
        (ref(c) if c == "Pincode" else F.lower(F.trim(ref(c)))).alias(name)
        for c, name in COLUMNS.items()
        if c in raw.columns
    ]
    lines = raw.select(*tidy, csv_files.SOURCE_PATH, csv_files.BLOCK)
    return csv_files.number_in_file_order(lines, files).drop(csv_files.SOURCE_PATH).filter(F.length("pincode") == 6)
