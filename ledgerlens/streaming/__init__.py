"""Row rules on a stream.

The rest of an audit is batch work; row rules are stateless columns, so they take a streaming frame as it is, with the
PIN directory as a static side.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.documents import mask_sensitive
from ledgerlens.plans.outputs import long_exceptions
from ledgerlens.plans.row_rules import ROW_RULES, apply_row_rules

__all__ = ["apply_row_rules", "start_exceptions"]


def start_exceptions(
    rows: DataFrame,
    folder: str,
    rules: list[str] | None = None,
    pin_master: DataFrame | None = None,
    as_of: datetime.date | None = None,
    **trigger,
) -> StreamingQuery:
    """Append the findings of the row rules to Parquet files in a folder, each arriving row once.

    The checkpoint is kept beside the files, so a restarted stream goes on where it was. `trigger` is passed
    on, such as availableNow=True or processingTime="1 minute".
    """
    found = long_exceptions(apply_row_rules(rows, rules or list(ROW_RULES), pin_master, as_of))
    writer = mask_sensitive(found).writeStream.format("parquet").outputMode("append").option("compression", "zstd")
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", f"{folder}/_checkpoint").start(f"{folder}/exceptions")
