"""Joins from rows to per-key statistics that survive a key holding much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import is_written, materialize, row_count

# A key is hot when it holds more than one row in HOT_SHARE, so there are fewer than
# HOT_SHARE hot keys whatever the table size: that bounds the broadcast side below.
HOT_SHARE = 10_000
HOT_ROWS = 2_000_000


def join_key_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    weight: str,
    hot_rows: int = HOT_ROWS,
    size: int | None = None,
) -> DataFrame:
    """Inner join of rows to statistics that have one line per key.

    `weight` names the statistic that counts the rows of a key. The statistics are
    written once; if any key is above both limits, those keys go through a broadcast
    of fewer than HOT_SHARE lines and never meet in one task, and the other keys are
    joined by shuffle. Without a hot key it is a plain join, and rows too few to hold one
    (`size`, or the count of a written frame) are not even checked. NULL keys match nothing.
    """
    size = row_count(rows) if size is None else size
    if size is not None and size <= hot_rows:
        return rows.join(stats, keys, "inner")
    if not is_written(stats):
        stats = materialize(stats, "key-stats")
    everything, heaviest = stats.agg(F.sum(weight), F.max(weight)).first()
    limit = max(hot_rows, (everything or 0) / HOT_SHARE)
    if heaviest is None or heaviest <= limit:
        return rows.join(stats, keys, "inner")
    hot = F.broadcast(stats.filter(F.col(weight) > limit))
    via_broadcast = rows.join(hot, keys, "inner")
    via_shuffle = rows.join(hot.select(*keys), keys, "left_anti").join(
        stats.filter(F.col(weight) <= limit), keys, "inner"
    )
    return via_broadcast.unionByName(via_shuffle)
