"""The identity keys of a row, stacked so that one aggregation serves every kind of key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import documents as doc
from ledgerlens.functions.values import text

# Kinds that tie rows to one person; mobile only takes part in duplicate detection.
PERSON_KINDS = ("pan", "aadhaar", "voter_id", "name_dob", "bank_account")


def identity_keys(df: DataFrame, salt: str) -> dict[str, Column]:
    """Each kind's key of a row; blank where the row has none."""
    return {
        "pan": doc.pan_key(df),
        "aadhaar": doc.aadhaar_hash(df, salt),
        "mobile": doc.mobile_key(df),
        "bank_account": doc.account_key(df),
        "name_dob": doc.name_dob_key(df),
        "voter_id": doc.voter_key(df),
    }


def link_table(df: DataFrame, kinds, salt: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """(_row_num, kind, key, extras...) with one line per non-blank key of a row.

    customer_id keeps NULL apart from '' for the PAN kind only, and PAN falls back to
    the row number when the table has no customer_id column at all.
    """
    available = identity_keys(df, salt)
    if "customer_id" in df.columns:
        pan_id, other_id = F.col("customer_id").cast("string"), text(df, "customer_id")
    else:
        pan_id, other_id = F.col("_row_num").cast("string"), F.lit("")
    stacked = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                available[k].alias("key"),
                (pan_id if k == "pan" else other_id).alias("cid"),
            )
            for k in kinds
        ]
    )
    carried = [c.alias(n) for n, c in (extra or {}).items()]
    return df.select("_row_num", *carried, F.inline(stacked)).filter(F.col("key") != "")
