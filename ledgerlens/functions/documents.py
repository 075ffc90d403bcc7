"""Identity-document normal forms, checksum, hashing and masking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.values import hex_hash, ref, strip, text, without


def pan_key(df: DataFrame) -> Column:
    return F.upper(strip(text(df, "pan")))


def voter_key(df: DataFrame) -> Column:
    return F.upper(strip(text(df, "voter_id")))


def aadhaar_digits(df: DataFrame) -> Column:
    return without(strip(text(df, "aadhaar")), " -")


def aadhaar_hash(df: DataFrame, salt: str) -> Column:
    """Salted SHA-256 of a 12-character number, '' for anything else."""
    digits = aadhaar_digits(df)
    return F.when(F.length(digits) == 12, hex_hash(F.concat(F.lit(salt), digits))).otherwise("")


def mobile_key(df: DataFrame) -> Column:
    return without(strip(text(df, "mobile")), " -")


def account_key(df: DataFrame) -> Column:
    return strip(text(df, "bank_account"))


def name_dob_key(df: DataFrame) -> Column:
    name, dob = F.upper(strip(text(df, "full_name"))), strip(text(df, "dob"))
    return F.when((name != "") & (dob != ""), F.concat_ws("|", name, dob)).otherwise("")


def address_tokens(df: DataFrame) -> Column:
    """Sorted distinct upper-case words of the first address line."""
    line = F.upper(strip(text(df, "address_line1")))
    return F.when(line != "", F.sort_array(F.array_distinct(F.split(line, r"\s+"))))


def _checksum_tables() -> tuple[list[int], list[int]]:
    """Product table of the dihedral group D5 and the eight powers of its check permutation."""

    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    permutation = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([permutation[d] for d in powers[-1]])
    return [product(a, b) for a in range(10) for b in range(10)], [d for row in powers for d in row]


_PRODUCT, _POWERS = _checksum_tables()


def checksum_ok(number: str) -> Column:
    """Verhoeff check of a 12-digit number held in a bigint column; NULL for a NULL number.

    Unrolled over literal tables with integer arithmetic, so it compiles into the scan
    stage; one SQL text keeps the plan cheap to build.
    """
    product = "array(" + ",".join(map(str, _PRODUCT)) + ")"
    powers = "array(" + ",".join(map(str, _POWERS)) + ")"
    check = "0"
    for i in range(12):
        digit = f"cast(({number} div {10**i}) % 10 as int)"
        check = f"get({product}, {check} * 10 + get({powers}, {10 * (i % 8)} + {digit}))"
    return F.expr(f"{check} = 0")


_AADHAAR_NAME = re.compile(r"aadha?ar", re.IGNORECASE)


def mask_sensitive(df: DataFrame) -> DataFrame:
    """Keep only the last four characters of any Aadhaar-like column; used by every sink."""
    masked = {}
    for name in df.columns:
        if _AADHAAR_NAME.search(name):
            value = ref(name).cast("string")
            bare = F.regexp_replace(value, r"[\s-]", "")
            masked[name] = F.when(
                F.length(bare) >= 5, F.concat(F.lit("XXXXXXXX"), F.right(bare, F.lit(4)))
            ).otherwise(value)
    return df.withColumns(masked) if masked else df
