"""Text, blank, number and date coercions shared by rules and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHITESPACE = " \t\n\r\x0b\x0c"
_EXACT = (T.DecimalType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def ref(name: str) -> Column:
    """A column reference that tolerates spaces and dots in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Remove all leading and trailing whitespace, not only spaces."""
    return F.btrim(c, F.lit(_WHITESPACE))


def text(df: DataFrame, name: str) -> Column:
    """Column as text with NULL shown as ''; a constant '' when the column is absent."""
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(ref(name).cast("string"), F.lit(""))


def without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def is_blank_trimmed(c: Column) -> Column:
    """Blank in the sense of the row rules: nothing left after stripping."""
    return strip(F.coalesce(c, F.lit(""))) == ""


def is_blank_raw(c: Column) -> Column:
    """Blank in the sense of the reports: NULL or zero length, spaces count as content."""
    return c.isNull() | (F.length(c.cast("string")) == 0)


def amount(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: exact types as they are, anything else as a tolerant double."""
    if isinstance(df.schema[name].dataType, _EXACT):
        return ref(name)
    return ref(name).try_cast("double")


def total(df: DataFrame, name: str) -> Column:
    """Sum that is 0 for no values; exact inputs are summed exactly before the cast."""
    return F.coalesce(F.sum(amount(df, name)).cast("double"), F.lit(0.0))


def rounded(c: Column, digits: int) -> Column:
    """Half-up rounding on the decimal form, so that binary tails do not decide."""
    return F.round(c.try_cast("decimal(38,10)"), digits).cast("double")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, NULL when the whole is zero."""
    return rounded(F.try_divide(F.lit(100.0) * part, whole), digits)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """percent() that reads 0 for an empty whole."""
    return F.coalesce(percent(part, whole, digits), F.lit(0.0))


def distinct_with_null(c: Column) -> Column:
    """Distinct count in which NULL counts as one more value."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))


def iso_date(df: DataFrame, name: str) -> Column:
    """Tolerant yyyy-mm-dd parse; NULL for anything else."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return ref(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return ref(name).cast("date")
    raw = strip(ref(name).cast("string"))
    return F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), raw.try_cast("date"))


def _day_first(value: Column, mark: str, order: tuple[int, int, int]) -> Column:
    """Date of a text such as 31-12-1990, its parts given as year, month, day positions."""
    year, month, day = (F.split_part(value, F.lit(mark), F.lit(i)) for i in order)
    return F.concat_ws("-", year, month, day).try_cast("date")


def parse_date(c: Column) -> Column:
    """Date from yyyy-m-d, d-m-yyyy, d/m/yyyy, yyyy/m/d or eight digits ddmmyyyy; NULL otherwise.

    The guards exclude each other, and the parts are rearranged to one form whose cast
    is native; pattern-driven parsing costs several times as much per row.
    """
    value = strip(c)
    dashed = F.translate(value, "/", "-")
    digits = F.concat_ws("-", F.substring(value, 5, 4), F.substring(value, 3, 2), F.substring(value, 1, 2))
    return (
        F.when(value.rlike(r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"), dashed.try_cast("date"))
        .when(value.rlike(r"^\d{1,2}([-/])\d{1,2}\1\d{4}$"), _day_first(dashed, "-", (3, 2, 1)))
        .when(value.rlike(r"^\d{8}$"), digits.try_cast("date"))
    )


def parse_snapshot_date(c: Column) -> Column:
    """parse_date() for month labels: no bare digits, and m/d/yyyy where d/m/yyyy is no date."""
    value = strip(c)
    american = F.when(value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _day_first(value, "/", (3, 1, 2)))
    return F.when(~value.rlike(r"^\d+$"), F.coalesce(parse_date(value), american))


def calendar_age(born: Column, as_of: Column) -> Column:
    """Completed years, comparing month and day rather than dividing days."""
    before_birthday = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (
        F.month(born) * 100 + F.dayofmonth(born)
    )
    return F.year(as_of) - F.year(born) - before_birthday.cast("int")


def hex_hash(c: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def unpivot(one_row: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """Turn a one-row frame of aggregates into a small table, one struct per output row."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))
