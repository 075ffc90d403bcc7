"""Risk-weighted audit sample of a loan book: exceptions, strata, then a weighted random fill."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.values import amount, iso_date, ref
from ledgerlens.operators.ordering import number_rows, order_statistics, top_k
from ledgerlens.operators.skew import HOT_ROWS, join_key_stats
from ledgerlens.operators.sketches import approximate_quantiles
from ledgerlens.session import materialize

# Exception classes in reading order, and the sampling constants.
CLASSES = (
    "DUPLICATE_LAN DUPLICATE_CUSTOMER NULL_MANDATORY_FIELD INVALID_SANCTIONED_AMT"
    " OUTSTANDING_EXCEEDS_SANCTIONED INVALID_INTEREST_RATE INVALID_TENURE FUTURE_LOAN_DATE"
    " IMPLAUSIBLY_OLD_DATE CLOSED_WITH_OUTSTANDING STATUS_DPD_MISMATCH KYC_ISSUE"
    " OUTLIER_SANCTIONED_AMT OUTLIER_OUTSTANDING_AMT OUTLIER_INTEREST_RATE"
).split()
PER_CLASS = 10
RANDOM_SHARE, RANDOM_MIN = 0.005, 50
FENCE = 1.5
SEED = 42
EARLIEST = datetime.date(1990, 1, 1)
STRATA = ("PRODUCT", "LOAN_STATUS", "BRANCH")
OUTLIERS = {
    "OUTLIER_SANCTIONED_AMT": "SANCTIONED_AMT",
    "OUTLIER_OUTSTANDING_AMT": "OUTSTANDING_AMT",
    "OUTLIER_INTEREST_RATE": "INTEREST_RATE",
}


def flag(name: str) -> str:
    return f"_exc_{name}"


def iqr_fences(df: DataFrame, columns: list[str], rank_error: float | None = None) -> dict[str, tuple[float, float]]:
    """Quartiles at the nearest rank, widened by FENCE times their distance; with rank_error, from sketches of that error."""
    shares = {"q1": 0.25, "q3": 0.75}
    if rank_error is None:
        quartiles = order_statistics(df, columns, shares, "nearest")
    else:
        quartiles = approximate_quantiles(df, columns, shares, rank_error)
    fences = {}
    for c in columns:
        q1, q3 = quartiles[c]["q1"] or 0.0, quartiles[c]["q3"] or 0.0
        fences[c] = (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
    return fences


def repeated_rows(df: DataFrame, columns: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(ROW_ID, one boolean per kind): rows whose value of a column occurs more than once."""
    stacked = F.array(*[F.struct(F.lit(k).alias("kind"), ref(c).cast("string").alias("key")) for k, c in columns.items()])
    keys = materialize(df.select("ROW_ID", F.inline(stacked)).filter("key is not null"), "book-keys")
    uses = keys.groupBy("kind", "key").agg(F.count("*").alias("uses")).filter("uses > 1")
    hits = join_key_stats(keys, uses, ["kind", "key"], "uses", hot_rows)
    return hits.groupBy("ROW_ID").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in columns])


def detect_exceptions(
    df: DataFrame, as_of: datetime.date | None = None, hot_rows: int = HOT_ROWS, rank_error: float | None = None
) -> DataFrame:
    """One boolean per class, the names of the set ones joined by ;, and a 0/1 flag.

    A rule whose column is absent never fires; NULLs fire only the rules about NULLs.
    """
    if "ROW_ID" not in df.columns:
        df = number_rows(df, "ROW_ID", 0)
    has = set(df.columns).__contains__
    today = F.lit(as_of) if as_of else F.current_date()
    null_date = F.lit(None).cast("date")
    date = iso_date(df, "LOAN_DATE") if has("LOAN_DATE") else null_date

    def number(name: str) -> Column:
        return amount(df, name) if has(name) else F.lit(None).cast("double")

    def empty(name: str) -> Column:
        return ref(name).isNull() if has(name) else F.lit(False)

    status = ref("LOAN_STATUS") if has("LOAN_STATUS") else F.lit(None).cast("string")
    kyc = ref("KYC_STATUS") if has("KYC_STATUS") else F.lit(None).cast("string")
    sanctioned, outstanding = number("SANCTIONED_AMT"), number("OUTSTANDING_AMT")
    rate, tenure, dpd = number("INTEREST_RATE"), number("TENURE_MONTHS"), number("DPD")

    def invalid(value: Column, name: str, bad: Column) -> Column:
        return (value.isNull() | bad) if has(name) else F.lit(False)

    mandatory = empty("LAN")
    for c in ("CUSTOMER_ID", "LOAN_DATE", "SANCTIONED_AMT", "LOAN_STATUS"):
        mandatory = mandatory | empty(c)
    repeats = {k: c for k, c in (("__lan", "LAN"), ("__customer", "CUSTOMER_ID")) if has(c)}
    table = df
    if repeats:
        table = df.join(repeated_rows(df, repeats, hot_rows), "ROW_ID", "left")

    tests = {
        "DUPLICATE_LAN": (empty("LAN") | F.col("__lan")) if has("LAN") else F.lit(False),
        "DUPLICATE_CUSTOMER": F.col("__customer") if has("CUSTOMER_ID") else F.lit(False),
        "NULL_MANDATORY_FIELD": mandatory,
        "INVALID_SANCTIONED_AMT": invalid(sanctioned, "SANCTIONED_AMT", sanctioned <= 0),
        "OUTSTANDING_EXCEEDS_SANCTIONED": outstanding > sanctioned,
        "INVALID_INTEREST_RATE": invalid(rate, "INTEREST_RATE", (rate <= 0) | (rate > 36)),
        "INVALID_TENURE": invalid(tenure, "TENURE_MONTHS", tenure <= 0),
        "FUTURE_LOAN_DATE": date > today,
        "IMPLAUSIBLY_OLD_DATE": date < F.lit(EARLIEST),
        "CLOSED_WITH_OUTSTANDING": (status == "Closed") & (outstanding > 0),
        "STATUS_DPD_MISMATCH": status.isin("NPA", "Written-off") & (dpd == 0),
        "KYC_ISSUE": kyc.isin("Missing", "Expired", "Pending"),
    }
    measured = [c for c in OUTLIERS.values() if has(c)]
    fences = iqr_fences(df.select(*[amount(df, c).cast("double").alias(c) for c in measured]), measured, rank_error) if measured else {}
    for name, c in OUTLIERS.items():
        low, high = fences.get(c, (None, None))
        tests[name] = (number(c) < low) | (number(c) > high) if c in fences else F.lit(False)

    flagged = table.withColumns({flag(n): F.coalesce(tests[n], F.lit(False)) for n in CLASSES})
    names = F.concat_ws(";", *[F.when(F.col(flag(n)), n) for n in CLASSES])
    return flagged.withColumns(
        {"EXCEPTION_FLAGS": names, "IS_EXCEPTION": (names != "").cast("tinyint")}
    ).drop("__lan", "__customer")


def recency_weight(df: DataFrame) -> tuple[DataFrame, str]:
    """RECENCY_WEIGHT from 0.25 (oldest) to 1.0 (newest), and what it was based on.

    Loan dates are used when there are two different ones, rows without a date getting
    the median; otherwise the trailing digits of the loan number.
    """
    if "LOAN_DATE" in df.columns:
        day = F.unix_date(iso_date(df, "LOAN_DATE"))
        low, high, gaps = df.agg(F.min(day), F.max(day), F.count_if(day.isNull())).first()
        if low is not None and low < high:
            filled = day.cast("double")
            if gaps:
                middle = order_statistics(df.select(day.alias("day")), ["day"], {"m": 0.5}, "linear")["day"]["m"]
                filled = F.coalesce(filled, F.lit(middle))
            weight = 0.25 + 0.75 * ((filled - float(low)) / float(high - low))
            return df.withColumn("RECENCY_WEIGHT", weight), "LOAN_DATE"
    digits = F.regexp_extract(F.coalesce(ref("LAN"), F.lit("")), r"(\d+)$", 1)
    number = F.coalesce(digits.try_cast("double"), F.lit(0.0))
    low, high = df.agg(F.min(number), F.max(number)).first()
    spread = ((high or 0.0) - (low or 0.0)) or 1.0
    weight = 0.25 + 0.75 * ((number - (low or 0.0)) / spread)
    return df.withColumn("RECENCY_WEIGHT", weight), "LAN_SEQUENCE (fallback: fewer than 2 distinct dates)"


def class_candidates(flagged: DataFrame) -> DataFrame:
    """(class, ROW_ID, place): the newest rows of each class, as many as a pass can need.

    Earlier classes can have taken at most PER_CLASS rows each, so this many always
    leave PER_CLASS free ones where the class has them.
    """
    enough = PER_CLASS * (len(CLASSES) + 1)
    names = F.array_compact(F.array(*[F.when(F.col(flag(n)), n) for n in CLASSES]))
    order = Window.partitionBy("class").orderBy(F.desc("RECENCY_WEIGHT"), "ROW_ID")
    return (
        flagged.select("ROW_ID", "RECENCY_WEIGHT", F.explode(names).alias("class"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= enough)
        .select("class", "ROW_ID", "place")
    )


def pick_exceptions(flagged: DataFrame) -> tuple[dict[int, str], dict[str, int]]:
    """({ROW_ID: class it is taken for}, {class: rows that count towards it}).

    Classes are served in order and prefer rows nobody has taken; rows taken before
    still count for the classes they belong to. At most 16 * PER_CLASS lines per class
    reach this loop, whatever the table size.
    """
    lines: dict[str, list] = {n: [] for n in CLASSES}
    for row in class_candidates(flagged).orderBy("class", "place").collect():
        lines[row["class"]].append(row["ROW_ID"])
    taken: dict[int, str] = {}
    counted = {}
    for name in CLASSES:
        fresh = [i for i in lines[name] if i not in taken][:PER_CLASS]
        shared = [i for i in lines[name] if i in taken][: PER_CLASS - len(fresh)]
        taken.update({i: name for i in fresh})
        counted[name] = len(fresh) + len(shared)
    return taken, counted


def sample_exceptions(flagged: DataFrame, taken: dict[int, str]) -> DataFrame:
    chosen = flagged.sparkSession.createDataFrame(
        [(i, f"EXCEPTION:{name}") for i, name in taken.items()], "ROW_ID long, SELECTION_REASON string"
    )
    return flagged.join(F.broadcast(chosen), "ROW_ID")  # at most PER_CLASS rows per class


def sample_strata(clean: DataFrame) -> DataFrame:
    """The newest row of every product, status and branch combination."""
    dims = [c for c in STRATA if c in clean.columns]
    if not dims:
        return clean.limit(0).withColumn("SELECTION_REASON", F.lit(""))
    order = Window.partitionBy(*dims).orderBy(F.desc("RECENCY_WEIGHT"), "ROW_ID")
    best = clean.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")
    named = F.array_join(F.array(*[F.coalesce(ref(d).cast("string"), F.lit("")) for d in dims]), "|")
    return best.withColumn("SELECTION_REASON", F.concat(F.lit("STRATA_COVERAGE:"), named))


def sample_random(pool: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """k rows without replacement, each in proportion to its weight.

    Every row draws the key ln(u) / weight with u from a hash of the seed and its id;
    the k largest keys are such a sample (Efraimidis and Spirakis, 2006).
    """
    hexed = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("ROW_ID").cast("string")), 256), 1, 13)
    u = (F.conv(hexed, 16, 10).cast("double") + 1.0) / float(2**52 + 1)
    drawn = top_k(pool.withColumn("__draw", F.log(u) / F.col("RECENCY_WEIGHT")), "__draw", k, "ROW_ID")
    return drawn.drop("__draw").withColumn("SELECTION_REASON", F.lit("RANDOM"))


def audit_sample(df: DataFrame, as_of: datetime.date | None = None, hot_rows: int = HOT_ROWS):
    """(sample, summary): the three phases together and the figures behind them."""
    weighted, basis = recency_weight(detect_exceptions(df, as_of, hot_rows))
    flagged = materialize(weighted, "loan-book")
    facts = flagged.agg(
        F.count("*").alias("rows"), F.count_if(F.col("IS_EXCEPTION") == 1).alias("exceptions"),
        *[F.count_if(flag(n)).alias(n) for n in CLASSES],
    ).first()
    clean = flagged.filter("IS_EXCEPTION = 0")
    taken, counted = pick_exceptions(flagged)
    strata = materialize(sample_strata(clean), "strata")
    strata_rows = strata.count()
    clean_rows = facts["rows"] - facts["exceptions"]
    wanted = max(int(clean_rows * RANDOM_SHARE), RANDOM_MIN) - strata_rows
    pool = clean.join(strata.select("ROW_ID"), "ROW_ID", "left_anti")
    parts = [sample_exceptions(flagged, taken), strata, sample_random(pool, wanted)]
    sample = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop(*[flag(n) for n in CLASSES])
    random_rows = max(0, min(wanted, clean_rows - strata_rows))
    size = len(taken) + strata_rows + random_rows
    summary = {
        "population_total": facts["rows"],
        "clean_records": clean_rows,
        "exception_records": facts["exceptions"],
        "exception_classes_found": sum(facts[n] > 0 for n in CLASSES),
        "exception_classes_sampled": sum(v > 0 for v in counted.values()),
        "exceptions_sampled": len(taken),
        "strata_covered": strata_rows,
        "random_sampled": random_rows,
        "total_sample_size": size,
        "sample_pct": round(size / facts["rows"] * 100, 3) if facts["rows"] else 0.0,
        "recency_basis": basis,
        "per_class": {n: {"found": facts[n], "sampled": counted[n]} for n in CLASSES},
        "assumptions": _assumptions(df),
    }
    return sample, summary


def _assumptions(df: DataFrame) -> list[str]:
    expected = "LOAN_DATE SANCTIONED_AMT OUTSTANDING_AMT INTEREST_RATE TENURE_MONTHS DPD KYC_STATUS".split()
    missing = [c for c in expected if c not in df.columns]
    notes = [f"Missing columns (rules skipped): {', '.join(missing)}"] if missing else []
    if "LOAN_DATE" in df.columns:
        blank = df.filter(F.col("LOAN_DATE").isNull()).count()
        if blank:
            notes.append(f"{blank:,} rows had no LOAN_DATE; their recency weight uses the median date.")
    return notes + [
        f"IQR multiplier: {FENCE}; outlier bounds computed on non-null values.",
        f"Sampling seed: {SEED} (reproducible).",
        f"Max per exception class: {PER_CLASS}.",
        f"Random sample target: max({RANDOM_SHARE * 100:.1f}% of clean, {RANDOM_MIN} rows).",
    ]
