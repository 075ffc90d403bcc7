"""Forensic screens over the customer master."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.values import distinct_with_null, iso_date, ref, rounded, strip, text, unpivot
from ledgerlens.plans.report import NotAvailable, ReportResult, asc, desc, plan_report, require
from ledgerlens.plans.row_rules import email_domain
from ledgerlens.session import materialize, row_count

# Throw-away mail domains.
DISPOSABLE_DOMAINS = (
    "mailinator.com guerrillamail.com 10minutemail.com tempmail.com temp-mail.org throwawaymail.com"
    " yopmail.com trashmail.com getnada.com sharklasers.com dispostable.com fakeinbox.com maildrop.cc"
    " mintemail.com mailnesia.com spam4.me guerrillamailblock.com tempinbox.com emailondeck.com tempr.email"
).split()

# Expected first-digit shares for 1 to 9, and the verdict limits of the mean deviation.
BENFORD_SHARES = (0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046)
BENFORD_CLOSE, BENFORD_ACCEPTABLE, BENFORD_MARGINAL = 0.006, 0.012, 0.015
BENFORD_MIN_VALUES = 30

DOCUMENTS = {
    "pan": "PAN",
    "aadhaar": "Aadhaar",
    "voter_id": "Voter ID",
    "passport": "Passport",
    "driving_licence": "Driving Licence",
}


def _value(df: DataFrame, name: str) -> Column:
    return strip(text(df, name))


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def normal_address(df: DataFrame) -> Column:
    parts = [_present(_value(df, c)) for c in ("address_line1", "address_line2", "city", "pincode")]
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), "[^a-z0-9]+", " "))


def address_clustering(df: DataFrame, threshold: int = 5) -> DataFrame:
    """Addresses shared by more than `threshold` customers."""
    require(df, "address_line1")
    people = F.count_distinct(_present(_value(df, "customer_id"))) if "customer_id" in df.columns else F.count("*")
    loans = F.count_distinct(_present(_value(df, "lan"))) if "lan" in df.columns else F.count("*")
    grouped = (
        df.withColumn("__address", normal_address(df)).filter("__address <> ''")
        .groupBy("__address").agg(people.alias("Distinct Customers"), loans.alias("Loan Accounts"))
        .filter(F.col("Distinct Customers") > threshold)
    )
    risk = F.when(F.col("Distinct Customers") > 2 * threshold, "CRITICAL").otherwise("HIGH")
    return grouped.orderBy(*desc("Distinct Customers"), "__address").select(
        F.col("__address").alias("Address (normalized)"), "Distinct Customers", "Loan Accounts",
        risk.alias("Risk"),
    )


# --- Name similarity -----------------------------------------------------------------------------


def name_key(df: DataFrame) -> Column:
    return F.trim(F.regexp_replace(F.lower(_value(df, "full_name")), "[^a-z]+", " "))


CLOSE_EDITS = 3


@F.pandas_udf(T.DoubleType())
def _name_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two names; the one measure without a built-in form."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


LETTERS = "abcdefghijklmnopqrstuvwxyz "


def _common_letters(a: Column, b: Column) -> Column:
    """Upper bound of matching characters: shared letters counted with multiplicity, in one loop to keep plans small."""

    def held(name: Column, letter: Column) -> Column:
        return F.length(name) - F.length(F.replace(name, letter, F.lit("")))

    letters = F.array(*[F.lit(c) for c in LETTERS])
    return F.aggregate(letters, F.lit(0), lambda total, c: total + F.least(held(a, c), held(b, c)))


def _edits(length_sum: Column, threshold: float) -> Column:
    """Most insertions and deletions two names of this total length may differ by."""
    return F.floor(length_sum * (1 - threshold) + 1e-9).cast("int")


def _without(text: Column, deletions: int) -> Column:
    """All texts with exactly this many characters taken out (0 to 3)."""
    size = F.length(text)

    def cut(t: Column, i: Column) -> Column:
        return F.concat(F.substr(t, F.lit(1), i), F.substr(t, i + 2))

    if deletions == 0:
        return F.array(text)
    spots = F.sequence(F.lit(0), size - 1)
    one = F.transform(spots, lambda i: F.struct(i.alias("at"), cut(text, i).alias("t")))
    for _ in range(deletions - 1):  # further characters are taken from what precedes the last one
        one = F.flatten(F.transform(one, lambda x: F.transform(
            F.when(x["at"] > 0, F.sequence(F.lit(0), x["at"] - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(i.alias("at"), cut(x["t"], i).alias("t")))))
    return F.array_distinct(F.transform(one, lambda x: x["t"]))


def _name_sizes(profiles: DataFrame) -> DataFrame:
    """The lengths that names have."""
    return profiles.select(F.length("name").alias("size")).distinct()


def close_name_pairs(profiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of names that may differ by up to CLOSE_EDITS insertions and deletions and can reach the ratio.

    The matched characters of a pair are left when each name loses its unmatched ones, so names meet on what is left after up to
    CLOSE_EDITS deletions. Only pairs that are that near meet: a first name that half of a block bears makes no pairs.
    """
    size = F.col("size")

    def lost(shorter_by: int) -> Column:
        """Characters that a name can lose to a partner that is so much shorter."""
        both = _edits(2 * size - shorter_by, threshold)
        return F.when(both >= shorter_by, F.floor((F.least(both, F.lit(CLOSE_EDITS)) + shorter_by) / 2).cast("int")).otherwise(0)

    budget = F.least(F.greatest(*[lost(k) for k in range(CLOSE_EDITS + 1)]), size - 1)
    none = F.array().cast("array<string>")
    levels = [F.when(F.col("budget") >= d, _without(F.col("name"), d)).otherwise(none) for d in range(CLOSE_EDITS + 1)]
    # two names of a pair cannot both be too long for their common budget
    usable = _edits(2 * F.ceil(size * (threshold / (2 - threshold)) - 1e-9), threshold) <= CLOSE_EDITS
    budgets = materialize(_name_sizes(profiles).filter(usable).select("size", budget.alias("budget")), "name-budgets")
    sized = profiles.withColumn("size", F.length("name")).join(F.broadcast(budgets), "size")  # one line per length
    rests = sized.select("block", "pid", "name", F.explode(F.flatten(F.array(*levels))).alias("rest"))
    held = rests.groupBy("block", "rest").count().filter("count > 1").select("block", "rest")
    met = materialize(rests.join(held, ["block", "rest"]), "name-rests")  # most are met by nobody
    other = met.select("block", "rest", F.col("pid").alias("b"), F.col("name").alias("name_b"))
    both = F.length("name") + F.length("name_b")
    unmatched = both - 2 * F.length("rest")
    pairs = met.join(other, ["block", "rest"]).filter(
        (F.col("pid") < F.col("b")) & (F.col("name") != F.col("name_b"))
        & (unmatched <= _edits(both, threshold)) & (_edits(both, threshold) <= CLOSE_EDITS))
    return pairs.select("block", F.col("pid").alias("a"), "b", F.col("name").alias("name_a"), "name_b")


def name_pair_candidates(profiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of profiles of one block that can reach the ratio; complete by construction.

    Pairs that may differ by up to CLOSE_EDITS come from close_name_pairs; longer ones as follows.
    A ratio of t leaves at most D = (1 - t) * (|a| + |b|) unmatched characters. The
    shorter name is cut into D + 1 pieces, of which at least one appears unchanged in the
    longer name, shifted by at most D places. Names meet on equal pieces of equal place.
    What depends on lengths alone is worked out per length and written, so plans over names stay small.
    """
    size = F.col("size")
    sizes = _name_sizes(profiles)
    # longest partner and so the largest budget of each name as the shorter one
    reach = F.floor(size * ((2 - threshold) / threshold) + 1e-9).cast("int")

    def start(i: Column, n: Column, length: Column) -> Column:
        return F.floor(i * length / n).cast("int")

    def cut(lengths: DataFrame) -> DataFrame:
        """One line per piece of the shorter length len_a, with its place and width."""
        pieces = F.least(F.col("budget") + 1, F.col("len_a"))
        each = lengths.filter(F.col("budget") > CLOSE_EDITS).withColumn("n", pieces)
        each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"))
        ends = start(F.col("piece") + 1, F.col("n"), F.col("len_a"))
        return each.withColumn("begin", start(F.col("piece"), F.col("n"), F.col("len_a"))).withColumn("width", ends - F.col("begin")).drop("n")

    # the longer side, once per possible shorter length and piece
    least = F.greatest(F.ceil(size * (threshold / (2 - threshold)) - 1e-9).cast("int"), F.lit(1))
    longer = sizes.select("size", F.explode(F.sequence(least, size)).alias("len_a"))
    shapes = cut(longer.withColumn("budget", _edits(F.col("len_a") + size, threshold))).select(
        "size", "len_a", "budget", "piece", "width", F.greatest(F.col("begin") - F.col("budget"), F.lit(0)).alias("first_at"),
        F.least(F.col("begin") + F.col("budget"), size - F.col("width")).alias("last_at"))
    shapes = materialize(shapes.filter("last_at >= first_at"), "name-shapes")
    close = close_name_pairs(profiles, threshold)
    if not row_count(shapes):  # no two names of these lengths may differ by more
        return close
    # the shorter side, once per possible budget
    budgets = F.array_distinct(
        F.transform(F.sequence(size, F.greatest(reach, size)), lambda other: _edits(size + other, threshold))
    )
    cuts = materialize(cut(sizes.select(size.alias("len_a"), F.explode(budgets).alias("budget"))), "name-cuts")
    indexed = profiles.withColumn("len_a", F.length("name")).join(cuts, "len_a").select(
        "block", F.col("pid").alias("a"), F.col("name").alias("name_a"), "budget", "len_a", "piece",
        F.substr("name", F.col("begin") + 1, F.col("width")).alias("text"))
    places = F.transform(F.sequence("first_at", "last_at"), lambda p: F.substr("name", p + 1, F.col("width")))
    probe = profiles.withColumn("size", F.length("name")).join(shapes, "size").select(
        "block", F.col("pid").alias("b"), F.col("name").alias("name_b"), "len_a", "budget", "piece",
        F.explode(F.array_distinct(places)).alias("text"))
    met = indexed.join(probe, ["block", "len_a", "budget", "piece", "text"]).filter(F.col("a") != F.col("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    ahead = F.col("a") < F.col("b")
    far = met.select(
        "block", low.alias("a"), high.alias("b"),
        F.when(ahead, F.col("name_a")).otherwise(F.col("name_b")).alias("name_a"),
        F.when(ahead, F.col("name_b")).otherwise(F.col("name_a")).alias("name_b"),
    ).filter(F.col("name_a") != F.col("name_b"))
    return far.unionByName(close)


def name_similarity(
    df: DataFrame, threshold: float = 0.92, block_cap: int | None = None, top_n: int | None = None
) -> DataFrame:
    """Near-equal names inside one pincode whose PANs do not prove them the same person.

    Rows are folded to distinct (pincode, name, PAN) profiles first, ordered by their
    first row; `Row Pairs` is how many row pairs a line stands for. block_cap skips
    pincodes with more rows than that; by default none is skipped.
    """
    require(df, "full_name")
    if "_row_num" not in df.columns:
        raise NotAvailable("_row_num column not available")
    has_pan = "pan" in df.columns
    pin = _value(df, "pincode")
    rows = df.select(
        F.when(pin == "", "_ALL_").otherwise(pin).alias("block"),
        name_key(df).alias("name"), _value(df, "full_name").alias("shown"), _value(df, "pan").alias("pan"), "_row_num",
    ).filter("name <> ''")
    if block_cap is not None:
        heavy = rows.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > block_cap).select("block")
        rows = rows.join(heavy, "block", "left_anti")
    profiles = materialize(
        rows.groupBy("block", "name", "shown", "pan")
        .agg(F.count("*").alias("rows"), F.min("_row_num").alias("pid")),
        "name-profiles",
    )
    # names are compared once however many spellings and PANs share them
    names = materialize(profiles.groupBy("block", "name").agg(F.min("pid").alias("pid")), "names")
    # one exchange serves both the removal of repeats and an even spread of the scoring
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = name_pair_candidates(names, threshold).repartition(tasks, "a", "b").dropDuplicates(["a", "b"])
    pairs = candidates.filter(
        2.0 * _common_letters(F.col("name_a"), F.col("name_b"))
        / (F.length("name_a") + F.length("name_b")) >= threshold
    )
    # the ratio depends on the order of its arguments, so both orders are scored
    scored = materialize(
        pairs.select(
            "block", "name_a", "name_b", _name_ratio("name_a", "name_b").alias("forward"),
            _name_ratio("name_b", "name_a").alias("backward"),
        ).filter(F.greatest("forward", "backward") >= threshold),
        "name-pairs",
    )
    left = profiles.select(
        "block", F.col("name").alias("name_a"), F.col("shown").alias("sa"), F.col("pan").alias("pa"),
        F.col("rows").alias("ra"), F.col("pid").alias("ia"),
    )
    right = profiles.select(
        "block", F.col("name").alias("name_b"), F.col("shown").alias("sb"), F.col("pan").alias("pb"),
        F.col("rows").alias("rb"), F.col("pid").alias("ib"),
    )
    lines = scored.join(left, ["block", "name_a"]).join(right, ["block", "name_b"])
    ahead = F.col("ia") < F.col("ib")
    score = F.when(ahead, F.col("forward")).otherwise(F.col("backward"))
    same_person = (F.col("pa") != "") & (F.col("pa") == F.col("pb")) if has_pan else F.lit(False)
    pans = F.size(F.array_distinct(F.filter(F.array("pa", "pb"), lambda p: p != "")))
    shown_a = F.when(ahead, F.col("sa")).otherwise(F.col("sb"))
    shown_b = F.when(ahead, F.col("sb")).otherwise(F.col("sa"))
    result = lines.filter((score >= threshold) & ~same_person).select(
        shown_a.alias("Name A"),
        shown_b.alias("Name B"),
        F.round(score.cast("decimal(20,12)"), 3).cast("double").alias("Similarity"),
        F.when(F.col("block") == "_ALL_", "").otherwise(F.col("block")).alias("Pincode"),
        pans.cast("int").alias("Distinct PAN"),
        (F.col("ra") * F.col("rb")).alias("Row Pairs"),
        F.lit("HIGH").alias("Risk"),
        F.least("ia", "ib").alias("__i"), F.greatest("ia", "ib").alias("__j"),
    ).orderBy(*desc("Similarity"), "__i", "__j")
    return (result if top_n is None else result.limit(top_n)).drop("__i", "__j")


# --- Other screens -------------------------------------------------------------------------------


def email_domain_anomalies(df: DataFrame, shared_threshold: int = 10) -> DataFrame:
    require(df, "email")
    domain = strip(email_domain(F.lower(_value(df, "email"))))
    people = F.count_distinct(_present(_value(df, "customer_id"))) if "customer_id" in df.columns else F.count("*")
    thrown = F.col("Email Domain").isin(*DISPOSABLE_DOMAINS)
    shared = F.col("Distinct Customers") > shared_threshold
    return (
        df.withColumn("Email Domain", domain).filter(F.col("Email Domain") != "")
        .groupBy("Email Domain").agg(people.alias("Distinct Customers"))
        .filter(thrown | shared)
        .select(
            "Email Domain", "Distinct Customers",
            F.when(thrown & shared, "Disposable + Shared").when(thrown, "Disposable Domain")
            .otherwise("Shared Domain").alias("Anomaly Type"),
            F.when(thrown & shared, "CRITICAL").when(thrown, "HIGH").otherwise("MEDIUM").alias("Risk"),
        )
        .orderBy(*desc("Distinct Customers"), *asc("Email Domain"))
    )


def _longest_digits(value: Column) -> Column:
    """The first of the longest runs of three or more digits, without leading zeros; any length."""
    runs = F.regexp_extract_all(value, F.lit(r"(\d{3,})"))
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    first = F.get(F.filter(runs, lambda r: F.length(r) == longest), F.lit(0))
    return F.regexp_replace(first, "^0+(?=.)", "")


def sequential_documents(df: DataFrame) -> DataFrame:
    """Runs of three or more document numbers that follow each other by one.

    Walking the rows in number order, a run goes on while the next row is exactly one
    higher, so a repeated number ends one run with its first row and may begin another
    with its last. Only those two rows of a number matter. Aadhaar values are masked.
    """
    present = {c: t for c, t in DOCUMENTS.items() if c in df.columns}
    if not present:
        raise NotAvailable("No KYC document columns available")
    stacked = F.array(
        *[F.struct(F.lit(t).alias("doc"), F.upper(_value(df, c)).alias("value")) for c, t in present.items()]
    )
    row = F.col("_row_num") if "_row_num" in df.columns else F.col("value")
    numbers = (
        df.select(*[c for c in ("_row_num",) if c in df.columns], F.inline(stacked))
        .filter("value <> ''")
        .withColumn("n", _longest_digits(F.col("value"))).filter("n is not null")
        .groupBy("doc", "n")
        .agg(F.count("*").alias("held"), F.min_by("value", row).alias("early"), F.max_by("value", row).alias("late"))
    )
    first = F.struct(F.lit(0).alias("copy"), F.col("early").alias("value"))
    last = F.struct(F.lit(1).alias("copy"), F.col("late").alias("value"))
    rows = numbers.select(
        "doc", "n", F.inline(F.when(F.col("held") > 1, F.array(first, last)).otherwise(F.array(first)))
    )
    runs = _consecutive_runs(rows).filter("length >= 3")

    def shown(name: str) -> Column:
        masked = F.concat(F.lit("XXXXXXXX"), F.right(name, F.lit(4)))
        return F.when(F.col("doc") == DOCUMENTS["aadhaar"], masked).otherwise(F.col(name))

    return runs.select(
        F.col("doc").alias("Document Type"), F.col("length").alias("Sequence Length"),
        shown("first").alias("First Value"), shown("last").alias("Last Value"),
        F.when(F.col("length") >= 5, "CRITICAL").otherwise("HIGH").alias("Risk"),
    ).orderBy(*desc("Sequence Length"), *asc("Document Type", "First Value"))


STRETCH_DIGITS = 5


def _stretch(column: str) -> tuple[Column, Column]:
    """(stretch, place inside) of digits without leading zeros; a stretch shares all but the last STRETCH_DIGITS digits."""
    long = F.length(column) > STRETCH_DIGITS
    head = F.when(long, F.substr(column, F.lit(1), F.length(column) - STRETCH_DIGITS)).otherwise("0")
    return head.alias("stretch"), F.right(column, F.lit(STRETCH_DIGITS)).cast("int").alias("at")


def _consecutive_runs(rows: DataFrame) -> DataFrame:
    """(doc, length, first, last) of the runs in (doc, n, copy, value) rows; n holds digits of any length.

    The number line is cut into stretches of 10 ** STRETCH_DIGITS numbers. Runs that touch a border of their stretch are summed up in one line
    each, at most two a stretch, and are joined inside stretches of stretches, and so on, as a tree: no window holds more than
    twice 10 ** STRETCH_DIGITS lines, however many numbers there are.
    """
    longest = rows.agg(F.coalesce(F.max(F.length("n")), F.lit(0))).first()[0]
    inside = Window.partitionBy("doc", "stretch").orderBy("at", "copy")
    fresh = F.coalesce(F.lag("at").over(inside) != F.col("at") - 1, F.lit(True)).cast("int")
    numbered = rows.select("doc", "copy", "value", *_stretch("n")).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(inside))
    spot = F.struct("at", "copy")
    pieces = numbered.groupBy("doc", "stretch", "run").agg(
        F.count("*").alias("length"), F.min("at").alias("low"), F.max("at").alias("high"),
        F.min_by("copy", spot).alias("low_copy"), F.min_by("value", spot).alias("first"), F.max_by("value", spot).alias("last"),
    ).withColumn("last_run", F.max("run").over(Window.partitionBy("doc", "stretch")) == F.col("run"))
    left = (F.col("low") == 0) & (F.col("low_copy") == 0)
    right = (F.col("high") == 10**STRETCH_DIGITS - 1) & F.col("last_run")
    columns = ("doc", "stretch", "length", "first", "last", "left", "right")
    current = pieces.withColumn("left", left).withColumn("right", right).select(*columns)
    finished = None
    for _ in range(STRETCH_DIGITS, longest, STRETCH_DIGITS):
        current = materialize(current, "runs")
        closed = current.filter(~F.col("left") & ~F.col("right"))
        finished = closed if finished is None else finished.unionByName(closed)
        current = _joined_runs(current.filter(F.col("left") | F.col("right"))).select(*columns)
    whole = current if finished is None else finished.unionByName(current)
    return whole.select("doc", "length", "first", "last")


def _joined_runs(pieces: DataFrame) -> DataFrame:
    """Pieces that go on from stretch to stretch, joined inside the stretches of the next size."""
    placed = pieces.withColumnRenamed("stretch", "number").select("*", *_stretch("number"), (~F.col("left")).alias("late"))
    along = Window.partitionBy("doc", "stretch").orderBy("at", "late")  # of the two pieces of a stretch the left one comes first
    goes_on = F.col("left") & F.lag("right").over(along) & (F.lag("at").over(along) == F.col("at") - 1)
    chained = placed.withColumn("fresh", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("chain", F.sum("fresh").over(along))
    spot = F.struct("at", "late")
    return chained.groupBy("doc", "stretch", "chain").agg(
        F.sum("length").alias("length"), F.min("at").alias("begin"), F.max("at").alias("end"), F.min_by("left", spot).alias("open_left"),
        F.max_by("right", spot).alias("open_right"), F.min_by("first", spot).alias("first"), F.max_by("last", spot).alias("last"),
    ).select(
        "doc", "stretch", "length", "first", "last", ((F.col("begin") == 0) & F.col("open_left")).alias("left"),
        ((F.col("end") == 10**STRETCH_DIGITS - 1) & F.col("open_right")).alias("right"))



def income_benford(df: DataFrame) -> DataFrame:
    """First digits of declared income against the expected shares, then the deviation and a verdict.

    Fewer than BENFORD_MIN_VALUES usable values give an empty table.
    """
    require(df, "income")
    digits = F.regexp_replace(_value(df, "income"), "[^0-9]", "")
    first = F.regexp_extract(digits, "^0*([1-9])", 1)
    counts = df.agg(*[F.count_if(first == str(d)).alias(f"c{d}") for d in range(1, 10)])
    total = sum([F.col(f"c{d}") for d in range(2, 10)], F.col("c1"))
    counts = counts.withColumn("n", total).filter(F.col("n") >= BENFORD_MIN_VALUES)
    gaps = [F.abs(F.col(f"c{d}") / F.col("n") - F.lit(BENFORD_SHARES[d - 1])) for d in range(1, 10)]
    counts = counts.withColumn("mad", sum(gaps[1:], gaps[0]) / 9)
    mad = F.col("mad")
    verdict = (
        F.when(mad <= BENFORD_CLOSE, "Close conformity")
        .when(mad <= BENFORD_ACCEPTABLE, "Acceptable conformity")
        .when(mad <= BENFORD_MARGINAL, "Marginally acceptable")
        .otherwise("NON-CONFORMITY (investigate)")
    )
    rows = [
        [
            F.lit(str(d)), rounded(F.lit(100.0) * F.col(f"c{d}") / F.col("n"), 2),
            F.lit(round(BENFORD_SHARES[d - 1] * 100, 2)), F.col(f"c{d}"),
        ]
        for d in range(1, 10)
    ]
    rows.append([F.lit("MAD"), rounded(mad, 5), F.lit(BENFORD_ACCEPTABLE), F.col("n")])
    none = F.lit(None).cast("double")
    rows.append([verdict, none, none, F.lit(None).cast("long")])
    return unpivot(counts, rows, ["Digit", "Observed %", "Expected %", "Count"])


def _segment(df: DataFrame) -> str:
    for name in ("branch_code", "dsa_code"):
        if name in df.columns:
            return name
    raise NotAvailable("branch_code / dsa_code column not available (map one to enable)")


def kyc_by_branch(df: DataFrame) -> DataFrame:
    """Share of blank mandatory fields per branch, flagged above twice the portfolio's."""
    segment = _segment(df)
    names = [c for c in ("pan", "aadhaar", "mobile", "address_line1", "pincode") if c in df.columns]
    if not names:
        raise NotAvailable("No mandatory KYC fields present to measure")
    blanks = sum([(_value(df, c) == "").cast("long") for c in names[1:]], (_value(df, names[0]) == "").cast("long"))
    per = df.groupBy(F.coalesce(ref(segment).cast("string"), F.lit("(blank)")).alias("Segment")).agg(
        F.count("*").alias("Records"), F.sum(blanks).alias("blanks")
    )
    whole = per.agg(F.struct(F.sum("blanks").alias("b"), F.sum("Records").alias("r")).alias("w")).scalar()
    fields = len(names)
    own = F.col("blanks") / (F.col("Records") * fields)
    portfolio = whole["b"] / (whole["r"] * fields)
    return per.select(
        "Segment", "Records",
        rounded(100.0 * own, 2).alias("Avg KYC Null %"),
        rounded(100.0 * portfolio, 2).alias("Portfolio Avg %"),
        F.when(own > 2 * portfolio, "FLAG (>2x avg)").otherwise("").alias("Flag"),
    ).orderBy(*desc("Avg KYC Null %"), *asc("Segment"))


def onboarding_velocity(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """Segment-days above the segment's mean plus three population deviations.

    Days are counted first and the moments are taken from the counts by aggregation,
    so a segment with a third of the rows is one line per day.
    """
    require(df, "onboarding_date")
    segment = _segment(df)
    day = iso_date(df, "onboarding_date")
    daily = (
        df.select(F.coalesce(ref(segment).cast("string"), F.lit("(blank)")).alias("Segment"), day.alias("day"))
        .filter("day is not null").groupBy("Segment", "day").agg(F.count("*").alias("New Customers"))
    )
    n, s, q = F.count("*"), F.sum("New Customers"), F.sum(F.col("New Customers") * F.col("New Customers"))
    stats = daily.groupBy("Segment").agg(n.alias("n"), s.alias("s"), q.alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")) / F.col("n")
    limit = mean + 3 * spread
    flagged = (
        daily.join(stats, "Segment")
        .filter((F.col("New Customers") > limit) & (F.col("New Customers") >= 3))
        .select(
            "Segment", F.col("day").cast("string").alias("Date"), "New Customers",
            rounded(mean, 2).alias("Segment Mean"), rounded(limit, 2).alias("Threshold"),
            F.lit("HIGH").alias("Risk"),
        )
        .orderBy(*desc("New Customers"), *asc("Segment", "Date"))
    )
    return flagged if top_n is None else flagged.limit(top_n)


SCREENS = {
    "address_clustering": address_clustering,
    "name_similarity": name_similarity,
    "email_domain_anomalies": email_domain_anomalies,
    "sequential_kyc": sequential_documents,
    "income_benford": income_benford,
    "kyc_by_branch": kyc_by_branch,
    "onboarding_velocity": onboarding_velocity,
}


def run_screens(df: DataFrame, keys=None, options: dict[str, dict] | None = None) -> dict[str, ReportResult]:
    """The chosen screens as lazy plans; one that cannot run becomes a note. `options` holds arguments by screen."""
    options = options or {}
    unknown = set(options) - set(SCREENS)
    if unknown:
        raise ValueError(f"unknown screens {sorted(unknown)}")
    return {k: plan_report(k, SCREENS[k], df, **options.get(k, {})) for k in SCREENS if keys is None or k in keys}
