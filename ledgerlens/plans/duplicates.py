"""Keys shared by different customers, with the same-person exception.

The work is stacked over all kinds of key: one aggregation finds the shared keys, one
skew-safe join fetches their rows, and everything after touches those rows only. No
step lists the pairs or the members of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.values import text
from ledgerlens.operators.skew import HOT_ROWS, join_key_stats
from ledgerlens.plans.link_keys import link_table
from ledgerlens.plans.row_rules import found, say
from ledgerlens.session import materialize, row_count

# rule id -> (kind of key, exception code, description, message). Codes and messages are fixed values.
DUPLICATE_RULES = {
    "pan_duplicate": (
        "pan", "PAN_DUPLICATE",
        "no other customer has the PAN, one person's separate loans apart",
        "PAN '%s' is shared with customer(s): %s"),
    "aadhaar_duplicate": (
        "aadhaar", "AADHAAR_DUPLICATE",
        "no other customer has the Aadhaar (compared by hash), one person's separate loans apart",
        "Aadhaar (masked) is shared with customer(s): %s"),
    "mobile_duplicate": (
        "mobile", "MOBILE_DUPLICATE",
        "no other customer has the phone number, one person's separate loans apart",
        "Mobile '%s' is shared with customer(s): %s"),
    "bank_account_duplicate": (
        "bank_account", "BANK_ACCOUNT_DUPLICATE",
        "no other customer has the bank account, one person's separate loans apart",
        "Bank account '%s' is shared with customer(s): %s"),
    "name_dob_duplicate": (
        "name_dob", "NAME_DOB_DUPLICATE",
        "no other customer has the name and birth date, one person's separate loans apart",
        "Name+DOB combination '%s' matches customer(s): %s"),
    "voter_id_duplicate": (
        "voter_id", "VOTER_ID_DUPLICATE",
        "no other customer has the voter card, one person's separate loans apart",
        "Voter ID '%s' is shared with customer(s): %s"),
}
ADDRESS_RULE = (
    "address_duplicate", "ADDRESS_DUPLICATE",
    "no other customer has nearly the same words in the address line",
    "Address is fuzzy-similar to another record (similarity >=85%)",
)
SHOWN = 5  # other customers named in a message


def shared_rows(df: DataFrame, kinds, salt: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row whose key is used by different customers, one line per row and kind.

    A key counts when two non-blank ids differ, or a non-blank id meets a blank one.
    """
    extra = {"ucid": text(df, "ucid"), "lan": text(df, "lan")}
    keys = materialize(link_table(df, kinds, salt, extra), "keys")
    named = F.when(F.col("cid") != "", F.col("cid"))
    uses = (
        keys.groupBy("kind", "key")
        .agg(
            F.count("*").alias("uses"),
            F.min(named).alias("low_id"),
            F.max(named).alias("high_id"),
            F.max((F.col("cid") == "").cast("int")).alias("blank"),
            (F.min("ucid") == F.max("ucid")).alias("one_ucid"),
        )
        .withColumn("several", F.coalesce(F.col("low_id") != F.col("high_id"), F.lit(False)))
        .filter(F.col("several") | (F.col("low_id").isNotNull() & (F.col("blank") == 1)))
        .select("kind", "key", "uses", "several", "one_ucid")
    )
    return join_key_stats(keys, uses, ["kind", "key"], "uses", hot_rows)


def _other_ids(shared: DataFrame) -> DataFrame:
    """(kind, key, ids, n_ids): the few smallest ids of a key, enough to name SHOWN others, and how many it has.

    The rank filter is applied before the shuffle as well, so a hot key sends at most
    SHOWN + 1 ids from each task.
    """
    ids = shared.filter(F.col("cid") != "").select("kind", "key", "cid").distinct()
    place = F.row_number().over(Window.partitionBy("kind", "key").orderBy("cid"))
    few = ids.withColumn("place", place).filter(F.col("place") <= SHOWN + 1)
    named = few.groupBy("kind", "key").agg(F.array_sort(F.collect_list("cid")).alias("ids"))
    return named.join(ids.groupBy("kind", "key").agg(F.count("*").alias("n_ids")), ["kind", "key"])


def _lan_clashes(shared: DataFrame, group: list[str], hot_rows: int, size: int) -> DataFrame:
    """Adds `clash` (a loan number repeats among the sharers or with this row) and `listed_here`.

    For a row of customer c the sharers are the listed rows of other customers in its
    group. Their loan numbers repeat unless c itself holds all but one of the rows of
    every repeated number; at most two customers of a group can satisfy that, so the
    exempt customers travel as two values.
    """
    by_customer = shared.groupBy(*group, "lan", "cid").agg(
        F.sum(F.col("listed").cast("long")).alias("m"), F.count("*").alias("n")
    )
    holder = F.when(F.col("m") > 0, F.col("cid"))
    by_lan = by_customer.groupBy(*group, "lan").agg(
        F.sum("n").alias("lan_rows"),
        F.sum("m").alias("lan_listed"),
        F.max("m").alias("top"),
        F.max_by("cid", "m").alias("top_cid"),
        F.min(holder).alias("lan_low"),
        F.max(holder).alias("lan_high"),
    )
    spared = (
        F.when((F.col("lan_listed") == 2) & (F.col("top") == 1), F.array("lan_low", "lan_high"))
        .when(F.col("top") >= F.col("lan_listed") - 1, F.array("top_cid"))
    )
    repeated = by_lan.filter("lan_listed > 1")
    hits = repeated.select(*group, F.explode(spared).alias("cid")).groupBy(*group, "cid").agg(F.count("*").alias("hits"))
    exempt = hits.groupBy(*group).agg(
        F.max("hits").alias("most_hits"),
        F.max(F.struct("hits", "cid"))["cid"].alias("exempt_high"),
        F.min(F.struct(-F.col("hits"), "cid"))["cid"].alias("exempt_low"),
    )
    totals = by_lan.groupBy(*group).agg(
        F.sum("lan_rows").alias("group_rows"),
        F.count_if(F.col("lan_listed") > 1).alias("repeats"),
        F.sum("lan_listed").alias("group_listed"),
    )
    by_group = totals.join(exempt, group, "left")
    with_group = join_key_stats(shared, by_group, group, "group_rows", hot_rows, size)
    lan_side = by_lan.select(*group, "lan", "lan_rows", "lan_low", "lan_high")
    both = join_key_stats(with_group, lan_side, [*group, "lan"], "lan_rows", hot_rows, size)
    mine = F.col("cid")
    is_exempt = (F.col("most_hits") == F.col("repeats")) & ((F.col("exempt_low") == mine) | (F.col("exempt_high") == mine))
    among_others = (F.col("repeats") > 0) & ~F.coalesce(is_exempt, F.lit(False))
    with_mine = F.coalesce((F.col("lan_low") != mine) | (F.col("lan_high") != mine), F.lit(False))
    return both.withColumns({"clash": among_others | with_mine, "listed_here": F.col("group_listed") > 0})


def flagged_rows(
    df: DataFrame, kinds, salt: str, scope: str = "person", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(_row_num, kind, key, ids, others) of the rows to report: a few other customers and how many there are.

    scope="none"      every row of a shared key;
    scope="person"    a key is excused where all its rows belong to one UCID and no loan
                      number repeats among the customers that share it;
    scope="observed"  a row is also excused when no other customer of its own UCID has
                      the key, even though customers of other UCIDs do.
    Without both a ucid and a lan column every scope reports every row.
    """
    shared = materialize(shared_rows(df, kinds, salt, hot_rows), "shared")
    size = row_count(shared)
    if scope == "none" or not {"ucid", "lan"} <= set(df.columns):
        judged = shared.withColumn("flag", F.lit(True))
    elif scope == "person":
        listed = shared.withColumn("listed", F.lit(True)).withColumn("cid", F.coalesce("cid", F.lit("")))
        marked = _lan_clashes(listed, ["kind", "key"], hot_rows, size)
        judged = marked.withColumn("flag", F.col("clash") | ~F.col("one_ucid") | (F.col("ucid") == ""))
    elif scope == "observed":
        in_list = F.when(F.col("several"), F.col("cid").isNotNull()).otherwise(F.coalesce(F.col("cid") == "", F.lit(False)))
        listed = shared.withColumn("listed", in_list).withColumn("cid", F.coalesce("cid", F.lit("")))
        marked = _lan_clashes(listed, ["kind", "key", "ucid"], hot_rows, size)
        judged = marked.withColumn("flag", F.col("clash") | ~F.col("listed_here") | (F.col("ucid") == ""))
    else:
        raise ValueError(f"unknown scope {scope!r}")
    rows = judged.filter("flag").select("_row_num", "kind", "key", "cid", "uses")
    others = shared.select("kind", "key", "uses").distinct().join(_other_ids(shared), ["kind", "key"])
    met = join_key_stats(rows.drop("uses"), others, ["kind", "key"], "uses", hot_rows, size)
    return met.select(
        "_row_num", "kind", "key",
        F.slice(F.filter("ids", lambda i: i != F.coalesce("cid", F.lit(""))), 1, SHOWN).alias("ids"),
        (F.col("n_ids") - (F.coalesce("cid", F.lit("")) != "").cast("long")).alias("others"),
    )


def _message(rule_id: str) -> Column:
    kind, _, _, pattern = DUPLICATE_RULES[rule_id]
    more = F.when(F.col("others") > SHOWN, F.concat(F.lit(" and "), (F.col("others") - SHOWN).cast("string"), F.lit(" more")))
    names = F.concat(F.array_join("ids", ", "), F.coalesce(more, F.lit("")))
    if kind == "aadhaar":
        return say(pattern, names)
    key = F.regexp_replace("key", r"^([^|]*)\|", "$1 / ") if kind == "name_dob" else F.col("key")
    return say(pattern, key, names)


def duplicate_findings(
    df: DataFrame, rule_ids, salt: str, scope: str = "person", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(_row_num, finding) for the chosen exact-key duplicate rules."""
    chosen = [r for r in DUPLICATE_RULES if r in rule_ids]
    rows = flagged_rows(df, [DUPLICATE_RULES[r][0] for r in chosen], salt, scope, hot_rows)
    finding = None
    for r in chosen:
        kind, code, _, _ = DUPLICATE_RULES[r]
        hit = found(r, "ERROR", code, _message(r))
        finding = F.when(F.col("kind") == kind, hit) if finding is None else finding.when(F.col("kind") == kind, hit)
    return rows.select("_row_num", finding.alias("finding"))


def address_findings(rows: DataFrame) -> DataFrame:
    rule_id, code, _, message = ADDRESS_RULE
    return rows.select("_row_num", found(rule_id, "WARN", code, message).alias("finding"))
