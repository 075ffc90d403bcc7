"""Unique customers: rows tied by shared documents or near-equal addresses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import documents as doc
from ledgerlens.functions.values import hex_hash, ref, strip, text
from ledgerlens.operators.components import connected_components
from ledgerlens.operators.skew import HOT_ROWS, join_key_stats
from ledgerlens.plans.addresses import AddressBook, address_id
from ledgerlens.plans.link_keys import PERSON_KINDS, identity_keys
from ledgerlens.plans.row_rules import found, say
from ledgerlens.session import materialize, row_count

def _bytes_of(c: Column) -> Column:
    """A value with its length in front, so that joined values can't be mistaken for others."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def _carried(df: DataFrame, salt: str, addresses: AddressBook | None, id_by: str) -> dict[str, Column]:
    """All that a row's group, its conflicts and its group's name depend on; blank is NULL. Hashes are held as bytes."""
    keys = {k: F.nullif(c, F.lit("")) for k, c in identity_keys(df, salt).items() if k in PERSON_KINDS}
    keyless = F.coalesce(*keys.values()).isNull()
    carried = {**keys, "aadhaar": F.unhex(keys["aadhaar"]), **{n: c for n, c in _kyc_fields(df, salt).items() if n not in keys}}
    if addresses is not None:
        carried["gid"] = address_id(df)
    carried["own"] = F.when(keyless, F.col("_row_num"))  # a row without keys is tied to no other by being equal
    if id_by == "key":
        carried["label"] = F.when(keyless, row_label(df, salt))
    return carried


def _profile_id(columns: dict[str, Column]) -> Column:
    texts = [F.hex(c) if n in ("aadhaar", "gid") else c.cast("string") for n, c in columns.items()]
    # 16 bytes; never NULL, and said so, else a join on it would work it all out a second time to look for NULLs
    return F.coalesce(F.unhex(F.md5(F.concat(*[_bytes_of(t) for t in texts]))), F.lit(b""))


def row_profiles(df: DataFrame, salt: str, addresses: AddressBook | None, id_by: str = "position") -> tuple[DataFrame, DataFrame]:
    """(profiles, rows): rows alike in keys, KYC fields and address are one profile, named by its first row.

    profiles: (profile, _row_num, rows, carried fields...), one line each and written; rows: (_row_num, profile).
    What follows on keys, addresses and conflicts reads a person's rows once, not once for each loan.
    """
    carried = _carried(df, salt, addresses, id_by)
    held = df.select("_row_num", *[c.alias(n) for n, c in carried.items()]).groupBy(*carried)
    first = held.agg(F.min("_row_num").alias("_row_num"), F.count("*").alias("rows"))
    profiles = first.select(_profile_id({n: F.col(n) for n in carried}).alias("profile"), "*")
    staged = df.select("_row_num", *[c.alias(f"__{n}") for n, c in carried.items()])  # each form is worked out once a row
    return materialize(profiles, "profiles"), staged.select("_row_num", _profile_id({n: F.col(f"__{n}") for n in carried}).alias("profile"))


def person_edges(profiles: DataFrame, addresses: AddressBook | None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): each profile tied to the first one with the same key, never all pairs of a key."""
    held = [F.struct(F.lit(k).alias("kind"), (F.hex(k) if k == "aadhaar" else F.col(k)).alias("key")) for k in PERSON_KINDS]
    keys = materialize(profiles.select("_row_num", F.inline(F.array(*held))).filter("key IS NOT NULL"), "keys")
    shared = (
        keys.groupBy("kind", "key")
        .agg(F.count("*").alias("rows"), F.min("_row_num").alias("first"))
        .filter("rows > 1")
    )
    by_key = (
        join_key_stats(keys, shared, ["kind", "key"], "rows", hot_rows)
        .filter(F.col("_row_num") != F.col("first"))
        .select(F.col("_row_num").alias("a"), F.col("first").alias("b"))
    )
    return by_key if addresses is None else by_key.unionByName(addresses.edges(profiles))


KYC_FIELDS = ("pan", "aadhaar", "voter_id", "email", "mobile", "state", "pincode")


def _kyc_fields(df: DataFrame, salt: str) -> dict[str, Column]:
    fields = {
        "pan": doc.pan_key(df),
        "aadhaar": doc.aadhaar_hash(df, salt),
        "voter_id": doc.voter_key(df),
        "email": F.lower(strip(text(df, "email"))),
        "mobile": doc.mobile_key(df),
        "state": F.upper(strip(text(df, "state"))),
        "pincode": strip(text(df, "pincode")),
    }
    return {n: F.nullif(c, F.lit("")) for n, c in fields.items()}


def _position(row_num: str = "_row_num") -> Column:
    return (F.col(row_num) - 1).cast("string")


def key_label(keys: dict[str, Column], salt: str) -> Column:
    """The smallest salted identity key, NULL where there is none."""
    return F.least(*[F.when(keys[k] != "", F.concat(F.lit("0"), hex_hash(F.concat_ws("|", F.lit(salt), F.lit(k), keys[k])))) for k in PERSON_KINDS])


def row_label(df: DataFrame, salt: str) -> Column:
    """A row's smallest salted identity key; a row without one has a label of its values, which is larger than any key's.

    Labels don't depend on the order of rows, so names made from them survive a shuffled file.
    """
    keys = identity_keys(df, salt)
    values = [F.coalesce(ref(c).cast("string"), F.lit("\x01")) for c in sorted(df.columns) if c not in ("_row_num", "ucid", "ucid_size")]
    own = F.concat(F.lit("1"), hex_hash(F.concat_ws("|", F.lit(salt), *values)))
    return F.coalesce(key_label(keys, salt), own)


def single_name(df: DataFrame, salt: str, id_by: str = "position", listed_members: int | None = None) -> Column:
    """The name of a row that is in no group."""
    if id_by == "key":
        return hex_hash(row_label(df, salt), 16)
    listed = hex_hash(_position(), 16)
    return listed if listed_members is None else hex_hash(listed, 16)


def _position_names(members: DataFrame) -> DataFrame:
    """(component, ucid): digest of all positions of a group, in order and comma-joined.

    The digest runs over the whole list, so a group is read in order by one task, but never held: a task keeps one digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            component, node = (batch.column(c).to_numpy() for c in ("component", "node"))
            if not len(node):
                continue
            starts = np.flatnonzero(np.append(True, component[1:] != component[:-1]))
            done = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
                listed = ",".join(map(str, (node[start:end] - 1).tolist())).encode()
                if component[start] == last:
                    digest.update(b"," + listed)
                    continue
                if last is not None:
                    done.append((last, digest.hexdigest()[:16]))
                last, digest = int(component[start]), hashlib.sha256(listed)
            if done:
                yield named(done)
        if last is not None:
            yield named([(last, digest.hexdigest()[:16])])

    def named(done) -> pa.RecordBatch:
        columns = list(zip(*done))
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["component", "ucid"])

    ordered = members.select("component", "node").repartition("component").sortWithinPartitions("component", "node")
    return ordered.mapInArrow(run, "component long, ucid string")


def _block_names(members: DataFrame, block: int) -> DataFrame:
    """(component, ucid): digest of the digests of a group's blocks of positions, from one member up.

    The place of a member in its group comes from counts per range of positions, so no window holds a whole group.
    """
    cut = members.withColumn("range", F.floor((F.col("node") - 1) / block))
    before = Window.partitionBy("component").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("component", "range").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("component", "range").orderBy("node")
    placed = cut.join(counts, ["component", "range"]).withColumn("place", F.col("before") + F.row_number().over(within) - 1)
    positions = F.array_sort(F.collect_list(F.col("node") - 1))
    name = hex_hash(F.array_join(positions.cast("array<string>"), ","), 16)
    names = placed.groupBy("component", F.floor(F.col("place") / block).alias("at")).agg(name.alias("name"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "name")))  # one line per block
    joined = F.array_join(F.transform(in_order, lambda b: b["name"]), ",")
    return names.groupBy("component").agg(hex_hash(joined, 16).alias("ucid"))


def unique_customers(
    df: DataFrame,
    salt: str,
    addresses: AddressBook | None = None,
    hot_rows: int = HOT_ROWS,
    listed_members: int | None = None,
    id_by: str = "position",
) -> DataFrame:
    """(_row_num, ucid, ucid_size, conflict) for rows in a group of two or more.

    `addresses` adds near-equal addresses to the shared keys. Rows that share nothing are left out; ucid_columns() names them
    by themselves. A group is named by the digest of its positions, whatever its size; with listed_members, by the digest of the digests of blocks of so
    many positions, which different tasks can work out; with id_by="key", by the smallest label of its rows, which stays the same when
    rows and files change their order.
    """
    if id_by not in ("position", "key"):
        raise ValueError(f"unknown id_by {id_by!r}")
    profiles, rows = row_profiles(df, salt, addresses, id_by)
    edges = person_edges(profiles, addresses, hot_rows)
    linked, _ = connected_components(edges, hot_rows)
    # the first row of a set of equal addresses is the first of its profile, so all nodes are first rows of profiles
    placed = profiles.join(linked.withColumnRenamed("node", "_row_num"), "_row_num", "left").filter("component IS NOT NULL OR rows > 1")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "_row_num")), "placed-profiles")
    members = join_key_stats(rows, placed.select("profile", "component", "rows"), ["profile"], "rows", hot_rows, row_count(df))
    members = materialize(members.select(F.col("_row_num").alias("node"), "component"), "members")
    differs = [F.coalesce(F.min(n) != F.max(n), F.lit(False)) for n in KYC_FIELDS]
    conflict = differs[0]
    for d in differs[1:]:
        conflict = conflict | d
    name = []
    if id_by == "key":
        placed = placed.withColumn("label", F.coalesce(key_label({k: F.lower(F.hex(k)) if k == "aadhaar" else F.col(k) for k in PERSON_KINDS}, salt), "label"))
        name = [hex_hash(F.min("label"), 16).alias("ucid")]
    named = placed.groupBy("component").agg(F.sum("rows").alias("ucid_size"), conflict.alias("conflict"), *name)
    if not name:
        names = _position_names(members) if listed_members is None else _block_names(members, listed_members)
        named = named.join(names, "component")
    return join_key_stats(members, named, ["component"], "ucid_size", hot_rows).select(
        F.col("node").alias("_row_num"), "ucid", F.col("ucid_size").cast("int").alias("ucid_size"), "conflict"
    )


def ucid_columns(df: DataFrame, grouped: DataFrame, single: Column | None = None) -> DataFrame:
    """Adds ucid, ucid_size and the ucid finding; a row outside every group is its own, under the name `single`."""
    joined = df.drop("ucid", "ucid_size").join(grouped, "_row_num", "left")
    ucid = F.coalesce(F.col("ucid"), hex_hash(_position(), 16) if single is None else single)
    said = say(
        "UCID %s has conflicting KYC data (PAN, Aadhaar, Voter ID, email, mobile, state, or pincode)", ucid
    )
    return joined.withColumns(
        {
            "__ucid_finding": F.when(F.col("conflict"), found("ucid", "WARN", "UCID_KYC_INCONSISTENT", said)),
            "ucid": ucid,
            "ucid_size": F.coalesce("ucid_size", F.lit(1)),
        }
    ).drop("conflict")


def beneficiary_columns(df: DataFrame, salt: str) -> DataFrame:
    """customer_key and group_id from the best identifier of the row itself."""
    pan, aadhaar, mobile = doc.pan_key(df), doc.aadhaar_hash(df, salt), doc.mobile_key(df)
    name_dob = doc.name_dob_key(df)
    token = F.coalesce(
        F.nullif(strip(text(df, "customer_id")), F.lit("")),
        F.nullif(strip(text(df, "_row_num")), F.lit("")),
    )
    unknown = F.concat(F.lit("UNK:"), hex_hash(token, 16))
    by_name = F.concat(F.lit("NDB:"), hex_hash(name_dob, 16))

    def best(pan_value, aadhaar_value, mobile_value) -> Column:
        return (
            F.when(F.length(pan) == 10, F.concat(F.lit("PAN:"), pan_value))
            .when(aadhaar != "", F.concat(F.lit("ADH:"), aadhaar_value))
            .when(F.length(mobile) == 10, F.concat(F.lit("MOB:"), mobile_value))
            .when(name_dob != "", by_name)
            .otherwise(unknown)
        )

    customer_key = best(hex_hash(pan, 16), hex_hash(aadhaar, 16), hex_hash(mobile, 16))
    link = best(pan, aadhaar, mobile)
    return df.withColumns(
        {"customer_key": customer_key, "group_id": F.concat(F.lit("GRP-"), F.upper(hex_hash(link, 8)))}
    )
