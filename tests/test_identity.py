import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.components import connected_components
from ledgerlens.operators.skew import join_key_stats
from ledgerlens.plans import duplicates, engine, identity
from ledgerlens.plans.addresses import AddressBook
from ledgerlens.plans.identity import single_name, ucid_columns, unique_customers
from ledgerlens.session import row_count

SCHEMA = "_row_num long, customer_id string, full_name string, pan string, mobile string, address_line1 string, state string, lan string"


def people(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def components_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("hot_rows", [2_000_000, 3])
def test_components_match_union_find(spark, hot_rows):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(1000, 1001 + i) for i in range(60)]  # a hot centre
    edges += [(2000 + i, 2001 + i) for i in range(40)]  # a chain
    df = spark.createDataFrame(edges, "a long, b long")
    members, largest = connected_components(df, hot_rows=hot_rows)
    got = {r["node"]: r["component"] for r in members.collect()}
    wanted = components_by_hand([e for e in edges if e[0] != e[1]])
    assert got == wanted
    sizes = defaultdict(int)
    for c in wanted.values():
        sizes[c] += 1
    assert largest == max(sizes.values())


def test_hot_keys_join_like_cold_ones(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)], "id long, key string")
    stats = rows.groupBy("key").count().withColumnRenamed("count", "n")
    plain = sorted(map(tuple, rows.join(stats, "key").collect()))
    assert sorted(map(tuple, join_key_stats(rows, stats, ["key"], "n", hot_rows=20).collect())) == plain


def test_shared_pan_groups_rows_and_names_them_by_position(spark):
    df = people(spark, [
        (1, "C1", "A", "AAAA0000A", "", "", "KA", "L1"), (2, "C2", "B", "BBBB1111B", "", "", "MH", "L2"),
        (3, "C3", "A", " aaaa0000a", "", "", "KA", "L3"),
    ])
    got = {r["_row_num"]: r for r in engine.run_rules(df, "s", rules=["ucid"]).collect()}
    assert got[1]["ucid"] == got[3]["ucid"] == hashlib.sha256(b"0,2").hexdigest()[:16]
    assert got[2]["ucid"] == hashlib.sha256(b"1").hexdigest()[:16]
    assert [got[i]["ucid_size"] for i in (1, 2, 3)] == [2, 1, 2]
    assert not any(r["exceptions"] for r in got.values())


def test_conflicting_kyc_is_reported_on_every_member(spark):
    df = people(spark, [(1, "C1", "A", "AAAA0000A", "", "", "KA", "L1"), (2, "C2", "A", "AAAA0000A", "", "", "MH", "L2")])
    got = engine.run_rules(df, "s", rules=["ucid"]).collect()
    assert [[e["code"] for e in r["exceptions"]] for r in got] == [["UCID_KYC_INCONSISTENT"]] * 2


def test_large_groups_are_named_without_listing(spark):
    rows = [(i, f"C{i}", "A", "P", "", "", "KA", f"L{i}") for i in range(1, 9)] + [(9, "C9", "B", "Q", "", "", "KA", "L9")]
    df = people(spark, rows)
    grouped = unique_customers(df, "s", None, listed_members=3)
    got = ucid_columns(df, grouped).collect()
    assert len({r["ucid"] for r in got}) == 2 and {r["ucid_size"] for r in got} == {8, 1}
    mark = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]
    assert got[0]["ucid"] == mark(",".join([mark("0,1,2"), mark("3,4,5"), mark("6,7")]))
    whole = unique_customers(df, "s", None).collect()
    assert {r["ucid"] for r in whole} == {mark("0,1,2,3,4,5,6,7")}


def test_long_template_addresses_make_few_edges(spark):
    words, counts = [f"street{chr(97 + i)}" for i in range(21)], []
    for n in (100, 200, 400):
        rows_ = [(i, f"C{i}", "", "", "", "", "KA", f"L{i}") for i in range(1, n + 1)]
        df = people(spark, rows_).withColumn("address_line1", F.concat(F.lit(" ".join(words) + " plot"), F.col("_row_num").cast("string")))
        edges = AddressBook(df).edges()
        counts.append(edges.count())
    print(counts)
    assert counts[2] < 4.5 * counts[0]


def test_distinct_loans_of_one_person_are_no_duplicate(spark):
    df = people(spark, [
        (1, "C1", "Alice K", "ABCPK1234A", "", "", "", "LN001"), (2, "C2", "Alice K", "ABCPK1234A", "", "", "", "LN002"),
        (3, "C3", "Bob R", "XYZPB9999B", "", "", "", "LN003"), (4, "C4", "Bob R", "XYZPB9999B", "", "", "", "LN003"),
    ])
    for scope in ("person", "observed"):
        got = {r["_row_num"]: r for r in engine.run_rules(df, "s", rules=["ucid", "pan_duplicate"], scope=scope).collect()}
        codes = {i: [e["code"] for e in got[i]["exceptions"] if e["rule_id"] == "pan_duplicate"] for i in got}
        assert codes == {1: [], 2: [], 3: ["PAN_DUPLICATE"], 4: ["PAN_DUPLICATE"]}
    assert "C4" in [e["desc"] for e in got[3]["exceptions"] if e["rule_id"] == "pan_duplicate"][0]


def allowed_by_hand(row, sharers, scope):
    """Row-by-row statement of the exception, for comparison."""
    _, cid, ucid, lan = row
    if not ucid or (scope == "person" and len({s[2] for s in sharers}) > 1):
        return False
    if scope == "observed":
        named = {s[1] for s in sharers if s[1]}
        sharers = [s for s in sharers if len(named) > 1 or s[1] == ""]
        if ucid not in [s[2] for s in sharers]:
            return False
        sharers = [s for s in sharers if s[2] == ucid]
    lans = [s[3] for s in sharers if s[1] != cid] + [lan]
    return len(set(lans)) == len(lans)


@pytest.mark.parametrize("scope,hot_rows", [("person", 2_000_000), ("observed", 2_000_000), ("person", 2), ("observed", 2)])
def test_scopes_match_the_row_by_row_statement(spark, scope, hot_rows):
    rng = random.Random(11)
    rows, keys = [], defaultdict(list)
    for i in range(1, 161):
        key = rng.choice(["hot"] * 6 + [f"m{k}" for k in range(25)])
        cid, ucid, lan = rng.choice(["", "A", "B", "C", "D"]), rng.choice(["U1", "U1", "U2", ""]), f"L{rng.randrange(60)}"
        if key.startswith("m"):
            cid, ucid = rng.choice(["A", "A", "B"]), f"U{key[1:]}"
        rows.append((i, cid, ucid, lan, key))
        keys[key].append((i, cid, ucid, lan))
    df = spark.createDataFrame(rows, "_row_num long, customer_id string, ucid string, lan string, mobile string")
    got = {r["_row_num"] for r in duplicates.flagged_rows(df, ["mobile"], "s", scope, hot_rows).collect()}
    wanted = set()
    for sharers in keys.values():
        ids = {s[1] for s in sharers}
        if len(ids - {""}) > 1 or (len(ids - {""}) == 1 and "" in ids):
            wanted |= {s[0] for s in sharers if not allowed_by_hand(s, sharers, scope)}
    assert got == wanted


def test_blank_and_null_ids(spark):
    df = spark.createDataFrame(
        [(1, None, "P1"), (2, "A", "P1"), (3, "", "P2"), (4, "A", "P2"), (5, "B", "P3"), (6, "B", "P3")],
        "_row_num long, customer_id string, pan string",
    )
    rows = duplicates.flagged_rows(df, ["pan"], "s", "none")
    assert {r["_row_num"] for r in rows.collect()} == {3, 4}


def near(a, b, heavy=None, counts=None):
    x, y = set(a.upper().split()), set(b.upper().split())
    evidence = [t for t in x & y if len(t) >= 4 and (heavy is None or counts[t] <= heavy)]
    return len(evidence) >= 3 and len(x & y) / len(x | y) >= 0.85


@pytest.mark.parametrize("heavy", [None, 12])
def test_near_addresses_match_all_pairs(spark, heavy):
    rng = random.Random(3)
    lines = []
    for base in range(6):
        words = [f"word{base}x{i}" for i in range(rng.choice([5, 7, 13, 15, 21, 24]))]
        for _ in range(12):
            kept = [w for w in words if rng.random() > 0.06] + (["extra" + str(rng.randrange(40))] if rng.random() < 0.4 else [])
            rng.shuffle(kept)
            lines.append(" ".join(kept))
    lines += ["", "  ", "abc def", "MAIN ROAD CITY", "main road city"]
    cids = [f"C{rng.randrange(30)}" for _ in lines]
    counts = defaultdict(int)
    for line in lines:
        for t in set(line.upper().split()):
            counts[t] += 1
    df = spark.createDataFrame(
        [(i + 1, cids[i], lines[i]) for i in range(len(lines))], "_row_num long, customer_id string, address_line1 string"
    )
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if near(lines[i], lines[j], heavy, counts)]
    for hot_rows in (2_000_000, 2):
        book = AddressBook(df, heavy_rows=heavy, hot_rows=hot_rows)
        wanted = {i + 1 for p in pairs for i in p if cids[p[0]] != cids[p[1]]}
        assert {r["_row_num"] for r in book.duplicate_rows().collect()} == wanted
        tied = components_by_hand([(r["a"], r["b"]) for r in book.edges().collect()])
        assert tied == components_by_hand([(i + 1, j + 1) for i, j in pairs])


def test_groups_of_any_size_have_one_formula(spark):
    rows = [(i, f"C{i}", "A", "P", "", "", "KA", f"L{i}") for i in range(1, 3001)] + [(i, "C", "B", f"Q{i // 2}", "", "", "KA", "") for i in range(4000, 4006)]
    grouped = unique_customers(people(spark, rows), "s", None).collect()
    mark = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]
    assert {r["ucid"] for r in grouped} == {mark(",".join(map(str, range(3000))))} | {mark(f"{i - 1},{i}") for i in (4000, 4002, 4004)}


def test_blocks_name_small_groups_by_the_same_formula(spark):
    df = people(spark, [(1, "C1", "A", "P", "", "", "", ""), (2, "C2", "A", "P", "", "", "", ""), (3, "C3", "B", "Q", "", "", "", "")])
    grouped = unique_customers(df, "s", None, listed_members=5)
    got = {r["_row_num"]: r["ucid"] for r in ucid_columns(df, grouped, single_name(df, "s", listed_members=5)).collect()}
    mark = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]
    assert got == {1: mark(mark("0,1")), 2: mark(mark("0,1")), 3: mark(mark("2"))}


def test_key_names_survive_another_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", f"C{i}"]), rng.choice(["A", "B", ""]), rng.choice(["", f"P{rng.randrange(30)}"]), "", rng.choice(["", f"12 ROAD{i % 9} MAIN STREET CITY"]),
             "KA", f"L{i}") for i in range(1, 200)]
    names = []
    for order in (rows, rng.sample(rows, len(rows)), rows[::-1]):
        df = people(spark, [(n, *r[1:]) for n, r in enumerate(order, 1)])
        got = engine.run_rules(df, "s", rules=["ucid"], id_by="key").collect()
        names.append({r["lan"]: (r["ucid"], r["ucid_size"]) for r in got})
    assert names[0] == names[1] == names[2]
    assert len({n for n, _ in names[0].values()}) == len({r["ucid"] for r in engine.run_rules(people(spark, rows), "s", rules=["ucid"]).collect()})
    with pytest.raises(ValueError):
        unique_customers(people(spark, rows), "s", None, id_by="name")


@pytest.mark.parametrize("seed", [1, 2])
def test_long_lines_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    lines = []
    for base in range(7):
        words = [f"word{base % 3}x{i}" for i in range(rng.choice([18, 22, 28, 33, 45]))]
        for _ in range(14):
            kept = [w for w in words if rng.random() > 0.07] + [f"extra{rng.randrange(30)}" for _ in range(rng.choice([0, 0, 1, 4]))]
            lines.append(" ".join(rng.sample(kept, len(kept))))
    cids = [f"C{rng.randrange(6)}" for _ in lines]
    df = spark.createDataFrame([(i + 1, cids[i], line) for i, line in enumerate(lines)], "_row_num long, customer_id string, address_line1 string")
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if near(lines[i], lines[j])]
    assert len(pairs) > 50
    book = AddressBook(df)
    assert {r["_row_num"] for r in book.duplicate_rows().collect()} == {i + 1 for p in pairs for i in p if cids[p[0]] != cids[p[1]]}
    assert components_by_hand([(r["a"], r["b"]) for r in book.edges().collect()]) == components_by_hand([(i + 1, j + 1) for i, j in pairs])


def test_long_template_lines_are_linear(spark):
    words, counts = [f"street{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(28)], []
    for n in (500, 1000, 2000):
        rows_ = [(i, f"C{i}", "", "", "", "", "KA", f"L{i}") for i in range(1, n + 1)]
        df = people(spark, rows_).withColumn("address_line1", F.concat(F.lit(" ".join(words) + " plot"), F.col("_row_num").cast("string")))
        book = AddressBook(df)
        counts.append(book.edges().count())
        if n == 500:
            assert book.duplicate_rows().count() == n
    print(counts)
    assert counts[2] < 5 * counts[0] < 50 * 500


def test_equal_rows_are_grouped_as_one_profile(spark, monkeypatch):
    """A customer's loans send one line a key; rows without keys stay apart however equal they are, unless an address ties them."""
    written = {}
    kept = identity.materialize
    monkeypatch.setattr(identity, "materialize", lambda df, label: written.setdefault(label, kept(df, label)))
    line = "ROSE VILLA LONG LANE"
    rows = [(i + 1, f"C{i}", "", f"ABCPK{i % 4:04d}A", "", None, "goa", f"L{i}") for i in range(400)]
    rows += [(401 + i, "", "", "", "", None, "goa", "") for i in range(5)]
    rows += [(411 + i, "", "", "", "", line, "goa" if i else "assam", "") for i in range(5)]
    df = people(spark, rows)
    got = {r["_row_num"]: (r["ucid"], r["ucid_size"], r["conflict"]) for r in unique_customers(df, "s", AddressBook(df)).collect()}
    assert row_count(written["keys"]) == 4
    for first in (0, 1, 2, 3):
        name = hashlib.sha256(",".join(str(n) for n in range(first, 400, 4)).encode()).hexdigest()[:16]
        assert {got.pop(n + 1) for n in range(first, 400, 4)} == {(name, 100, False)}
    assert set(got) == set(range(411, 416)) and {(size, conflict) for _, size, conflict in got.values()} == {(5, True)}


def test_forms_of_a_row_are_worked_out_once(spark, tmp_path):
    from checks import views
    from ledgerlens import session

    master = views.view(spark, "/root/testdata/sf0.001", "customer_master")
    profiles, rows = identity.row_profiles(master, "salt", AddressBook(master))
    assert not rows.schema["profile"].nullable  # else every join on it works the whole profile out again to look for NULLs
    plan = rows.join(profiles, "profile")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("md5(cast(concat(") == 1
    assert rows.select("profile").distinct().count() == profiles.count() == rows.join(profiles.select("profile"), "profile").select("profile").distinct().count()
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    seen = []
    with session._short_methods(spark):
        seen.append(int(spark.conf.get(key)))
    with pytest.raises(ZeroDivisionError), session._short_methods(spark):
        1 / 0
    assert seen == [8000] and spark.conf.get(key) == before
