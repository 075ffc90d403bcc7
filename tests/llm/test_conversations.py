"""Conversation repair against an exhaustive search over edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from ledgerlens.llm import conversation_repair as cr


def _best(rows):
    """(cost, letters, repaired rows) by search over (row, state); rows are (initial, must_go, truncated)."""
    n = len(rows)
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserts):
        options = []
        if i == n and state in "0a":
            options.append((0, "", ()))
        if inserts < 3:
            for role, initial in (("user", "u"), ("assistant", "a")):
                if (state, initial) in after:
                    cost, letters, out = best(i, after[state, initial], inserts + 1)
                    options.append((cost + 3, "I" + letters, ((None, role),) + out))
        if i < n:
            initial, must_go, cut = rows[i]
            cost, letters, out = best(i + 1, state, 0)
            options.append((cost + 4, "D" + letters, out))
            if not must_go:
                if (state, initial) in after:
                    cost, letters, out = best(i + 1, after[state, initial], 0)
                    options.append((cost + 3 * cut, "K" + letters, ((i, None),) + out))
                for role, other in (("user", "u"), ("assistant", "a")):
                    if (state, other) in after:
                        cost, letters, out = best(i + 1, after[state, other], 0)
                        options.append((cost + 3 + 3 * cut, "R" + letters, ((i, role),) + out))
        return min(options) if options else (10 ** 9, "", ())

    return best(0, "0", 0)


def _brute(conversation):
    """The contract's columns for one conversation's (turn, role, text) rows after damage."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        kind = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    turns = [r[0] for r in rows if r[0] is not None]
    cost, letters, out = _best(tuple((r[1][:1], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(rows, kinds)))
    text = "\n".join(f"{role or rows[i][1]}:{'' if i is None else rows[i][2]}" for i, role in out)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())


def _damage(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = by.setdefault(conv, [])
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return by


@pytest.fixture(scope="module")
def hard_rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Same again.", "Why? ", "three dots...\n", "été.", "a\x1c"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown", "System"]
    rows = []
    for conv in range(400):
        turns = list(range(rng.randint(1, 12)))
        if conv % 5 == 0:
            turns = [rng.choice([None, -3, 4, 4, 9]) for _ in turns]
        rows += [(conv if conv else None, t, rng.choice(roles), rng.choice(texts)) for t in turns]
        if conv % 7 == 0:
            rows.append(rows[-1])
    rows += [(5000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3001)]
    return rows + [(conv, 0, "user", "alone.") for conv in range(6000, 6060)]


@pytest.fixture(scope="module")
def hard_frame(spark, hard_rows):
    rows = [(*r, 1, "x", True) for r in hard_rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault int, audit string, alive boolean")


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_damage_and_repair_equal_search(hard_frame, hard_rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.digests(cr.damaged(hard_frame)).collect()}
    by = _damage(hard_rows)
    assert set(got) == set(by)
    for conv, rows in by.items():
        if conv != 5000:  # the search recurses by row
            assert got[conv] == _brute(rows), (conv, rows)
    assert any(not rows for rows in by.values())


def test_intact_rows_and_repaired_texts(hard_frame, hard_rows):
    rows = cr.intact(hard_frame)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.digests(rows).collect()}
    by = {}
    for conv, turn, role, text in hard_rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got[5000][:7] == (0, 0, 0, 0, 0, 3, "K" * 3001 + "I")
    assert all(got[c] == _brute(r) for c, r in by.items() if c != 5000)
    lines = {}
    for r in sorted(cr.repaired(rows).collect(), key=lambda r: r["position"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, found in got.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == found[-1]


def test_blocks_equal_rows():
    rng = np.random.default_rng(3)
    many = [rng.integers(0, 9, n).astype(np.uint8) for n in [0, 1, 2, 3, 4, 5, 8, 9, 31, 32, 33, *rng.integers(1, 60, 200)]]
    for symbols, (cost, letters) in zip(many, cr.solve(many)):
        vector = cr.FINISH
        behind = []
        for s in symbols[::-1]:
            behind.append(vector)
            vector = cr.before(vector, int(s))
        state, want = 0, ""
        for s, after in zip(symbols, behind[::-1]):
            more, state = cr.traced(after, int(s), state)
            want += more
        assert cost == vector[0] and letters == want + "I" * (cr.FINISH[state] // 3)
    assert len(cr.tables().vectors) < 500


def test_no_rows(hard_frame):
    assert cr.digests(cr.damaged(hard_frame.limit(0))).count() == 0 == cr.repaired(cr.intact(hard_frame.limit(0))).count()
