"""Conversation repair against all ways to repair, and the damage against a plain loop."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from tillroll.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, n int, mark string, sha long"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def damage(rows):
    found = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        found += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return found


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        if BLANK.fullmatch(text):
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        elif text.strip("\t\n\x0b\x0c\r ")[-1] not in ".!?":
            found.append("truncated")
        else:
            found.append(None)
        seen.add((role, text))
    return found


def cheapest(rows, marks):
    """Least (cost, letters, turns) over all edits, by what may still follow."""

    @lru_cache(None)
    def best(i, prefix_state, inserts):
        # prefix_state: 0 nothing, 1 after s, 2 after u, 3 after a
        ways = []
        if i == len(rows) and prefix_state in (0, 3):
            ways.append((0, "", ()))

        def say(cost, letter, role, text, j, more):
            nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((prefix_state, role[:1]))
            if nxt is not None:
                rest = best(j, nxt, more)
                if rest:
                    ways.append((cost + rest[0], letter + rest[1], ((role, text), *rest[2])))

        if inserts < 3:
            for role in ("user", "assistant"):
                say(2, "I", role, "", i, inserts + 1)
        if i < len(rows):
            rest = best(i + 1, prefix_state, 0)
            if rest:
                ways.append((3 + rest[0], "D" + rest[1], rest[2]))
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                say(more, "K", *rows[i], i + 1, 0)
                for role in ("user", "assistant"):
                    say(2 + more, "R", role, rows[i][1], i + 1, 0)
        return min(ways, default=None)

    return best(0, 0, 0)


def brute_force(rows, ids):
    groups = {conv: [] for conv in ids}
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    result = []
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        said = [(role, text) for _, role, text in turns]
        marks = faults(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, letters, left = cheapest(tuple(said), tuple(marks))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        counts = [marks.count(m) for m in ("blank", "duplicate", "truncated")]
        result.append((conv, gaps, *counts, illegal, cost, letters, sha))
    return sorted(result, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, rows, ids=None, damaged=False, **options):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    given = frame if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id long")
    pieces = cv.repaired(cv.damaged(frame) if damaged else frame, given.select("conv_id"), **options)
    found = cv.summary(pieces)
    assert tuple(sorted(found.columns)) == tuple(sorted(COLUMNS))
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=repr)


def random_rows(seed, convs=60, most=9):
    pick = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(pick.randint(1, most)):
            role = pick.choice(["user", "assistant", "assistant", "user", "system", "tool", "", "ü"])
            text = pick.choice(["Yes.", "no", " ", "", "a\n", "Hm! ", "é?", "x.\t"]) + pick.choice(["", "", str(turn) + "."])
            rows.append((conv, turn + pick.choice([0, 0, 0, 5]), role, text))
    return rows


@pytest.mark.parametrize("options", [{}, {"piece_rows": 2}])
def test_random_conversations(spark, options):
    rows = random_rows(1)
    assert repaired(spark, rows, range(62), **options) == brute_force(rows, range(62))


def test_all_short_conversations():
    """Every sequence of up to four symbols, without Spark."""
    given = {"s": "system", "u": "user", "a": "assistant", "": "tool"}
    kinds = [(i, t) for i in given for t in (False, True)] + [cv.MUST_GO]
    for size in range(5):
        for symbols in product(kinds, repeat=size):
            rows = [(given.get(i, "user"), f"{n}{'' if t else '.'}") for n, (i, t) in enumerate(symbols)]
            marks = ["blank" if s == cv.MUST_GO else "truncated" if s[1] else None for s in symbols]
            cost, letters, left = cheapest(tuple(rows), tuple(marks))
            runs = [(s, 1) for s in symbols]
            assert cv.solve(runs, cv.AT_END, 0, True)[:2] == (cost, letters), symbols
            kept = [{"role": r, "text": t} for (r, t), s in zip(rows, symbols) if s != cv.MUST_GO]
            made = cv.repaired_rows(runs, kept, letters, 0)
            assert tuple((m["role"], m["text"]) for m in made) == left


def test_runs_equal_single_turns():
    pick = random.Random(4)
    kinds = [(i, t) for i in ("s", "u", "a", "") for t in (False, True)] + [cv.MUST_GO]
    for _ in range(200):
        runs = [(pick.choice(kinds), pick.choice([1, 2, 3, 7, 40])) for _ in range(pick.randint(1, 6))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        assert cv.solve(runs, cv.AT_END, 0, True) == cv.solve(single, cv.AT_END, 0, True)
        m = cv.transition(runs)
        costs = [min(m[4 * q + e] + cv.AT_END[e] for e in cv.STATES) for q in cv.STATES]
        assert tuple(costs) == cv.costs_before(single, cv.AT_END)[0]


def test_hot_conversation_in_many_pieces(spark):
    pick = random.Random(9)
    hot = [(7, n // 2, pick.choice(["user", "assistant", "tool"]), pick.choice(["ok.", "", f"{n}.", f"{n}"])) for n in range(1500)]
    rows = hot + [(7, None, "user", "same.")] * 700 + random_rows(2, convs=5)
    whole = repaired(spark, rows, range(8))
    assert repaired(spark, rows, range(8), piece_rows=16) == whole
    assert repaired(spark, rows, range(8), piece_chars=100) == whole
    audit = next(r for r in whole if r[0] == 7)[7]
    assert len(audit.replace("I", "")) == 2200
    # Forwards, the costs of the states after each turn, as a plain loop has them.
    turns = sorted([(t is not None, t or 0, r, hashlib.sha256(x.encode()).digest(), x) for c, t, r, x in rows if c == 7])
    said = [(r, x) for _, _, r, _, x in turns]
    costs = {0: 0}
    for (role, _), mark in zip(said, faults(said)):
        for _ in range(3):
            for q in list(costs):
                nxt = cv.DUE[q][1]
                costs[nxt] = min(costs.get(nxt, 10**9), costs[q] + 2)
        after = {}
        for q, c in costs.items():
            ways = [(q, 3)]
            if mark not in ("blank", "duplicate"):
                ways.append((cv.DUE[q][1], 2 + (mark == "truncated")))
                if role[:1] in cv.FOLLOWS[q]:
                    ways.append((cv.FOLLOWS[q][role[:1]], mark == "truncated"))
            for s, more in ways:
                after[s] = min(after.get(s, 10**9), c + more)
        costs = after
    assert next(r for r in whole if r[0] == 7)[6] == min(costs[q] + cv.AT_END[q] for q in costs)


def test_damage_and_odd_rows(spark):
    rows = random_rows(5, convs=40)
    rows += [(None, None, None, None)] * 4 + [(None, 3, "user", None), (3, None, None, "Hi."), (90, 0, "user", "x" * 200_000)]
    rows += [(c, 0, "user", "Only.") for c in range(100, 140)]
    rows += [(200, 2**63 - 1, "user", "a."), (200, -(2**63), "user", "b."), (3, 1, "user", "Hi."), (3, 1, "user", "Hi.")]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert sorted(map(tuple, cv.damaged(frame).collect()), key=repr) == sorted(damage(rows), key=repr)
    ids = list(dict.fromkeys(r[0] for r in rows))
    expected = [(r[0], min(r[1], 2**63 - 1), *r[2:]) for r in brute_force(damage(rows), ids)]
    assert any(r[7] == "" for r in expected)
    assert repaired(spark, rows, damaged=True) == expected
    assert repaired(spark, rows, damaged=True, piece_rows=1) == expected
    assert repaired(spark, [], damaged=True) == []


def test_turns_follow_the_pattern(spark):
    rows = random_rows(6, convs=30)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    turns = cv.repaired_turns(cv.repaired(frame, piece_rows=2)).orderBy("conv_id", "part", "seq", "place").collect()
    roles = {}
    for r in turns:
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[:1]
    assert all(re.fullmatch("(s?(ua)+)?", r) for r in roles.values())


def test_without_broadcasts(spark, large_lookups):
    rows = random_rows(8, convs=12)
    assert repaired(spark, rows, piece_rows=2) == brute_force(rows, range(12))
