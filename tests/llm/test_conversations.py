"""Conversation repair against an exhaustive script search and a plain reading of the damage."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shoplane.llm import survivors as V
from shoplane.llm.conversations import conversation_digest, damage, repair_conversations
from tests.conftest import SF_SMALL


def cheapest(rows):
    """(cost, edits, roles) over rows of (initial, must_go, truncated): all scripts, whole strings compared."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        todo = list(best.items())
        while todo:
            state, (cost, edits) = todo.pop()
            to, new = turn[state], (cost + 2, edits + "I")
            if to not in best or new < best[to]:
                best[to] = new
                todo.append((to, new))
        return best

    best = inserts({"": (0, "")})
    for initial, must_go, truncated in rows:
        found = {}
        for state, (cost, edits) in best.items():
            new = [(state, cost + 3, "D")]
            if not must_go:
                new.append((turn[state], cost + 2 + truncated, "R"))
                if initial and (state + initial) in ("s", "u", "su", "au", "ua"):
                    new.append((initial, cost + truncated, "K"))
            for to, c, e in new:
                found[to] = min(found.get(to, (c, edits + e)), (c, edits + e))
        best = inserts(found)
    return min(best[s] for s in ("", "a") if s in best)


def every_script(rows):
    """Truly all scripts with at most two inserts in a row, by the role pattern alone."""
    options = []
    for initial, must_go, truncated in rows:
        options.append([("D", "", 3)] + ([] if must_go else [("K", initial, truncated), ("R", "u", 2 + truncated), ("R", "a", 2 + truncated)]))
    fill = [("", "", 0), ("I", "u", 2), ("I", "a", 2), ("II", "ua", 4), ("II", "au", 4)]
    best = None
    for picks in itertools.product(*options):
        for gaps in itertools.product(fill, repeat=len(rows) + 1):
            parts = [gaps[0], *(x for pair in zip(picks, gaps[1:]) for x in pair)]
            if re.fullmatch("(s?(ua)+)?", "".join(p[1] for p in parts)):
                new = (sum(p[2] for p in parts), "".join(p[0] for p in parts))
                best = min(best or new, new)
    return best


def solve(rows):
    one = V.Repair()
    out = "".join([one.read(*r) for r in rows])
    cost, last = one.end()
    return (cost, out + last), one


def _rows(rng, n, initials="suatx"):
    return [(rng.choice(initials), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_scripts_are_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = _rows(rng, rng.randrange(14), rng.choice(["suat", "ua", "u", "a", "s", "su"]))
        assert solve(rows)[0] == cheapest(rows), rows
    for _ in range(12):
        rows = _rows(rng, rng.randrange(4))
        assert solve(rows)[0] == cheapest(rows) == every_script(rows), rows


def test_long_scripts_stay_right_and_small():
    rng = random.Random(9)
    for initials in ("ua", "u", "uuuas"):
        rows = _rows(rng, 3000, initials)
        assert solve(rows)[0] == cheapest(rows)
    one, most = V.Repair(), 0
    for i in range(50_000):  # an ordinary conversation, with a lost turn now and then
        if i % 97:
            one.read("ua"[i % 2], False, i % 31 == 0)
            most = max(most, one.tree.size)
    assert most < 400
    one = V.Repair()
    for _ in range(100_000):  # nothing resolves here: still a few steps a turn
        one.read("u", False, False)
    assert one.end()[0] == 100_000 and one.tree.size <= 400_010


def expected(rows):
    """A plain reading of the contract over (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        out = by.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            rest = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(turns, faults)])
        lines, state, at = [], "", iter(turns)
        for e in audit:
            _, role, text = (None, None, "") if e == "I" else next(at)
            if e == "D":
                continue
            new = role if e == "K" else "assistant" if state == "u" else "user"
            state = new[:1]
            lines.append(f"{new}:{text}")
        known = [t for t, *_ in turns if t is not None]
        result[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
                        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
                        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def _digest(rows):
    return {r[0]: tuple(r)[1:] for r in conversation_digest(repair_conversations(damage(rows))).collect()}


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    assert _digest(rows) == expected([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \n", None, "Why? \t", "é!", "x" * 50_000 + ".", "a\u0085", "Yes."]
    rows = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "Ünder", "u"]), rng.choice(texts))
            for c in [None, *range(40)] for _ in range(rng.randrange(1, 12))]
    rows += [(1000, t, "user", "Same words.") for t in range(500)] + [(1001, 3, "user", "Hi.")] * 6
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema + ", copy int, said string, present string")
    got = _digest(df)
    assert got == expected(rows)
    lost = [c for c in range(2000, 2400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    assert set(_digest(spark.createDataFrame([(c, 0, "user", "Hi.") for c in lost], schema)).values()) == {
        (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert _digest(df.limit(0)) == {}


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", True), (1, 1, "user", "Who?", True), (1, 2, "assistant", "Me", True),
                                  (2, 0, "user", "gone", False)], "conv_id int, turn int, role string, text string, present boolean")
    got = sorted(tuple(r) for r in repair_conversations(rows).collect())
    assert got[:-1] == [(1, 0, "K", 0, "user", "user", "Hi.", ""), (1, 1, "I", None, None, "assistant", "", ""),
                        (1, 2, "K", 1, "user", "user", "Who?", ""), (1, 3, "K", 2, "assistant", "assistant", "Me", "truncated")]
    assert got[-1] == (2, 0, None, None, None, None, None, None)
