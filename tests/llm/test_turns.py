"""Conversation repair against a search from the end, against plain damage and faults, and odd rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from paperloom.llm import turns
from paperloom.llm.common import table
from paperloom.llm.queries import QUERIES


def cheapest(rows):
    """(cost, letters) of rows (initial, fault), each tail solved on its own."""

    @lru_cache(maxsize=None)
    def rest(i, state, inserts):
        found = []
        if i == len(rows) and state in "zA":
            found.append((0, ""))
        into = {"z": "U", "S": "U", "U": "A", "A": "U"}[state]
        if inserts < 3:
            c, s = rest(i, into, inserts + 1)
            found.append((c + 2, "I" + s))
        if i < len(rows):
            initial, fault = rows[i]
            moves = [(3, "D", state)]
            if fault in (0, 3):
                more = fault // 3
                moves.append((2 + more, "R", into))
                to = {"zs": "S", "zu": "U", "Su": "U", "Ua": "A", "Au": "U"}.get(state + initial)
                if to:
                    moves.append((more, "K", to))
            for cost, letter, to in moves:
                c, s = rest(i + 1, to, 0)
                found.append((c + cost, letter + s))
        return min(found, default=(10**9, ""))

    return rest(0, "z", 0)


def forward(rows, depth=False):
    letters, roles = [], []
    repair = turns.Repair(lambda letter, row, role: (letters.append(letter), roles.append(role and role[:1])))
    most = 0
    for initial, fault in rows:
        repair.row((initial, ""), initial, fault)
        if depth:
            most = max(most, *(sum(1 for _ in iter(lambda at=[n]: at.__setitem__(0, at[0].parent) or at[0], None)) for _, n, _ in repair.survivors.values()))
    cost = repair.close()
    assert re.fullmatch("(s?(ua)+)?", "".join(r for r in roles if r))
    return (cost, "".join(letters)), most


def test_search_against_tails():
    random.seed(5)
    for k in range(4000):
        weights = random.choice([(8, 1, 1, 1), (1, 1, 1, 1), (1, 5, 1, 1), (2, 1, 1, 6)])
        rows = tuple((random.choice("suuaaax"), random.choices(range(4), weights)[0]) for _ in range(random.randint(0, 14)))
        assert forward(rows)[0] == cheapest(rows), rows


def test_memory_holds_undecided_rows_only():
    random.seed(6)
    for roles in ("ua", "uuaasx", "uuua"):
        rows = [(random.choice(roles), random.choice((0, 0, 3, 1))) for _ in range(4000)]
        assert forward(rows, True)[1] < 80, roles
    assert forward([("u", 1)] * 4000, True)[1] < 10 and forward([("u", 0), ("a", 3)] * 2000, True)[1] < 10


def test_a_choice_that_stays_open():
    for n in (8, 9, 150, 151):
        for roles in ("u", "a", "s", "x"):
            rows = tuple((random.choice(roles), random.choice((0, 0, 3, 1))) for _ in range(n))
            assert forward(rows)[0] == cheapest(rows)
    assert forward([("u", 0)] * 200_000)[0][0] == 200_000


def plain_report(rows):
    own = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = own.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in own.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [r[1][:1] for r in kept]
        numbers = {r[0] for r in kept} - {None}
        cost, audit = cheapest(tuple(zip(initials, faults, strict=True)))
        at, state, made = 0, "", []
        for x in audit:
            if x == "D":
                at += 1
                continue
            role = kept[at][1] if x == "K" else "assistant" if state == "u" else "user"
            made.append(f"{role}:{'' if x == 'I' else kept[at][2]}")
            state, at = role[:1], at + (x != "I")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_turn_repair"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_report(rows)


def odd():
    random.seed(7)
    texts = [None, "", " \t\r\n\x0b", "Yes.", "no", "a.\nb", "Ends! \n", " ", "é?", "x" * 50_000, "wide ."]
    rows = [(c, t, random.choice(["user", "assistant", "system", None, "", "tool", "Überuser"]), random.choice(texts)) for c in [None, -3, 0, 7, 2**62, *range(20, 60)] for t in [None, None, -5, 0, 1, 1, 2, 9] if random.random() < 0.8]
    return rows + rows[:9]


def test_odd_rows(spark):
    rows = odd()
    data = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, gone int, Fault string")
    got = turns.repair_report(turns.damaged(data.select("conv_id", "turn", "role", "text", "gone", "Fault")))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_report(rows)
    assert turns.repair_report(turns.damaged(data.limit(0))).count() == 0


def test_repaired_rows(spark):
    rows = odd()
    data = turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = {}
    for r in turns.repaired(data).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(r)
    for r in turns.repair_report(data).collect():
        own = made.get(r.conv_id, [])
        assert "".join(x.edit for x in own) == r.audit
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own if x.edit != "D").encode()).hexdigest() == r.repaired_sha256
        assert all(x.turn is None and x.text == "" for x in own if x.edit == "I")
