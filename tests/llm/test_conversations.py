"""Conversation repair against a plain search over whole audits."""

import hashlib
import random
import zlib

import pytest

from scopeloom.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, own string, pos int, n long"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Least (cost, audit) for every final role string's state, row by row, with whole audits kept."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = {r[1] for r in rows if r[1] is not None}
    seen, faults = set(), []
    for _, _, role, text in rows:
        kept = text.rstrip(SPACE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(rows, rows[1:])]
    states = {"": (0, "", [])}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(found):
        for _ in range(3):
            for s, (cost, audit, kept) in list(found.items()):
                t = follow[s]
                new = (cost + 3, audit + "I", kept + [(full[t], "")])
                if t not in found or new[:2] < found[t][:2]:
                    found[t] = new
        return found

    for (_, _, role, text), fault in zip(rows, faults):
        out = {}

        def offer(s, way):
            if s not in out or way[:2] < out[s][:2]:
                out[s] = way

        for s, (cost, audit, kept) in inserted(dict(states)).items():
            offer(s, (cost + 4, audit + "D", kept))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] == follow[s] or s == "" and role[:1] == "s":
                    offer(role[:1], (cost + more, audit + "K", kept + [(role, text)]))
                offer(follow[s], (cost + 3 + more, audit + "R", kept + [(full[follow[s]], text)]))
        # inserts before the row may also pass through a state that is not the best so far: keep both
        for s, (cost, audit, kept) in states.items():
            for n in range(3):
                t, more_kept, a, c = s, list(kept), audit, cost
                for _ in range(n):
                    t = follow[t]
                    more_kept.append((full[t], ""))
                    a, c = a + "I", c + 3
                offer(t, (c + 4, a + "D", more_kept))
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    if role[:1] == follow[t] or t == "" and role[:1] == "s":
                        offer(role[:1], (c + more, a + "K", more_kept + [(role, text)]))
                    offer(follow[t], (c + 3 + more, a + "R", more_kept + [(full[follow[t]], text)]))
        states = out
    ends = []
    for s, (cost, audit, kept) in states.items():
        for _ in range({"": 0, "s": 2, "u": 1, "a": 0}[s]):
            s = follow[s]
            cost, audit, kept = cost + 3, audit + "I", kept + [(full[s], "")]
        ends.append((cost, audit, kept))
    cost, audit, kept = min(ends, key=lambda x: x[:2])
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def awkward(seed=3, convs=150, long=700):
    rng = random.Random(seed)
    said = ["Yes.", "no", "", " \t", "Why?", "a. b! c?", "tail.  \n", None, "Ünï.", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "a"]
    rows = []
    for conv in range(convs):
        n = rng.choice([1, 2, 3, 5, 8, 13]) if conv else long
        for t in range(n):
            role = ["user", "assistant"][t % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = f"{rng.choice(said[:7])}{rng.randrange(9)}." if rng.random() < 0.5 else rng.choice(said)
            rows.append((conv, rng.choice([t, t, t, t + 3, None]) if conv % 3 == 0 else t, role, text))
    rows += rows[:5] + [(None, 0, "user", "a."), (None, None, "assistant", "b"), (None, 1, None, None)]
    # conversations that lose all their rows
    rows += [(c, 0, "user", "gone.") for c in range(5000, 5200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, 1) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_report(spark, rows):
    got = {r.conv_id: r.asDict() for r in C.repair_report(frame(spark, rows)).collect()}
    by = {}
    for r in plain_damage(rows):
        by.setdefault(r[0], []).append(r)
    assert set(got) == {r[0] for r in rows}
    empty = {k: 0 for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    assert sum(c not in by for c in got) > 3
    for conv, r in got.items():
        want = plain_repair(by[conv]) if conv in by else empty
        assert r == {"conv_id": conv} | want, conv


def test_long_conversations_are_cut_into_runs(spark, rows):
    """Blocks of four rows and runs of two: the crossings of several levels give the same edits as one block."""
    own = frame(spark, rows)
    placed = C.ordered(C.damaged(own))

    def edits(block_bits, fan_bits):
        found, costs = C.chosen_edits(C.stored(C.facts(placed, block_bits)), fan_bits)
        return {r.pos: [tuple(e) for e in r.edits] for r in found.collect()}, {r.conv_id: (r.cost, r.illegal) for r in costs.collect()}

    assert edits(2, 1) == edits(12, 10)


def test_rows_of_the_repair(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Why"), (1, 2, "user", "Why"), (1, 3, "assistant", "So.")]
    got = sorted(tuple(r) for r in C.repair_conversations(frame(spark, rows)).select("turn", "part", "edit", "role", "text").collect())
    assert [g[2] for g in got] == list(plain_repair(rows)["audit"])
    assert got[0] == (0, 0, "I", "user", "") or got[0][2] in "DR"


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(none).count() == 0
    assert C.repair_conversations(none).count() == 0


def test_crossings_hold_the_least_audit():
    rng = random.Random(1)
    for _ in range(300):
        kinds = [(rng.randrange(4), rng.randrange(3)) for _ in range(rng.randint(1, 9))]
        tables = [C.ROW[i][f] for i, f in kinds]
        cost, last = C._best_end(C.forward(tables, C.START))
        states = [C.START, *C.crossings(tables, C.START, last)]
        audit = "".join(t[a][b][1] for t, a, b in zip(tables, states, states[1:], strict=False)) + C.TAIL[last]
        best = {C.START: (0, "")}
        for t in tables:
            ways = {}
            for a, (c, s) in best.items():
                for b, w in enumerate(t[a]):
                    if w is not None and (b not in ways or (c + w[0], s + w[1]) < ways[b]):
                        ways[b] = (c + w[0], s + w[1])
            best = ways
        assert (cost, audit) == min((c + 3 * len(C.TAIL[s]), x + C.TAIL[s]) for s, (c, x) in best.items())
