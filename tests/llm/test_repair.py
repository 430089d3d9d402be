"""Conversation repair against a plain shortest path."""

import random

import pytest

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string, present string, seq long, turns long, c long"
REAL = "/root/testdata/sf0.001"


def turns(rng, n):
    from gleaner.llm.repair import BLANK, CUT, DUPLICATE, OKAY, Turn
    return [Turn(rng.choice(["user", "assistant", "system", "tool", "", "user"]), str(i),
                 rng.choice([OKAY, OKAY, OKAY, BLANK, DUPLICATE, CUT])) for i in range(n)]


def test_search_finds_the_cheapest_edits():
    from gleaner.llm.repair import repaired, search
    rng = random.Random(5)
    names = {0: None, 1: "blank", 2: "duplicate", 3: "truncated"}
    for _ in range(600):
        now = turns(rng, rng.randint(0, 9))
        cost, letters, lines = brute.cheapest_repair([(t.role, t.text, names[t.fault]) for t in now])
        assert search(now) == (cost, letters), now
        assert repaired(now, letters)[0] == list(lines)


def test_estimates_are_never_too_high():
    from gleaner.llm.repair import estimates, search
    rng = random.Random(6)
    for _ in range(300):
        now = turns(rng, rng.randint(0, 8))
        low = estimates(now, None)
        for at in range(len(now)):
            assert low[at] <= min(search(now[at:], q)[0] for q in range(4)), now


def conversations():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant"]) if turn else rng.choice(["system", "user"])
            text = rng.choice(["Yes.", "No!", "So it goes", " ", "", None, "Why?\n", "x ", "é　."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None, 2]), rng.choice([role, role, None, "tool", ""]), text))
    rows += [rows[5]] * 3 + [(70, None, None, None), (71, 5, "user", "Hm.")]
    rows += [(99, i, "ua"[i % 2] if i % 7 else "system", rng.choice(["A.", "B", f"{i}!"])) for i in range(700)]
    rows += [(99, 10, "u", "A.")] * 40
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("longest", [512, 3])
def test_repair_matches_brute_force(spark, longest):
    from gleaner.llm.repair import damaged, repair_conversations
    rows = conversations()
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    got = repair_conversations(damaged(frame), longest)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert result(got) == brute.repair(rows)


def test_repaired_turns_hash_to_the_digest(spark):
    import hashlib

    from gleaner.llm.repair import damaged, repair_conversations, repaired_turns
    frame = damaged(spark.createDataFrame([(*r, "x", 1, 2, 3) for r in conversations()], SCHEMA))
    lines = {}
    for r in sorted(repaired_turns(frame, 5).collect(), key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair_conversations(frame).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_repair_of_the_table_and_of_nothing(spark):
    from gleaner.llm.queries import QUERIES
    from gleaner.llm.repair import repair_conversations
    table = spark.read.parquet(f"{REAL}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op13_conversation_repair"](spark, REAL)) == brute.repair(rows)
    for longest in (512, 0):
        assert repair_conversations(table.where("false"), longest).count() == 0
