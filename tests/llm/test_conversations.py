import random
from datetime import datetime, timedelta

from lectern.llm import conversations as c

SCHEMA = "id long, session_id string, uuid string, role string, content string, timestamp string, n long, part int"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def sessions(spark, names):
    return spark.createDataFrame([(n, "x") for n in names], "session_id string, keep string")


def dropped(spark, rows, names=()):
    return {r[0] for r in c.dropped_sessions(messages(spark, rows), sessions(spark, names)).collect()}


def turn(i, s, role, content="text", ts="2024-01-01T00:00:00Z", uuid=None):
    return (i, s, uuid, role, content, ts)


def test_each_rule(spark):
    rows = [
        turn(1, "good", "user"), turn(2, "good", " AI\n"), turn(3, "good", "assistant"),
        turn(10, "opens", "assistant"), turn(11, "opens", "user"), turn(12, "opens", "assistant"),
        turn(20, "open question", "human"), turn(21, "open question", "tool_result"),
        turn(30, "two users", "user"), turn(31, "two users", "user"), turn(32, "two users", "ai"),
        turn(40, "blank reply", "user"), turn(41, "blank reply", "assistant", " \t\r\n"),
        turn(50, "no time", "user", ts="pending"), turn(51, "no time", "assistant"),
        turn(60, "others", "system"), turn(61, "others", None),
        turn(70, None, "user"),
        turn(80, "bad time of others", "user"), turn(81, "bad time of others", "assistant"), turn(82, "bad time of others", "system", ts=None),
        turn(90, "zones", "assistant", ts="2024-01-01T02:00:01+02:00"), turn(91, "zones", "user", ts="2024-01-01 00:00:00"),
    ]
    assert dropped(spark, rows, ["empty", None, "good"]) == {"opens", "open question", "two users", "blank reply", "no time", "others", "empty"}


def test_redelivered_and_repeated_rows(spark):
    rows = [turn(1, "s", "user", uuid="u"), turn(9, "s", "user", uuid="u", ts="2024-01-01T00:00:05Z"), turn(2, "s", "ai", uuid=""), turn(2, "s", "ai", uuid=""), turn(1, "s", "user", uuid="u"), turn(3, "t", "user", uuid="u"), turn(4, "t", "ai")]
    assert dropped(spark, rows) == set()


def test_empty(spark):
    assert dropped(spark, []) == set()
    assert c.conversations(messages(spark, [])).count() == 0


def reference(rows):
    out = {}
    for s in {r[1] for r in rows if r[1] is not None}:
        first = {}
        for r in sorted(rows, key=lambda r: r[0]):
            if r[1] == s:
                first.setdefault(("u", r[2]) if r[2] else ("i", r[0]), r)
        mine = [r for r in first.values() if r[3] in ("user", "assistant") and (r[4] or "").strip(" \t\r\n")]
        mine.sort(key=lambda r: (r[5], r[0]))
        ok = bool(mine) and mine[0][3] == "user" and all(b[3] == "assistant" for a, b in zip(mine, mine[1:] + [turn(0, s, "none")]) if a[3] == "user")
        if ok:
            out[s] = [r[0] for r in mine]
    return out


def test_random_sessions_and_a_hot_one(spark):
    rnd = random.Random(7)
    rows, base = [], datetime(2024, 1, 1)
    for i in range(900):
        s = "hot" if i % 3 == 0 else f"s{rnd.randrange(120)}"
        role = ("user", "assistant")[(i // 3) % 2] if s == "hot" else rnd.choice(["user", "assistant", "assistant", "system"])
        rows.append(turn(i, s, role, rnd.choice(["a", "b", "c", "  "]) if s != "hot" else "x", (base + timedelta(seconds=i)).isoformat() + "Z", f"u{rnd.randrange(2000)}" if s != "hot" else None))
    want = reference(rows)
    every = {r[1] for r in rows}
    assert dropped(spark, rows) == every - set(want)
    got = {}
    for r in c.conversations(messages(spark, rows)).orderBy("session_id", "turn").collect():
        got.setdefault(r["session_id"], []).append(r["id"])
        assert r["turn"] == len(got[r["session_id"]])
    assert got == want and "hot" in got
