import hashlib
import itertools
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwork.llm import convfix, queries, sql

from ..conftest import SF

S = " \t\n\v\f\r"


def forward_only(rows, entry, exits):
    """Cheapest (cost, audit) row by row, least strings by comparing all."""
    best = {entry: (0, "")}

    def inserted(b):
        for _ in range(3):
            for q, (c, a) in list(b.items()):
                for to in ([2] if q != 2 else [3]):
                    b[to] = min(b.get(to, (99**9, "")), (c + 3, a + "I"))
        return b

    best = inserted(best)
    for x in rows:
        nxt = {}
        for q, (c, a) in best.items():
            ways = [(q, 4, "D")]
            if x != "d":
                more, keep = 3 * x.isupper(), {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(x.lower(), {})
                if q in keep:
                    ways.append((keep[q], more, "K"))
                ways.append((3 if q == 2 else 2, 3 + more, "R"))
            for to, cost, letter in ways:
                nxt[to] = min(nxt.get(to, (99**9, "")), (c + cost, a + letter))
        best = inserted(nxt)
    got = [best[x] for x in exits if x in best]
    return min(got) if got else None


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="uasxdUASX", max_size=12), st.integers(0, 3), st.sampled_from([(0, 3), (0,), (1,), (2,), (3,)]))
def test_both_searches_meet_at_the_cheapest_and_least(rows, entry, exits):
    assert convfix.cheapest(rows, entry, exits) == forward_only(rows, entry, exits)


def test_every_audit_of_short_conversations():
    """All edit strings up to two more letters than rows, by brute force."""
    for n in range(4):
        for rows in itertools.product("uasUd", repeat=n):
            found = []
            for m in range(n, n + 3):
                for audit in itertools.product("DIKR", repeat=m):
                    cost, i, out, ok = 0, 0, "", True
                    for letter in audit:
                        if letter != "I" and i >= n:
                            ok = False
                            break
                        x = rows[i] if letter != "I" else ""
                        i += letter != "I"
                        if letter == "D":
                            cost += 4
                        elif x == "d":
                            ok = False
                            break
                        else:
                            out += x.lower() if letter == "K" else "a" if out.endswith("u") else "u"
                            cost += 3 * (letter != "K") + 3 * (x.isupper() if x else 0)
                    if ok and i == n and re.fullmatch("(s?(ua)+)?", out):
                        found.append((cost, "".join(audit)))
            assert convfix.cheapest("".join(rows), 0, (0, 3)) == min(found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="uasxdUAX", min_size=1, max_size=4), min_size=1, max_size=5))
def test_tables_of_segments_multiply(parts):
    def table(k, rows):
        return [{"entry": e, "exit": x, "cost": g[0], "audit": g[1], "cuts": [{"seg": k, "at": 0, "entry": e}]} for e in (range(4) if k else (0,)) for x in range(4) if (g := convfix.cheapest(rows, e, (x,)))]

    t = table(0, parts[0])
    for k, rows in enumerate(parts[1:], 1):
        t = convfix.joined_tables(t, table(k, rows))
    assert min((w["cost"], w["audit"]) for w in t if w["exit"] in (0, 3)) == convfix.cheapest("".join(parts), 0, (0, 3))


def brute(rows):
    """conv_id -> result, from (conv_id, turn, role, text)."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = convs.setdefault(conv, [])
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        if harm:
            mine += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in mine if t is not None}
        seen, letters, count = set(), "", [0, 0, 0]
        for _, role, text in mine:
            end = text.strip(S)[-1:]
            if not end:
                count[0], letters = count[0] + 1, letters + "d"
            elif (role, text) in seen:
                count[1], letters = count[1] + 1, letters + "d"
            else:
                count[2] += end not in ".!?"
                x = role[:1] if role[:1] in ("u", "a", "s") else "x"
                letters += x.upper() if end not in ".!?" else x
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = forward_only(letters, 0, (0, 3))
        lines, last, i = [], "", 0
        for letter in audit:
            if letter == "K":
                lines.append(f"{mine[i][1]}:{mine[i][2]}")
                last = mine[i][1][:1]
            elif letter != "D":
                last = "a" if last == "u" else "u"
                lines.append({"a": "assistant:", "u": "user:"}[last] + (mine[i][2] if letter == "R" else ""))
            i += letter != "I"
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


DDL = "conv_id long, turn long, role string, text string"


def check(spark, rows):
    frame = spark.createDataFrame(rows, DDL).withColumn("seg", F.lit("clash")).withColumn("tie", F.lit(1))
    got = convfix.report(frame).collect()
    assert len(got) == len({r[0] for r in rows})
    want = brute(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == brute(rows)


def test_sql_equals_brute_force():
    """The SQL on the given table, and on nulls, odd roles, gaps and dropped rows."""
    rows = [(None, 1, "user", "A."), (None, None, None, None), (7, None, "assistant", "x!"), (7, 5, "", "no role."), (7, -5, "tool", "t.")] + [(k, t, "user" if t % 3 else "system", "" if k % 3 else f"q{t % 2}?") for k in range(100, 140) for t in range(k % 4 + 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    for source in (None, f"{SF}/conversations.parquet"):
        if source:
            con.execute(f"CREATE OR REPLACE TABLE conversations AS SELECT conv_id, turn, role, text FROM read_parquet('{source}')")
            rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
        got = con.execute(sql.ORACLES["op11_conversation_repair"]).fetchall()
        assert {r[0]: r[1:] for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_nulls_ties_gaps_and_odd_roles(spark):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (None, 1, "user", "A."), (None, 1, "assistant", None), (7, None, "assistant", "x!"), (7, None, "user", "y?"), (7, 5, "", "no role."), (7, -5, "tool", "t.")]
    rows += [(8, t, r, f"{r} {t}.") for t in (0, 4, 9) for r in ("system", "user", "assistant", "User")] + [(9, 3, "user", "long. " * 50_000), (9, 4, "assistant", "é日." * 1000)]
    rows += [(k, t, "user", "") for k in range(100, 130) for t in range(2)]
    check(spark, rows)


@pytest.mark.parametrize("segment", [3, 256])
def test_long_conversations_go_on_in_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(convfix, "SEGMENT", segment)
    monkeypatch.setattr(convfix, "FAN", 3)
    rows = [(1, t, ("user", "assistant", "system", "user")[t * t % 7 % 4], f"row {t % 23}{'.' if t % 5 else ''}" * (t % 6 > 0)) for t in range(150)]
    rows += [(2, t // 4, ("user", "assistant")[t % 2], f"{t % 9}?") for t in range(40)] + [(3, 0, "system", "s."), (4, 2, "user", "u!")]
    rows += [(5, 1, "user", "same.")] * 60
    check(spark, rows)
    texts = convfix.repaired_rows(spark.createDataFrame(rows, DDL)).filter("conv_id = 1").orderBy("seg", "place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in texts))


def test_empty_table(spark):
    assert convfix.report(spark.createDataFrame([], DDL)).count() == 0
