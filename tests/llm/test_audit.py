import itertools
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwork.llm import audit, queries, sql

from ..conftest import SF

COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_swaps_lead_through_all_orders():
    for n in range(6):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for k in audit.plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def by_hand(rows, names):
    """rows: (mask letters, good, toxic)"""
    out, total = [], dict.fromkeys(names, 0)
    for order in itertools.permutations(names):
        left = rows
        for k, f in enumerate(order):
            gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
            total[f] += len(gone)
            out.append(["".join(order), k + 1, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f])
    return sorted((*r[:-1], total[r[-1]]) for r in out)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.booleans(), st.booleans()), max_size=40))
def test_diagrams_equal_running_each_order(rows):
    counts: dict = {}
    for m, g, t in rows:
        n = counts.get(m, (0, 0, 0))
        counts[m] = (n[0] + 1, n[1] + g, n[2] + t)
    spelled = [("".join(f for k, f in enumerate("ABCD") if m >> k & 1), g, t) for m, g, t in rows]
    if rows:
        assert sorted(audit.order_steps(counts, "ABCD")) == by_hand(spelled, "ABCD")


def failing(rows, labels):
    first: dict = {}
    for i, s, _ in rows:
        if i is not None:
            first[s or ""] = min(first.get(s or "", i), i)
    out: dict = {}
    for i, s, part in rows:
        s = s or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", s)
        m = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", s)) > 2 * len(s)) + "D" * bool(re.search("[#$%&*|]", s))
        m += "E" * (i is not None and first[s] < i)
        mine = [x for x in labels if x[0] == i and i is not None]
        out.setdefault(part or "", []).append((m, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    return out


def brute(rows, labels):
    return sorted((part, *r) for part, mine in failing(rows, labels).items() for r in by_hand(mine, "ABCDE"))


def test_query_equals_brute_force_and_sql(spark):
    got = queries.op12_filter_audit(spark, SF)
    assert got.columns == COLS
    got = sorted(map(tuple, got.collect()))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got == brute(rows, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert sorted(map(tuple, con.execute(sql.AUDIT).df()[COLS].itertuples(index=False, name=None))) == got


@pytest.mark.parametrize("empty", [False, True])
def test_nulls_ties_long_texts_and_clashing_columns(spark, empty):
    rows = [(1, None, None), (2, "", ""), (None, "", "x"), (3, "SHOUT | " * 40_000, "x"), (3, "SHOUT | " * 40_000, "x"), (4, "SHOUT | " * 40_000, "x"), (5, " ".join(map(str, range(300))), "x"), (5, "again", "y"), (6, "again", "y")]
    rows = [] if empty else rows
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, None), (5, None, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit(1), "mask": F.lit("m"), "good": F.lit(0), "digest": F.lit("d"), "first": F.lit(2)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    assert sorted(map(tuple, audit.filter_audit(docs, marks).collect())) == brute(rows, labels)
