import random

from pyspark.sql import functions as F

from rillwork.functions import names
from rillwork.operators import name_index, registers

WORDS = ["kutelabhata", "kutelabhatha", "durg", "durga", "durgapur", "rampur", "ramapura", "a", "ab", "", None, "nagpur", "nagpurr", "xyz", "kutel"]


def brute(names_, queries, least):
    def grams(w):
        p = f"  {w} "
        return {p[i : i + 3] for i in range(len(p) - 2)} if w else set()

    out = set()
    for q, a in queries:
        for i, b in names_:
            x, y = grams(a), grams(b)
            if x and y and len(x & y) / len(x | y) >= least:
                out.add((q, i, round(len(x & y) / len(x | y), 9)))
    return out


def test_index_finds_all_that_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    made = ["".join(rng.choice("abrmk") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    register = list(enumerate(WORDS + made))
    frame = spark.createDataFrame(register, "id long, folded string")
    name_index.append(frame.where("id % 2 = 0"), str(tmp_path / "i"))
    name_index.append(frame.where("id % 2 = 1"), str(tmp_path / "i"))
    queries = [(k, w) for k, w in enumerate(WORDS + made[::3] + ["kutelabata", "durgapura", "nothing like it"])]
    q = spark.createDataFrame(queries, "query_id long, folded string")
    for least in (0.3, 0.55, 1.0):
        got = {(r.query_id, r.id, round(r.sim, 9)) for r in name_index.search(spark, str(tmp_path / "i"), q, least).collect()}
        assert got == brute(register, queries, least)
    name_index.merged(spark, str(tmp_path / "i"), str(tmp_path / "m"))
    rows = lambda p: sorted(map(tuple, name_index.search(spark, str(tmp_path / p), q).collect()))
    assert rows("m") == rows("i") and len([p for p in (tmp_path / "m" / "postings").iterdir() if p.name.startswith("segment=")]) == 1
    # as the join of names finds them
    left, right = q.select(F.col("query_id").alias("l_id"), F.col("folded").alias("l_name")), frame.select(F.col("id").alias("r_id"), F.col("folded").alias("r_name"))
    assert rows("i") == sorted(map(tuple, registers.fuzzy_pairs(left, right).collect()))


def test_a_search_reads_its_grams_buckets_only(spark, tmp_path):
    name_index.append(spark.createDataFrame([(k, f"name{k:03d}") for k in range(200)], "id long, folded string"), str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "zq")], "query_id long, folded string")
    used = {r.b for r in q.select(F.explode(names.trigrams(F.col("folded"))).alias("g")).select(name_index._bucket(F.col("g"), name_index.BUCKETS).alias("b")).collect()}
    found = name_index.search(spark, str(tmp_path / "i"), q)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and 0 < len(used) <= 3
