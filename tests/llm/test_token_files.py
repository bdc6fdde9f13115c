import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwork.llm import queries, tokenfile

from ..conftest import SF

ROWS = [(3, "b b b " * 3000), (1, None), (2, ""), (None, "null id"), (5, "same"), (5, "same"), (5, "other"), (-4, "日本語 text é\x01"), (9, "x <|endoftext|> y"), (8, "long " * 20_000)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfile.default_path())


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("tie", F.lit(1))


def expected(rows):
    t, out, start = library(), [], 0
    for i, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(s or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op13_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(expected([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize("shard_ids", [1 << 20, 700])
def test_nulls_ties_and_long_texts_in_pieces(spark, tmp_path, shard_ids):
    tokenfile.write(frame(spark), str(tmp_path / "t"), shard_ids=shard_ids)
    got = sorted(map(tuple, tokenfile.digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    want = expected(ROWS)
    assert [r[0] for r in got] == [r[0] for r in want] and sorted((r[0] or 0, *r[2:]) for r in got) == sorted((r[0] or 0, *r[2:]) for r in want)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    # a range of ids, decoded to texts again
    some = tokenfile.read(spark, str(tmp_path / "t"), lo=3, hi=5).orderBy("start").collect()
    texts: dict = {}
    for r in some:
        texts.setdefault((r.part, r.row), []).extend(r.ids)
    assert sorted(library().decode(i[:-1]) for i in texts.values()) == sorted(s for i, s in ROWS if i in (3, 5))


def test_ranges_are_pushed_to_the_scan(spark, tmp_path):
    tokenfile.write(frame(spark), str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = tokenfile.read(spark, str(tmp_path / "t"), lo=4, hi=5)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(last_id,4)" in plan and "LessThanOrEqual(first_id,5)" in plan


def test_empty_table(spark, tmp_path):
    assert tokenfile.round_trip(frame(spark).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(2, 6), st.data())
def test_grammar_round_trip_and_random_access(ids, base, data):
    ids = np.array(ids, np.uint32) % base
    s, rules, lengths = tokenfile.grammar(ids, base, min_count=2, least_gain=0.0)
    assert (tokenfile.expand(s, rules, base) == ids).all() and len(s) <= len(ids)
    assert all(len(tokenfile.expand(np.array([base + k]), rules, base)) == n for k, n in enumerate(lengths.tolist()))
    row = tokenfile._shard_row(0, 0, 0, ids, [(1, 0, 0, True, 0, len(ids))], base).to_pylist()[0]
    shard = tokenfile.Shard(base, row["rules"], row["lengths"], row["symbols"], row["marks"], row["width"])
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert shard.ids(a, b).tolist() == ids[a:b].tolist()


def test_frequent_pairs_become_rules():
    ids = np.tile(np.array([7, 8, 9, 7, 8, 1], np.uint32), 5000)
    s, rules, lengths = tokenfile.grammar(ids, 100)
    assert len(s) < len(ids) / 20 and lengths.max() >= 24 and (tokenfile.expand(s, rules, 100) == ids).all()
    # a hash that puts all pairs in one bucket still gives a right grammar
    row = tokenfile._shard_row(0, 0, 0, ids, [], 100).to_pylist()[0]
    shard = tokenfile.Shard(100, row["rules"], row["lengths"], row["symbols"], row["marks"], row["width"])
    assert shard.ids(12_345, 23_456).tolist() == ids[12_345:23_456].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r'ast-1é.×µ日\x01", max_size=30), min_size=1, max_size=8))
def test_chunks_give_the_library_s_ids(texts):
    enc = tokenfile.encoder(tokenfile.default_path())
    got = [x.tolist() for ids, n in enc.encode(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [enc.inner.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_runs_that_share_a_bucket_are_told_apart(monkeypatch, bits):
    monkeypatch.setattr(tokenfile, "_RUN_BUCKETS", bits)
    words = [b"a", b"b", b"ab", b"a", b"0123456789abcdef", b"0123456789abcdeg", b"0123456789abcdef", b"longer than sixteen bytes", b"ab", b"longer than sixteen bytes", b"longer than sixteen bytez", b"b"]
    for some in (words, [w for w in words if len(w) <= 16], words[7:8]):
        stops = np.cumsum([len(w) for w in some])
        got = tokenfile._alike(np.frombuffer(b"".join(some), np.uint8), stops - [len(w) for w in some], stops)
        assert sorted(set(got.tolist())) == list(range(len(set(some)))) and len(set(zip(some, got.tolist(), strict=True))) == len(set(some))
