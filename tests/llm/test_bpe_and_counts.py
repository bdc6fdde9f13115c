import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillwork.llm import bpe, wordpiece

from ..conftest import SF


def library():
    whole = Tokenizer.from_file(bpe.default_path())
    whole.no_truncation(), whole.no_padding()
    return whole


@pytest.mark.parametrize("leaf", [4, 7, 64])
def test_tree_encoding_equals_the_library(leaf):
    rng, enc, whole = random.Random(leaf), bpe.TreeEncoder(bpe.default_path(), leaf, 8), library()
    kinds = ["abcdeinthsr'st re ve 12,.!́é漢ß İ\n\t🎉#", "aeinthorsdu", "'''sretlvdm  a,", "ab \n"]
    for k in range(400):
        text = "".join(rng.choice(kinds[k % 4]) for _ in range(rng.randint(0, 300)))
        if k % 7 == 0:
            text = text[:50] + "<|endoftext|>" + text[50:]
        ids = enc.encode_batch([text])[0]
        want = whole.encode(text, add_special_tokens=False).ids
        assert list(ids) == want
        assert enc.decode_batch([ids]) == [whole.decode(want, skip_special_tokens=False)]


def test_long_unsplit_texts():
    enc, whole, rng = bpe.TreeEncoder(bpe.default_path(), 512), library(), random.Random(1)
    mixed = "".join(rng.choice("abcdeé漢🎉'1. ") for _ in range(30_000))
    for text in ("a" * 20_000, "the" * 9_000, " " * 5_000, "!" * 9_000, "'re" * 4_000, "é" * 7_000, "漢字" * 5_000, "🎉" * 5_000, mixed, mixed.replace(" ", ""), ("a" + " " * 700) * 40):
        assert list(enc.encode_batch([text])[0]) == whole.encode(text, add_special_tokens=False).ids


def test_joins_encode_only_windows_again():
    enc, rng = bpe.TreeEncoder(bpe.default_path()), random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    assert list(enc.encode_batch([text])[0]) == library().encode(text, add_special_tokens=False).ids
    assert enc.re_encoded < 0.1 * len(text)


def test_operator_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello wörld <|endoftext|>", "x"), (3, "Hello wörld <|endoftext|>", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_decode(d).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[0].decoded == "" and got[2] == got[3] and 49407 in got[2].ids
    dig = bpe.encode_decode(d, digests=True).where("doc_id = 1").collect()[0]
    assert dig.ids_sha256 == hashlib.sha256(b"").hexdigest() == dig.decoded_sha256
    assert bpe.encode_decode(d.limit(0)).count() == 0


def greedy(word: bytes, pieces: set[bytes], most: int) -> int:
    n = i = 0
    while i < len(word):
        i += next(k for k in range(min(most, len(word) - i), 0, -1) if word[i : i + k] in pieces)
        n += 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    small = [b"a", b"b", b"c", b"ab", b"abcab", b"bca", b"cabc", b"bb", b"abcabca", b" a", b" "]
    auto = wordpiece.LongestMatch(small)
    for _ in range(3000):
        w = b" " + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        assert auto.count(w) == greedy(w, set(small), 7)
    with pytest.raises(ValueError):
        auto.count(b"abz")
    auto, _ = wordpiece.automaton(wordpiece.default_path())
    vocab = set(wordpiece.vocabulary(wordpiece.default_path()))
    for _ in range(500):
        w = b" " + "".join(rng.choice("the aeinors0123é!#") for _ in range(rng.randint(1, 60))).encode()
        assert auto.count(w) == greedy(w, vocab, 130)


def test_counts_on_the_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d = d.select("doc_id", "text", F.lit(1).alias("n_tokens")).unionByName(spark.createDataFrame([(-1, None, 0), (-2, " \n ", 0), (-3, "x" * 100_000, 0)], "doc_id long, text string, n_tokens int"))
    got = {r.doc_id: r for r in wordpiece.token_counts(d).collect()}
    vocab = set(wordpiece.vocabulary(wordpiece.default_path()))
    assert got[-1].n_tokens == got[-2].n_tokens == got[-2].n_words == 0
    assert got[-3].n_tokens == greedy(b" " + b"x" * 100_000, vocab, 130)
    for r in d.where("doc_id >= 0").limit(40).collect():
        words = [w for w in r.text.encode().split()]
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(words), sum(greedy(b" " + w, vocab, 130) for w in words))
