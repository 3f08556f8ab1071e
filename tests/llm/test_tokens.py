"""Token counts and BPE against the library."""

import hashlib
import random

import numpy as np
import pytest

from kmerloom.llm import bpe, token_counts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

POOL = "abcdefgHIJ    \n\t\r'sStTrveml dD0123٣½éÉßİΣσς中日\U0001f600́\u0085  ​\x1c\x00…“|<>#$"


def texts(n=400, seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, None, "", "   ", "x" * 5000, "the " * 3000, "<|endoftext|>", "a<|endoftext|><|startoftext|>b", "Ångström ﬁ"]


def test_counts_equal_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = list(enumerate(texts()))
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024), repr(t)


def test_counts_of_nothing_and_of_equal_rows(spark):
    path = P.path("byte_bpe_50k.json")
    schema = "doc_id long, text string, pieces string, block int"
    assert token_counts.token_counts(spark.createDataFrame([], schema), path).collect() == []
    rows = spark.createDataFrame([(1, "same text", None, 1), (1, "same text", None, 1), (None, None, None, 2)], schema)
    got = sorted(map(tuple, token_counts.token_counts(rows, path).collect()), key=str)
    assert got == sorted([(1, 9, 2, False)] * 2 + [(None, 0, 0, False)], key=str)


def test_more_shuffle_partitions_mean_more_buckets_and_the_same_counts(spark):
    path, key = P.path("byte_bpe_50k.json"), "spark.sql.shuffle.partitions"
    assert [token_counts.bucket_count(n) for n in (1, 128, 129, 20000)] == [512, 512, 516, 80000]
    rows = spark.createDataFrame(list(enumerate(texts(100, 3))), "doc_id long, text string").repartition(3)
    before, few = spark.conf.get(key), sorted(map(tuple, token_counts.token_counts(rows, path).collect()))
    try:
        spark.conf.set(key, "150")
        assert sorted(map(tuple, token_counts.token_counts(rows, path).collect())) == few
    finally:
        spark.conf.set(key, before)


def test_packing_round_trips():
    rows = [(np.array([0, 3, 9]), np.array([1, 2, 1])), (np.array([], int), np.array([], int)), (np.array([2]), np.array([70000]))]
    counts, places, n = token_counts.unpack_rows(token_counts.pack_rows(rows))
    assert counts.tolist() == [3, 0, 1] and places.tolist() == [0, 3, 9, 2] and n.tolist() == [1, 2, 1, 70000]
    at, words = token_counts.unpack_words(token_counts.pack_words([4, 1], ["\né", ""]))
    assert at.tolist() == [4, 1] and words == ["\né", ""]


def test_encoding_and_decoding_equal_the_library(spark):
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = list(enumerate(texts(seed=7)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    digests = {r.doc_id: tuple(r)[1:] for r in bpe.encode_digests(df, path).collect()}
    full = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in bpe.encode_documents(df, path).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert full[i] == (len(ids), ids, decoded), repr(t)
        assert digests[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 10)
    coder = bpe.HeapBPE(P.path("word_bpe_49k.json"))
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ord" for i in range(200))
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(coder.known) <= 11 and len(coder.older) <= 11
