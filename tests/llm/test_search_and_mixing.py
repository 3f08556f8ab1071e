"""Exact search and mixing against brute force."""

import math
import random

import pytest

from kmerloom.llm import mixing, topk


def brute_top(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(256 * x) for x in v]
    out = []
    for q in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force_with_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    rows += [(400, [0.5] * 16), (401, [0.5] * 16), (402, [0.5] * 16), (450, None), (500, [float("nan")] * 16), (501, [None] * 16), (550, [1.0, 2.0]), (551, [1.0, -2.0]), (600, []), (None, [0.1] * 16), (650, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    import numpy as np

    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == brute_top(as_float)


def test_top_k_with_few_candidates_and_none(spark):
    schema = "vec_id long, embedding array<float>, extra string"
    assert topk.top_k(spark.createDataFrame([], schema)).collect() == []
    assert topk.top_k(spark.createDataFrame([(0, [1.0], "x")], schema)).collect() == []
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0], "x"), (7, [2.0], "y")], schema)).collect()]
    assert got == [(0, 1, 7, 256 * 512)]


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Resharing by weight, round after round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while free and left > 1e-9:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if target[s] + share * w[s] > most * sizes[s]}
        for s in free:
            target[s] += share * w[s]
        left = 0.0
        for s in over:
            left += target[s] - most * sizes[s]
            target[s] = float(most * sizes[s])
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 500, None: 30}, {"a": 5}, {"b": 0, "a": 0}, {"x": 7, "y": 7, "z": 7, "é": 7, "Z": 100}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def corpus(spark, rng, n=3000):
    rows = [(i, "word " * rng.randint(0, 60), rng.choice(["a", "a", "b", "c", None])) for i in range(n)] + [(n, None, "a"), (n + 1, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    docs = corpus(spark, random.Random(1))
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 3002 and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(docs.repartition(3)).collect()))
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    for own in set(source.values()):
        mine = [r for r in rows if source[r.doc_id] == own]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.1)


def test_mix_emits_the_copies_with_the_columns_of_the_input(spark):
    docs = corpus(spark, random.Random(2), 200).selectExpr("*", "7 AS size", "'k' AS target")
    copies = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_many_sources_take_the_salted_way(spark, monkeypatch):
    docs = corpus(spark, random.Random(3), 300)
    plain = sorted(map(tuple, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == plain


def test_query_rows_with_one_id_ask_once(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (7, [1.0, 1.0]), (8, [0.5, 3.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 65536), (0, 2, 8, 32768)]


def test_top_k_sends_no_block_through_the_driver(spark):
    rng = random.Random(4)
    df = topk.top_k(spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<double>"))
    assert len(df.collect()) == 30
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_mixing_repeated_rows_and_a_long_text(spark):
    rows = [(1, "w " * 50_000, "a")] * 2 + [(2, "b c", "b")] * 3 + [(3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r["size"] for r in got)
    assert len({(r.doc_id, r.taken) for r in got}) == 3
