"""The pipeline on a small corpus against brute-force versions of its stages."""

import random

import pytest

import corpus_pipeline

from .test_classifiers import SYLLABLES, prose
from .test_dedup import brute_near, brute_repeats

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        x = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, x, rng.randint(40, 120)), x, rng.choice(["s0", "s0", "s1", None])))
    passage = prose(rng, "aa", 200)
    rows += [(200 + i, prose(rng, "aa", 60) + " " + passage + " " + prose(rng, "aa", 60 + 40 * i), "aa", "s0") for i in range(3)]
    rows += [(300, rows[0][1], rows[0][2], "s1"), (301, "12 34", "aa", "s0"), (302, None, None, None)]
    full = [(i, t, x, s, len(t or "")) for i, t, x, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    stage = [f for _, f in corpus_pipeline.STAGES]

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = keep(stage[0](spark, docs, str(tmp_path)), "one")
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r[0] for r in rows} - {301, 302}
    two = keep(stage[1](spark, one, str(tmp_path)), "two")
    expected = brute_near([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id for r in two.collect()} == {i for i, x in expected.items() if x[2]}
    three = keep(stage[2](spark, two, str(tmp_path)), "three")
    before = two.orderBy("doc_id").collect()
    cut = brute_repeats([r.text.encode() for r in before])
    after = three.orderBy("doc_id").collect()
    assert [len(r.text.encode()) for r in after] == [n - gone for n, gone, _, _ in cut] and sum(c[1] for c in cut) > 0
    assert all(r.n_chars == len(r.text) for r in after)
    four = keep(stage[3](spark, three, str(tmp_path)), "four")
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in after}
    five = stage[4](spark, four, str(tmp_path))
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in after}
    rows5 = five.collect()
    assert len(rows5) == four.count() and all(list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows5)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, rows5))
