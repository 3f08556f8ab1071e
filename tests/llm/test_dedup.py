"""Near duplicates and repeated strings against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from kmerloom.llm import components, minhash, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_near(rows):
    """Expected (n_shingles, component, kept) by id."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}


def family(rng, copies, words=150):
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(60)) for _ in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(words)] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [t for _ in range(6) for t in family(rng, 12)]
    texts += [texts[0], texts[0].upper(), None, "", " \n\t", "one two", "One  Two", "a b c d", "a b c d e", "x " * 3000, "é ü ñ", "É ü ñ"]
    rows = list(enumerate(texts, start=5))
    assert near(spark, rows) == brute_near(rows)


def test_many_equal_and_near_copies_of_one_text(spark):
    rng = random.Random(3)
    texts = family(rng, 1) * 300 + family(rng, 60, 400)
    rows = list(enumerate(texts))
    assert near(spark, rows) == brute_near(rows)


def test_short_near_copies_equal_brute_force(spark):
    rng = random.Random(17)
    texts = []
    for n in [7] * 120 + [9, 10, 11, 12, 13, 14] * 15:
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        texts += [" ".join(words), " ".join([*words, f"w{rng.randrange(10**9)}"])]
    rows = list(enumerate(texts))
    expected = brute_near(rows)
    assert sum(not kept for _, _, kept in expected.values()) == 210
    assert near(spark, rows) == expected


def test_the_first_look_keeps_small_sets_at_the_share():
    rng = np.random.default_rng(4)
    for common, more in ((3, 1), (6, 2), (9, 3), (15, 5)):
        sets = rng.integers(0, 2**63, (3000, common + more), dtype=np.uint64)
        one, two = (minhash.one_bits(minhash.signatures(x.ravel(), np.full(len(x), x.shape[1]))) for x in (sets, sets[:, :common]))
        assert (one != two).sum(axis=1).max() <= minhash.most_unequal()


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, h1 long")
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.without_near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)], key=str)
    assert sorted((r.doc_id for r in minhash.without_near_duplicates(rows).collect()), key=str) == [4, None]


def test_one_id_with_several_texts(spark):
    """They are one document: linked with the links of each, and each text stays once."""
    t = [f"{x} " + " ".join(f"{x}{i}" for i in range(30)) for x in "abcd"]
    rows = [(1, t[0], "s"), (5, t[1], "s"), (5, t[2], "s"), (5, t[3], "s"), (5, t[1], "r"), (7, t[2] + " more", "s"), (9, t[3], "s"), (11, t[0] + " x", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `s.t` string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df.drop("s.t")).collect()}
    assert got == {1: 1, 5: 5, 7: 5, 9: 5, 11: 1}
    for _ in range(2):
        kept = sorted((r.doc_id, r.text) for r in minhash.without_near_duplicates(df).collect())
        assert kept == sorted([(1, t[0]), (5, t[1]), (5, t[2]), (5, t[3])])


@pytest.mark.parametrize("effort", [0, 1, 100])
def test_waves_do_not_change_the_result(spark, monkeypatch, effort):
    """A passage that all texts share fills buckets with unlike members."""
    monkeypatch.setattr(minhash, "EFFORT", effort)
    monkeypatch.setattr(minhash, "PART", 8)
    monkeypatch.setattr(components, "TASK_LINKS", 7)
    rng = random.Random(effort)
    shared = " ".join(f"p{i}" for i in range(24))
    texts = []
    for _ in range(40):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
        texts += [f"{shared} {own}", f"{shared} {own} t{rng.randrange(9)}"][: rng.randint(1, 2)]
    texts += family(rng, 30, 60)
    rows = list(enumerate(texts))
    assert near(spark, rows) == brute_near(rows)


def test_the_largest_task_of_a_hot_group(spark):
    """Copies of one text and near copies of one text do not meet in one part of the joins."""
    rng = random.Random(2)
    left = spark.createDataFrame([(1, i, 4096, 10, 1.0, i, 0) for i in range(4096)], "key long, id long, size long, n long, fame double, component long, main long")
    left = left.withColumns({f"s{i}": F.lit(0).cast("long") for i in range(minhash.PLANE)} | {f"o{i}": F.lit(0).cast("long") for i in range(minhash.PARITY // 64)})
    pivots = left.where("id = 0")
    pairs = minhash.candidates(left, pivots, False)
    assert pairs.count() == 4095
    parts = left.select(F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / minhash.PART).cast("int")).alias("part")).groupBy("part").count().agg(F.max("count")).first()[0]
    assert parts < 2 * minhash.PART and rng


def test_posterior_bound_falls_with_the_miss_probability():
    assert minhash.least_matches(40) < 30 and minhash.least_matches(200) < 150
    assert minhash.least_matches(200, miss=1e-2) > minhash.least_matches(200, miss=1e-8)


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 90, dtype=np.uint64)])
    pa_, pb = (minhash.parities(x, np.array([len(x)])) for x in (a, b))
    assert 0 < np.unpackbits(pa_ ^ pb).sum() <= 190


@pytest.mark.parametrize("links_a_task", [3, 1_000_000])
def test_components_of_a_long_chain(spark, monkeypatch, links_a_task):
    monkeypatch.setattr(components, "TASK_LINKS", links_a_task)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_repeats(texts, length=suffix_dedup.LENGTH):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    return out


def repeat_cases(rng):
    base = ["".join(rng.choice("abcde fgh") for _ in range(2500)) for _ in range(3)]
    out = [None, "", "short", "ab" * 400, "é" * 500, "a" * 399, "b" * 400, "c" * 400, "c" * 400, "d" * 401]
    for _ in range(40):
        x = rng.choice(base)
        if rng.random() < 0.5:
            x = list(x)
            for _ in range(rng.randint(1, 6)):
                x[rng.randrange(len(x))] = "Z"
            out.append("".join(x))
        else:
            at, n = rng.randrange(2000), rng.choice([399, 400, 401, 430, 700])
            pad = lambda: "".join(rng.choice("xyz") for _ in range(rng.randint(0, 200)))
            out.append(pad() + x[at : at + n] + pad())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    texts = repeat_cases(random.Random(seed))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_report(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts])


def test_repeats_within_one_text_and_over_equal_rows(spark):
    passage = "".join(random.Random(8).choice("abcdefgh ") for _ in range(450))
    rows = [(1, passage + "middle" + passage), (2, "tail " * 10), (2, "tail " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.repeat_report(df).collect())
    assert got == [(1, 900, 2), (2, 0, 0), (2, 0, 0)]


def test_cutting_keeps_columns_and_whole_characters(spark):
    passage = "é" * 250 + "".join(random.Random(8).choice("abcdefgh ") for _ in range(300))
    rows = [(1, "x" + passage, "en", 7), (2, "yy" + passage + "end", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, z string, k1 int")
    got = {r.doc_id: (r.text, r.z, r.k1) for r in suffix_dedup.without_repeats(df).collect()}
    assert got == {1: ("x", "en", 7), 2: ("yyend", None, None)}
    assert suffix_dedup.without_repeats(df.limit(0)).collect() == []


def test_names_of_columns_do_not_matter_to_cutting(spark):
    passage = "".join(random.Random(8).choice("abcdefgh ") for _ in range(420))
    rows = [(1, passage + "x", 3, 4), (2, "y" + passage, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, codes int")
    got = suffix_dedup.without_repeats(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "x", 3, 4), (2, "y", 5, 6)]


def test_a_text_with_very_many_copies(spark, monkeypatch):
    """Its rows are kept apart from the joins; what they share with other texts is still found."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcde fgh") for _ in range(900))
    texts = [base] * 1100 + [base[100:700] + "tail", "x" * 399, "lead" + base[200:599], base[300:]] + ["short"] * 1100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_report(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts])
    assert suffix_dedup.apart(df)[0].count() == 1100


def test_a_very_long_text_end_to_end(spark, monkeypatch):
    """A text of several units that overlap, against brute force."""
    monkeypatch.setattr(suffix_dedup, "LONGEST_UNIT", 1500)
    rng = random.Random(12)
    base = "".join(rng.choice("abcde fgh") for _ in range(7000))
    texts = [base, base[1200:1900], base[3100:3520] + "z", base[2900:3299], None]
    hold = [(t or "").encode() for t in texts]
    found = list(suffix_dedup.units(np.frombuffer(hold[0], np.uint8), np.array([0, 7000])))
    assert len(found) == 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_report(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(hold)


def test_long_texts_are_cut_into_units_that_overlap(monkeypatch):
    """Names of anchors do not depend on how a text is cut."""
    data = np.random.default_rng(4).integers(97, 101, 5000, dtype=np.uint8)
    whole = list(suffix_dedup.units(data, np.array([0, 5000])))
    monkeypatch.setattr(suffix_dedup, "LONGEST_UNIT", 1000)
    parts = list(suffix_dedup.units(data, np.array([0, 5000])))
    assert len(whole) == 1 and len(parts) == 5

    def windows(found):
        out = {}
        for _, buf, at, base, w0, w1 in found:
            inside = suffix_dedup.open_windows(at)
            inside[:w0] = inside[w1:] = False
            p = np.flatnonzero(inside)
            grams = suffix_dedup.gram_names(buf)
            names = suffix_dedup.long_names(grams, p, p + suffix_dedup.LENGTH)
            assert not out.keys() & set((p + base).tolist())
            out |= dict(zip((p + base).tolist(), names.tolist(), strict=True))
        return out

    assert windows(whole) == windows(parts)
