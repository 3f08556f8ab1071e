"""Language, toxicity and quality: counts against brute force, models by held-out accuracy."""

import collections
import random
import re

import numpy as np
import pytest

from kmerloom.llm import langid, quality_classifier, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"aa": "ka ta ra ma no pi".split(), "bb": "él ür os en ig ul".split(), "cc": "sch ung cht pf tz er".split()}


def prose(rng, language, n):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(spark, n=240, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        language = rng.choice(list(SYLLABLES))
        words = prose(rng, language, rng.randint(60, 160)).split()
        bad, toxic = rng.random() < 0.25, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "badname", "slurry"]))
        text = "".join(w + (".\n" if k % 12 == 11 else " ") for k, w in enumerate(words))
        if bad:
            text = "\n".join(line.upper().replace(" ", "!! ") for line in text.split("\n"))
        rows.append((i, text, language, "good" if not bad or rng.random() < 0.2 else "junk", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "aa", "good", 0), (n + 2, "123 456 !!", "bb", "good", 10), (n + 3, "中文", None, None, 2), (None, "ka ta", "aa", "good", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, {x[0]: x for x in labels}


@pytest.fixture(scope="module")
def small(spark):
    return corpus(spark)


def greedy_phrases(text, sample):
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_cross_parsing_equals_a_greedy_parse():
    rng = random.Random(0)
    to = lambda t: langid.symbols(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    samples = {x: prose(rng, x, 80) for x in SYLLABLES}
    parser = langid.CrossParser({x: [to(t)] for x, t in samples.items()})
    queries = [prose(rng, x, 12) for x in SYLLABLES] + ["zzz", "", "ka"]
    # longer than a piece: from a sample, so that phrases pass its ends, of one letter, and periodic
    queries += [s[5:] for s in samples.values()] + [prose(rng, x, 300) for x in SYLLABLES] + ["q" * 700, "k" * 700, samples["aa"][:40] * 30, samples["aa"][:300] * 4]
    raw = [q.encode() for q in queries]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    classes, where = langid.symbols(np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = parser.phrases(classes, where)
    as_text = lambda c: "".join(chr(200 + int(x)) for x in c)
    for g, x in enumerate(parser.languages):
        sample = as_text([*to(samples[x]), 0])
        for i in range(len(queries)):
            assert got[g, i] == greedy_phrases(as_text(classes[where[i] : where[i + 1]]), sample)


def test_languages(spark, small):
    docs, _, rows, _ = small
    got = {r.doc_id: r for r in langid.language_report(docs).collect()}
    assert len(got) == len(rows)
    for i, text, language, *_ in rows:
        r = got[i]
        assert 0 <= r.score <= 1
        if i is not None and i < 240:
            assert r.lang_pred == language
        elif not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in SYLLABLES
    assert langid.language_report(docs.limit(0)).collect() == []


def test_the_stage_keeps_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "na ka ta", "aa", 5, 6, 7)] * 3 + [(2, "12", "aa", 1, 2, 3), (None, "so lo", None, 1, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h long, _h long, `a.b` int")
    got = langid.accepted(docs)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if r.text != "12")
    assert langid.accepted(docs.limit(0)).collect() == []


def test_nothing_learned_gives_und_and_accepts_letters(spark, small):
    docs = small[0].selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "1 AS score")
    assert {r.lang_pred for r in langid.language_report(docs).collect()} == {"und"}
    assert langid.accepted(docs).count() == 242


def test_accepted_rows_are_unchanged(spark, small):
    docs, _, rows, _ = small
    docs = docs.selectExpr("*", "'x' AS held_out", "2 AS lang_pred")
    out = langid.accepted(docs)
    assert out.columns == docs.columns
    kept = {tuple(r) for r in out.collect()}
    assert {r[:5] for r in kept} <= {tuple(r) for r in rows} and {r[0] for r in kept} >= set(range(240))


def test_ties_between_languages_are_accepted(spark):
    rng = random.Random(8)
    text = prose(rng, "aa", 300)
    rows = [(i, text, x) for i, x in enumerate(["aa", "bb"] * 8)] + [(100, "K.", None), (101, text[:40], None), (102, "12.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.accepted(docs).collect()} == {*range(16), 100, 101}


def test_languages_of_long_and_of_tiny_texts_are_learned(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, "aa", 100), "aa") for i in range(40)] + [(100 + i, prose(rng, "bb", 3000), "bb") for i in range(8)] + [(200 + i, prose(rng, "cc", 3), "cc") for i in range(2000)]
    parser = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert parser.languages == ["aa", "bb", "cc"]
    # an automaton has at least as many states as its sample has symbols
    ends = [*(parser.roots[1:, 0] // parser.width), len(parser.table) // parser.width]
    assert all(int(b - a) > 15_000 for a, b in zip(parser.roots[:, 0] // parser.width, ends))


def test_toxicity_of_held_out_rows(spark, small):
    docs, labels, rows, truth = small
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 20 and sum(got[i].predicted == truth[i][2] for i in held) / len(held) > 0.9
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts_and_line_verdicts(spark, small):
    docs, labels, rows, truth = small
    odd = [(1000, "a a a a\na a a a\n\n x", None, None, 1), (1001, "\n\n\n", None, None, 3), (1002, "line\r\nline\r\nline", None, None, 3), (1003, "# * $ % & | < >" * 30, None, None, 3), (1004, "w" * 200000, None, None, 3)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r.doc_id: r for r in quality_rules.quality_report(both, labels).collect()}
    for i, text, *_ in [*rows, *odd]:
        r = got[i]
        assert tuple(r)[1:7] == base(text), i
        assert not (r.base_failed and r.kept)
    judged = [i for i in truth if not got[i].base_failed]
    assert sum(got[i].kept == bool(truth[i][1]) for i in judged) / len(judged) > 0.95
    assert quality_rules.quality_report(docs.limit(0), labels).collect() == []


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    rng = np.random.default_rng(6)
    field = quality_rules.LineField(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    lines = np.array([4, 1, 6, 0, 3])
    x = rng.normal(size=(lines.sum(), 3))
    got = field.viterbi(x, lines)
    at = 0
    for n in lines:
        score = lambda p, at=at: sum((x[at + i] @ field.emission)[s] for i, s in enumerate(p)) + sum(field.transition[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product((0, 1), repeat=int(n)), key=score) if n else ()
        assert tuple(got[at : at + n]) == best
        at += n


def test_gradient_of_the_field_is_that_of_its_likelihood():
    import itertools

    rng = np.random.default_rng(7)
    lines, x = np.array([3, 2]), rng.normal(size=(5, 2))
    labels, weight = np.array([0, 1, 1, 1, 0], np.int8), np.array([1.0, 0.5])

    def likelihood(field):
        total = at = 0
        for n, w in zip(lines, weight, strict=True):
            s = lambda p, at=at: sum((x[at + i] @ field.emission)[v] for i, v in enumerate(p)) + sum(field.transition[a, b] for a, b in zip(p, p[1:], strict=False))
            total += w * (s(labels[at : at + n]) - np.log(sum(np.exp(s(p)) for p in itertools.product((0, 1), repeat=int(n)))))
            at += n
        return total

    field = quality_rules.LineField(rng.normal(size=(2, 2)), rng.normal(size=(2, 2)))
    ge, gt = field.gradient(x, lines, labels, weight)
    for g, value in ((ge, field.emission), (gt, field.transition)):
        for i in np.ndindex(2, 2):
            value[i] += 1e-5
            up = likelihood(field)
            value[i] -= 2e-5
            down = likelihood(field)
            value[i] += 1e-5
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_quality_classifier_on_held_out_rows(spark, small):
    docs, labels, rows, truth = small
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.kept == bool(r.predicted) for r in got.values())
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i][1] for i in held) / len(held) > 0.95
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_the_step_is_the_gradient_of_the_risk():
    """By differences, on both sides of the correction."""
    rng = np.random.default_rng(3)
    size, signs = 6, set()
    for trial in range(12):
        rows = lambda n: [np.unique(rng.integers(0, size, rng.integers(0, 5))) for _ in range(n)]
        p, u, prior = toxicity.Sparse(rows(7)), toxicity.Sparse(rows(11)), 0.1 if trial % 2 else 0.9
        w, b = rng.normal(size=size) * 2, rng.normal()

        def parts(w, b, p=p, u=u, prior=prior):
            sp, su = 1 / (1 + np.exp(-p.times(w) - b)), 1 / (1 + np.exp(-u.times(w) - b))
            return prior * (1 - sp).mean(), su.mean() - prior * sp.mean()

        excess, g, gb = toxicity.nnpu_gradient(p, u, w, b, prior)
        assert np.isclose(excess, parts(w, b)[1])
        signs.add(excess >= 0)
        aim = (lambda w, b: sum(parts(w, b))) if excess >= 0 else (lambda w, b: -parts(w, b)[1])  # noqa: B023
        step = 1e-6
        by_difference = [(aim(w + step * e, b) - aim(w - step * e, b)) / (2 * step) for e in np.eye(size)]
        assert np.allclose(g, by_difference, atol=1e-6) and np.isclose(gb, (aim(w, b + step) - aim(w, b - step)) / (2 * step), atol=1e-6)
    assert signs == {True, False}


def test_rows_of_one_id_count_once_in_samples(spark):
    rng = random.Random(1)
    rows = [(1, f"{prose(rng, 'aa', 8)} {i}", "aa", "s", 5) for i in range(300)] + [(i, prose(rng, "bb", 60), "bb", "s", 9) for i in range(2, 12)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(1, 12)] * 2, "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "CAST(toxic AS int) AS toxic")
    positives, unlabelled, _ = toxicity.sample(docs.select("doc_id", "text"), labels)
    assert len(unlabelled) == 11 and len(positives) <= 4
    clash = docs.selectExpr("*", "1 AS h", "2 AS r", "3 AS mark", "4 AS y", "5 AS quality", "6 AS `a.b`")
    for made in (toxicity.toxicity(clash, labels), quality_rules.quality_report(clash, labels), quality_classifier.classify(clash, labels), langid.language_report(clash)):
        assert made.count() == 350 and made.select("doc_id").distinct().count() == 11


def test_very_long_texts_and_empty_tables(spark):
    rng = random.Random(4)
    long = prose(rng, "aa", 60_000)
    docs = spark.createDataFrame([(1, long, "aa", "s", len(long)), (2, long + " x", "bb", "s", 5), (3, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality_rules.quality_report, quality_classifier.classify):
        assert f(docs, labels).count() == 3 and f(docs.limit(0), labels.limit(0)).count() == 0
