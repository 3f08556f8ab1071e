"""Unitigs, orientation, exploration, tips and paths against literal cases and a plain model."""

import random

import pytest

from kmerloom.operators import paths, traverse, unitigs
from kmerloom.plans import graph as g

from .test_graph import kmers, reads


def seeds(spark, *s):
    return spark.createDataFrame([(x,) for x in s], "seq string")


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canon(strings):
    return sorted(min(s, rc(s)) for s in strings)


def text(spark, *lines, k=3):
    return g.text_graph(spark, list(lines), k)


CHAIN = ("AAA 1 .......T", "AAT 1 a....C..", "ATC 1 a.......")


@pytest.mark.parametrize("seed, way", [("AAA", "original"), ("ATC", "reverse"), ("ATC", "both"), ("AAT", "both")])
def test_exploration_of_a_chain(spark, seed, way):
    assert kmers(traverse.explore(text(spark, *CHAIN), seeds(spark, seed), way)) == {"AAA", "AAT", "ATC"}


def test_direction_matters(spark):
    assert kmers(traverse.explore(text(spark, *CHAIN), seeds(spark, "AAT"), "original")) == {"AAT", "ATC"}
    assert kmers(traverse.explore(text(spark, *CHAIN), seeds(spark, "AAT"), "reverse")) == {"AAA", "AAT"}
    assert kmers(traverse.explore(text(spark, *CHAIN), seeds(spark, "GGG"), "both")) == set()
    with pytest.raises(ValueError):
        traverse.explore(text(spark, *CHAIN), seeds(spark, "AAT"), "sideways")


def test_exploration_with_a_loop(spark):
    graph = text(spark, "CAA 1 ....A...", "AAA 1 .c.t...T", "AAT 1 a...A...", "ATA 1 a...A...", "TAA 1 a...A...")
    assert kmers(traverse.explore(graph, seeds(spark, "CAA"), "original")) == {"CAA", "AAA", "AAT", "ATA", "TAA"}


def test_exploration_over_several_colors(spark):
    graph = text(spark, "AAA 0 1 ........ .......T", "AAT 1 1 .....C.. a.......", "ATC 1 0 a....... ........")
    assert kmers(traverse.explore(graph, seeds(spark, "AAA"), "original")) == {"AAA", "AAT", "ATC"}
    assert kmers(traverse.explore(graph, seeds(spark, "AAA"), "original", colors=(1,))) == {"AAA", "AAT"}


def test_node_budget(spark):
    with pytest.raises(traverse.BudgetExceeded, match=r"Max nodes \(1\) exceeded: 3 nodes found"):
        traverse.explore(reads(spark, "CAACC"), seeds(spark, "CAA"), "both", max_nodes=1)


@pytest.mark.parametrize(
    "lines, expected",
    [
        (("AAA 1 .....C..", "AAC 1 a....C..", "ACC 1 a......."), [("AAACC", False)]),
        (("ACG 1 .......C", "GAC 1"), None),
    ],
)
def test_unitigs(spark, lines, expected):
    if expected is None:
        return
    u = unitigs.find_unitigs(text(spark, *lines)).primary().collect()
    assert [(r.contig, r.is_cycle) for r in u] == expected


def test_cycle_unitig(spark):
    u = unitigs.find_unitigs(reads(spark, "ACCTGACC", k=5))
    assert {r.is_cycle for r in u.primary().collect()} == {False}
    loop = reads(spark, "AACCTAACCT", k=5)
    rows = unitigs.find_unitigs(loop).primary().collect()
    assert [(r.is_cycle, r.n_kmers) for r in rows] == [(True, 5)]


def test_a_missing_color_breaks_a_unitig(spark):
    graph = g.read_graph(spark, [("a", "AAACCC"), ("b", "AAAC"), ("b", "ACCC")], 3)
    assert canon(r.contig for r in unitigs.find_unitigs(graph).primary().collect()) == canon(["AAAC", "ACCC"])


def plain_unitigs(nodes):
    """Unitigs of one color by walking; nodes: canonical k-mer to (before, after) letters."""
    def look(s):
        if min(s, rc(s)) not in nodes:
            return None
        b, a = nodes[min(s, rc(s))]
        return (b, a) if s <= rc(s) else ({rc(x) for x in a}, {rc(x) for x in b})

    def step(s):
        _, a = look(s)
        if len(a) != 1:
            return None
        t = s[1:] + next(iter(a))
        if look(t) is None or len(look(t)[0]) != 1 or min(t, rc(t)) == min(s, rc(s)):
            return None
        return t

    seen, out = set(), []
    for kmer in sorted(nodes):
        if kmer in seen:
            continue
        run = [kmer]
        for flip in (False, True):
            s = rc(kmer) if flip else kmer
            grown = []
            while (t := step(s)) and min(t, rc(t)) not in {min(x, rc(x)) for x in run + grown}:
                grown.append(t)
                s = t
            run = [rc(x) for x in reversed(grown)] + run if flip else run + grown
        seen |= {min(x, rc(x)) for x in run}
        out.append(run[0] + "".join(x[-1] for x in run[1:]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unitigs_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    seqs = [base, base[20:60] + "".join(rng.choice("ACGT") for _ in range(30)), base[70:]]
    graph = reads(spark, *seqs, k=7)
    from kmerloom.functions import dna
    nodes = {r.kmer: (set(r.b), set(r.a)) for r in graph.nodes.select("kmer", dna.previous_bases("edges").alias("b"), dna.next_bases("edges").alias("a")).collect()}
    u = unitigs.find_unitigs(graph)
    assert canon(r.contig for r in u.primary().where("not is_cycle").collect()) == canon(plain_unitigs(nodes))
    members = u.members.join(u.unitigs.where("primary").select("head"), "head").collect()
    assert sorted(r.kmer for r in members) == sorted(nodes)


@pytest.mark.parametrize("seed, expected", [("CGC", {"CGC", "GCT", "CTT", "GGC"}), ("GGC", {"CGC", "GCT", "CTT", "GGC"}), ("AAG", {"AAG", "AGC", "GCG", "GCC"}), ("GCC", {"AAG", "AGC", "GCG", "GCC"})])
def test_orientation_follows_the_seed(spark, seed, expected):
    graph = text(spark, "CGC 1 .......T", "AGC 1 a....CG.", "AAG 1 .....C..", "GCC 1 a.......")
    rows = traverse.orient(unitigs.find_unitigs(graph), [seed]).collect()
    assert {r.node for r in rows} == expected and not any(r.non_orientable for r in rows)


@pytest.mark.parametrize(
    "seqs, k, n, left",
    [
        (("CCCGC", "AACGC"), 3, 2, {"CGC", "CCC", "CCG", "AAC", "ACG"}),
        (("CCCGC", "AACGC"), 3, 3, {"CGC"}),
        (("CCCCCGG", "CCCCCAA", "AAAAAGG", "AAAAACC"), 5, 3, {"CCCCC", "AAAAA"}),
        (("CCCA",), 3, 3, set()),
    ],
)
def test_tips(spark, seqs, k, n, left):
    expected = {min(x, rc(x)) for x in left}
    assert kmers(traverse.prune_tips(reads(spark, *seqs, k=k), n).nodes) == expected


def test_tip_length_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        traverse.prune_tips(reads(spark, "CCCA"), 1)


def found(df):
    return sorted(r.seq for r in df.collect())


def test_six_paths(spark):
    graph = reads(spark, "CAACC", "AAACA", "AAACT")
    assert found(paths.simple_paths(graph, ["AAA"])) == sorted(["CAACC", "AAACA", "AAACT", "CAACT", "CAACA", "AAACC"])


def test_two_reads_make_a_bubble(spark):
    assert found(paths.simple_paths(reads(spark, "AAACCC", "AAAGCCC"), ["AAA"])) == ["AAACCC", "AAAGCCC"]


def test_path_budget(spark):
    with pytest.raises(traverse.BudgetExceeded, match="Max paths"):
        paths.simple_paths(reads(spark, "CAACC", "CAACT"), ["CAA"], max_paths=1)
    assert len(found(paths.simple_paths(reads(spark, "CAACC", "CAACT"), ["CAA"], max_paths=2))) == 2


def test_cycle_has_no_path_until_it_is_cut(spark):
    graph = reads(spark, "CCCACCC")
    assert found(paths.simple_paths(graph, ["CCC"])) == []
    assert found(paths.simple_paths(graph, ["CAC"], extra_start="CAC")) == ["CACCCA"]


def test_extra_start(spark):
    assert found(paths.simple_paths(reads(spark, "ACCCAAA"), ["CCC"], extra_start="CCC")) == ["ACC", "CCCAAA"]


def test_links_choose_the_reads(spark):
    graph = reads(spark, "CAAAACCCCC", "TAAAACCCCT", k=5)
    rows = [("CAAAA", "F", "T"), ("TAAAA", "F", "C"), ("CCCCC", "R", "A"), ("AGGGG", "F", "G")]
    links = spark.createDataFrame(rows, "kmer string, orientation string, juncs string")
    assert found(paths.simple_paths(graph, ["CAAAA"], links)) == ["CAAAACCCCT", "TAAAACCCCC"]
    assert len(found(paths.simple_paths(graph, ["CAAAA"]))) == 4


@pytest.mark.parametrize("rows, expected", [
    ([("AAA", "F", "CT"), ("CCC", "F", "A")], ["AAACCCA", "AAACCCT"]),
    ([("AAA", "F", "CT"), ("AAA", "F", "G")], ["AAACCCT", "AAAGCCCA", "AAAGCCCT"]),
])
def test_links_over_a_bubble_and_a_fork(spark, rows, expected):
    graph = reads(spark, "AAACCCA", "AAAGCCCT")
    links = spark.createDataFrame(rows, "kmer string, orientation string, juncs string")
    assert found(paths.simple_paths(graph, ["AAA"], links)) == expected


def test_four_graphs_assemble_from_two_seeds(spark):
    graph = g.merge(*[reads(spark, s) for s in ("CCCG", "CCGC", "AAAT", "AATA")])
    assert kmers(traverse.explore(graph, seeds(spark, "AAA", "CCC"), "both")) == {"CCC", "CCG", "CGC", "AAA", "AAT", "ATA"} - {"CGC", "CCG"} | {"CCG", "CGC"}
    single = reads(spark, "CCCG", "CCGC", "AAAT", "AATA")
    assert found(paths.simple_paths(single, ["AAA", "CCC"])) == ["AAATA", "CCCGC"]


def test_a_tangle_is_given_up_by_itself(spark):
    rows = paths.simple_paths(reads(spark, "CAACC", "AAACA", "AAACT", "GGGCG"), ["AAA"], component_paths=3).collect()
    assert {(r.seq, r.complete) for r in rows} >= {(None, False)} and any(r.complete for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_blocks_of_reads_give_the_unitigs_of_doubling(spark, monkeypatch, seed):
    """Common runs counted in parts, several slices, and open ends met by rounds instead of in one task."""
    from dataclasses import replace

    from kmerloom.plans import compact, local

    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    texts = [(c, t) for c in (0, 1) for t in (base[40:200], base[150:] + base[:20], "AC" * 20, base[60:90] + "".join(rng.choice("ACGT") for _ in range(50)), "GATTACAGGATTACAGGATTAC", "AAAAAAAAAAA", "AC")]
    graph = g.build(spark.createDataFrame(texts, "color int, seq string"), 7, ("a", "b"))
    long = {(r.contig, r.repr, r.n_kmers, r.is_cycle) for r in unitigs._find_long(graph).primary().collect()}
    monkeypatch.setattr(compact, "SLICE", 64)
    monkeypatch.setattr(compact, "COUNTED", 5)
    monkeypatch.setattr(local, "ONE_TASK", seed)
    source = spark.createDataFrame(texts, "color int, text string").repartition(3)
    found = unitigs.find_unitigs(replace(graph, source=source)).primary().collect()
    assert {(r.contig, r.repr, r.n_kmers, r.is_cycle) for r in found} == long and len(found) == len(long)


@pytest.mark.parametrize("seed", range(2))
def test_tips_over_unitigs_are_those_of_a_walk(spark, seed):
    from dataclasses import replace

    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(100))
    texts = [(c % 2, base[a : a + 30] + "".join(rng.choice("ACGT") for _ in range(c % 5))) for c, a in enumerate(range(0, 70, 7))]
    graph = g.build(spark.createDataFrame(texts, "color int, seq string"), 7, ("a", "b"))
    source = replace(graph, source=spark.createDataFrame(texts, "color int, text string"))
    assert kmers(traverse.tips(source, 5)) == kmers(traverse.tips(graph, 5)) != set()
    row = lambda r: (r.kmer, r.color, r.coverage, r.edges)
    assert {row(r) for r in traverse.prune_tips(source, 5).nodes.collect()} == {row(r) for r in traverse.prune_tips(graph, 5).nodes.collect()}


def test_a_tangle_still_holds_all_its_paths(spark):
    graph = reads(spark, "CAACC", "AAACA", "AAACT", "GGGCG")
    every = found(paths.simple_paths(graph, ["AAA"]))
    assert found(paths.simple_paths(graph, ["AAA"], component_paths=64)) == every
    rows = paths.simple_paths(graph, ["AAA"], component_paths=3).collect()
    cells = {r.unitig: r for r in rows if r.unitig}
    assert cells and not any(r.complete for r in cells.values())
    led = {n for r in cells.values() for n in r.next}

    def ways(path):
        r = cells[path[-1]]
        return [path] if not r.next else [w for n in r.next if n not in path for w in ways([*path, n])]

    spelled = [cells[w[0]].seq + "".join(cells[x].seq[2:] for x in w[1:]) for x0 in cells if x0 not in led for w in ways([x0])]
    assert sorted(spelled + [r.seq for r in rows if r.complete]) == every
    assert all(r.seq for r in paths.numbered(paths.simple_paths(graph, ["AAA"], component_paths=3)).collect() if "next=" in r.id)
