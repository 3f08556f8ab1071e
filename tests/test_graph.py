"""Construction, views and lookups against literal cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import lookup, views
from kmerloom.plans import graph as g


def lines(graph):
    return sorted(r.line for r in views.text_lines(graph).collect())


def reads(spark, *seqs, k=3):
    return g.read_graph(spark, [("sample_0", s) for s in seqs], k)


def kmers(df):
    return {r.kmer for r in df.collect()}


@pytest.mark.parametrize(
    "seq, k, expected",
    [
        ("ACGTT", 3, ["AAC 1 ......G.", "ACG 2 a......T"]),
        ("ACCTT", 3, ["AAG 1 ......G.", "ACC 1 .......T", "AGG 1 a......T"]),
        ("A" * 33, 33, ["A" * 33 + " 1 ........"]),
        ("AC", 3, []),
    ],
)
def test_build_shows_golden_lines(spark, seq, k, expected):
    assert lines(reads(spark, seq, k=k)) == expected


def test_nine_mer(spark):
    (line,) = lines(reads(spark, "ACGTTCCCC", k=9))
    assert line.split()[1:] == ["1", "........"]


def test_kmers_of_fasta_case(spark):
    assert kmers(reads(spark, "ATTCC").nodes) == {"AAT", "GAA", "GGA"}


@pytest.mark.parametrize("k", [2, 4, 1])
def test_even_or_small_k_is_refused(spark, k):
    with pytest.raises(ValueError):
        reads(spark, "ACGT", k=k)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_mask_strings(spark):
    m = F.lit(dna.BEFORE["C"] | dna.AFTER["A"])
    assert one(spark, dna.edge_string(m)) == ".c..A..."
    assert one(spark, dna.edge_string_revcomp(m)) == "...T..g."
    assert one(spark, dna.mask_of_string(F.lit(".c..A..."))) == dna.BEFORE["C"] | dna.AFTER["A"]
    assert one(spark, dna.successors(F.lit("ACG"), F.lit(dna.AFTER["G"]), 3)) == ["CGG"]
    assert one(spark, dna.predecessors(F.lit("TAA"), F.lit(dna.BEFORE["T"]), 3)) == ["TTA"]
    assert one(spark, dna.revcomp(F.lit("AcG.N"))) == "N.CgT"


def test_pack_round_trip_keeps_order(spark):
    words = sorted("".join(p) for p in itertools.product("ACGT", repeat=3))
    df = spark.createDataFrame([(w,) for w in words], "s string").select("s", dna.pack("s").alias("p")).select("s", "p", dna.unpack("p", 3).alias("u"))
    rows = df.orderBy("p").collect()
    assert [r.s for r in rows] == words and all(r.s == r.u for r in rows)
    assert one(spark, dna.pack(F.lit("T" * 31))) == 4**31 - 1


def test_swapping_nibbles_is_reverse_complement(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("m")).select("m", dna.swap(dna.swap("m")).alias("s")).collect()
    assert all(r.m == r.s for r in rows)


def test_overlaps(spark):
    assert one(spark, dna.overlap_after(F.lit("ACT"), F.lit("AAG"), 3)) == "AGT"
    assert one(spark, dna.overlap_after(F.lit("CCC"), F.lit("AAA"), 3)) is None
    assert one(spark, dna.overlap_before(F.lit("CAA"), F.lit("AAA"), 3)) == "CAA"


def test_wide_and_long_forms_agree(spark):
    graph = g.read_graph(spark, [("a", "ACCTTA"), ("b", "CCTTG"), ("c", "AC")], 3)
    back = g.from_wide(g.to_wide(graph), 3, graph.samples)
    assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, graph.nodes.collect()))
    assert g.validate(graph).isEmpty()


def test_merge_puts_colors_side_by_side(spark):
    merged = g.merge(reads(spark, "AAAT"), reads(spark, "AAAG"))
    assert lines(merged) == ["AAA 1 1 .......T ......G.", "AAG 0 1 ........ a.......", "AAT 1 0 a....... ........"]
    with pytest.raises(ValueError):
        g.merge(reads(spark, "AAAT"), reads(spark, "AAATT", k=5))


def test_validate_names_what_is_wrong(spark):
    bad = g.Graph(spark.createDataFrame([("TTT", 0, 1, 0), ("AAC", 5, 1, 0), ("AAG", 0, 1, 999)], "kmer string, color int, coverage long, edges int"), 3, ("s",))
    assert {r.kmer: r.reason for r in g.validate(bad).collect()} == {"TTT": "not canonical", "AAC": "color", "AAG": "edges"}


def contig(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "contig_id int, seq string")


@pytest.mark.parametrize(
    "seq, query, expected",
    [
        ("ACCAA", "CAA", ["CAA: CAA 1 1 .c...... ........"]),
        ("AAAA", "GGG", ["CCC: GGG 0 1 ........ ........"]),
        ("ACCAA", "ACCAA", ["ACC: ACC 1 1 ....A... ....A...", "CCA: CCA 1 1 a...A... a...A...", "CAA: CAA 1 1 .c...... .c......"]),
    ],
)
def test_contig_lines(spark, seq, query, expected):
    rows = lookup.contig_lines(reads(spark, seq), contig(spark, query)).orderBy("pos").collect()
    assert [r.line for r in rows] == expected


def test_contig_graph_has_neighbours_of_other_colors(spark):
    graph = g.text_graph(spark, ["AAA 1 1 .....C.. .......T", "AAC 1 0 a....... ........", "AAT 0 1 ........ a......."], 3)
    nodes, edges = lookup.contig_graph(graph, contig(spark, "GTTT"))
    assert {r.node for r in nodes.collect()} == {"TTT", "GTT", "ATT"}
    assert {tuple(r) for r in edges.collect()} == {("GTT", "TTT", 0), ("GTT", "TTT", 2), ("ATT", "TTT", 1)}


def test_contig_in_empty_graph(spark):
    nodes = spark.createDataFrame([], "kmer string, color int, coverage long, edges int")
    rows = lookup.retrieve(g.Graph(nodes, 3, ("s",)), contig(spark, "TTAA")).collect()
    assert {r.kmer: (list(r.coverage), r.edges[1]) for r in rows} == {"TAA": ([0, 2], dna.BEFORE["T"])}


def test_lookups(spark):
    graph = reads(spark, "ACCTT")
    assert kmers(lookup.by_string(graph, "AAG")) == {"AAG"} and kmers(lookup.by_string(graph, "CTT")) == set()
    assert kmers(lookup.by_either_strand(graph, "CTT")) == {"AAG"}
    assert kmers(lookup.by_seeds(graph, spark.createDataFrame([("CTTG",)], "seq string"))) == {"AAG"}
    probes = spark.createDataFrame([("AAA",), ("ACC",), ("TTT",)], "probe string")
    assert {r.probe: r["rank"] for r in lookup.ranks(graph, probes).collect()} == {"AAA": 0, "ACC": 1, "TTT": 3}


@pytest.mark.parametrize("a, b, bits", [("AAG", "ACT", {"AAG": "T", "ACT": "T"}), ("AAA", "AAA", {"AAA": "aA"})])
def test_connect_and_disconnect(spark, a, b, bits):
    rows = [(x, 0, 1, 0) for x in {a, b}]
    graph = g.Graph(spark.createDataFrame(rows, "kmer string, color int, coverage long, edges int"), 3, ("s",))
    pair = spark.createDataFrame([(a, b, 0)], "a string, b string, color int")
    joined = views.change_edges(graph, pair, True)
    shown = {r.kmer: r.e.replace(".", "") for r in joined.nodes.select("kmer", dna.edge_string("edges").alias("e")).collect()}
    assert shown == bits and views.one_sided_edges(joined).isEmpty()
    assert views.change_edges(joined, pair, False).nodes.where("edges <> 0").isEmpty()


def test_removal_clears_flags_of_neighbours(spark):
    graph = reads(spark, "ACCAA", "CCAT")
    left = views.without(graph, spark.createDataFrame([("TGG",)], "kmer string"))
    assert kmers(left.nodes) == {"ACC", "CAA", "ATG"}
    assert left.nodes.where("edges <> 0").isEmpty() and views.one_sided_edges(left).isEmpty()


def test_edges_and_degrees_of_random_graphs(spark):
    rng = random.Random(5)
    graph = g.read_graph(spark, [(s, "".join(rng.choice("ACGT") for _ in range(40))) for s in "abc"], 3)
    assert views.one_sided_edges(graph).isEmpty()
    edges = {(r.src, r.dst, r.color) for r in views.oriented_edges(graph).collect()}
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert edges and edges == {(rc(b), rc(a), c) for a, b, c in edges}
    degree = {r.kmer: (r.in_degree, r.out_degree) for r in views.degrees(graph).collect()}
    for kmer, (before, after) in degree.items():
        assert after == sum(a == kmer for a, _, _ in edges) and before == sum(b == kmer for _, b, _ in edges)


def test_boundary_annotation(spark):
    graph = g.text_graph(spark, ["AAA 1 1 ........ .c...C.."], 3)
    assert lines(views.boundary(graph, graph.nodes)) == ["AAA 1 1 ........ .c...C..", "AAC 1 1 ........ a.......", "CAA 1 1 ........ ....A..."]


def test_keep_color_drops_loops_and_untouched_kmers(spark):
    graph = g.read_graph(spark, [("a", "AAAA"), ("b", "AAAC"), ("b", "GGG")], 3)
    assert kmers(views.keep_color(graph, 0).nodes) == set()
    assert kmers(views.keep_color(graph, 1).nodes) == {"AAA", "AAC"}
    assert kmers(views.keep_color(graph, 0, self_loops=True).nodes) == {"AAA"}


def test_compose_takes_the_right_rows(spark):
    both = views.compose(reads(spark, "AAAT"), reads(spark, "AAAT", "AAAG"))
    assert {r.kmer: r.coverage for r in both.nodes.collect()} == {"AAA": 2, "AAT": 1, "AAG": 1}


@pytest.mark.parametrize("k", [3, 11, 31, 33, 47, 65])
def test_codes_equal_strings(spark, k):
    """Two-bit construction against a plain count, over words, strands, other letters and short reads."""
    import random
    from collections import Counter

    rng = random.Random(k)
    reads = [(rng.randrange(2), "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 3 * k)))) for _ in range(30)]
    reads += [(0, reads[3][1] + "N" + reads[4][1]), (1, "A" * (k + 2)), (0, ""), (0, None), (1, "AC" * k)]
    comp = str.maketrans("ACGT", "TGCA")
    before, after = {"A": 128, "C": 64, "G": 32, "T": 16}, {"A": 1, "C": 2, "G": 4, "T": 8}
    count, edges = Counter(), Counter()
    for color, seq in reads:
        for i in range(len(seq or "") - k + 1):
            kmer = seq[i : i + k]
            if "N" in kmer:
                continue
            rc = kmer[::-1].translate(comp)
            m = (before.get(seq[i - 1], 0) if i else 0) | (after.get(seq[i + k], 0) if i + k < len(seq) else 0)
            if rc < kmer:
                m = (m << 4 | m >> 4) & 255
            count[min(kmer, rc), color] += 1
            edges[min(kmer, rc), color] |= m
    got = g.build(spark.createDataFrame(reads, "color int, seq string"), k, ("a", "b")).nodes.collect()
    assert sorted(map(tuple, got)) == sorted((x, c, n, edges[x, c]) for (x, c), n in count.items())
