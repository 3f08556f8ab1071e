"""Lookups: by string, by seed, by rank, and contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.graph import Graph, to_wide


def by_string(graph: Graph, kmer: str) -> DataFrame:
    """Rows of exactly this string; the equality reaches the scan."""
    return graph.nodes.where(F.col("kmer") == kmer)


def by_either_strand(graph: Graph, kmer: str) -> DataFrame:
    return by_string(graph, min(kmer, kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))))


def by_seeds(graph: Graph, seeds: DataFrame) -> DataFrame:
    """Rows of the k-mers of all seed strings ``(seq)``, either strand."""
    kmers = seeds.select(F.explode(dna.kmer_array("seq", graph.k)).alias("s")).select(dna.canonical("s").alias("kmer")).distinct()
    return graph.nodes.join(kmers, "kmer", "left_semi")


def ranks(graph: Graph, probes: DataFrame) -> DataFrame:
    """``probe, rank``: the number of k-mers below each probe, present or not.

    K-mers are counted by their first eight bases; only those that share them with a probe are
    compared, the rest of the rank is a running sum over the prefixes.
    """
    n = min(8, graph.k)
    head = F.substring("kmer", 1, n)
    kmers = graph.nodes.select("kmer").distinct()
    blocks = kmers.groupBy(head.alias("head")).agg(F.count("*").alias("size"))
    p = probes.select("probe").distinct().withColumn("head", F.substring("probe", 1, n))
    marks = blocks.select("head", "size").unionByName(p.select("head", F.lit(0).cast("long").alias("size")).distinct()).groupBy("head").agg(F.sum("size").alias("size"))
    # at most 4^8 prefixes reach the one ordered window
    below = marks.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = p.join(kmers.withColumn("head", head), "head").where("kmer < probe").groupBy("probe").agg(F.count("*").alias("inside"))
    return p.join(below, "head").join(inside, "probe", "left").select("probe", (F.col("before") + F.coalesce("inside", F.lit(0))).alias("rank"))


def contig_kmers(contigs: DataFrame, k: int) -> DataFrame:
    """``contig_id, pos, query, kmer, count, mask`` of ``contigs (contig_id, seq)``.

    ``count`` is how often the k-mer is in the contig on either strand; ``mask`` has the edges
    between consecutive k-mers, in the strand of the canonical k-mer.
    """
    o = contigs.select("contig_id", F.explode(dna.occurrences("seq", k)).alias("o")).select("contig_id", "o.*")
    seen = dna.flag("before", dna.BEFORE).bitwiseOR(dna.flag("after", dna.AFTER))
    o = o.select("contig_id", "pos", F.col("kmer").alias("query"), dna.canonical("kmer").alias("kmer"), dna.strand_mask(seen, dna.is_canonical("kmer")).alias("m"))
    own = o.groupBy("contig_id", "kmer").agg(F.count("*").alias("count"), F.bit_or("m").alias("mask"))
    return o.drop("m").join(own, ["contig_id", "kmer"])


def retrieve(graph: Graph, contigs: DataFrame) -> DataFrame:
    """``contig_id, pos, query, kmer, coverage, edges``: the contig's own color comes last.

    K-mers that the graph lacks have zeros in its colors.
    """
    zeros = F.array_repeat(F.lit(0), graph.num_colors)
    j = contig_kmers(contigs, graph.k).join(to_wide(graph), "kmer", "left")
    coverage = F.concat(F.coalesce("coverage", zeros.cast("array<long>")), F.array(F.col("count")))
    edges = F.concat(F.coalesce("edges", zeros.cast("array<int>")), F.array("mask"))
    return j.select("contig_id", "pos", "query", "kmer", coverage.alias("coverage"), edges.alias("edges"))


def contig_lines(graph: Graph, contigs: DataFrame) -> DataFrame:
    """``contig_id, pos, line`` with the edges in the strand of the query, display letters kept in case."""
    r = retrieve(graph, contigs)
    same = F.col("kmer") == F.col("query")
    shown = F.transform("edges", lambda m: F.when(same, dna.edge_string(m)).otherwise(dna.edge_string_revcomp(m)))
    return r.select("contig_id", "pos", F.concat_ws(" ", F.concat("kmer", F.lit(":")), "query", F.array_join(F.transform("coverage", lambda c: c.cast("string")), " "), F.array_join(shown, " ")).alias("line"))


def contig_graph(graph: Graph, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, coverage`` and edges ``src, dst, color`` around contigs, in their strand.

    Contig edges have the last color; other colors bring all neighbours, off-contig ones with zeros.
    """
    k, last = graph.k, graph.num_colors
    r = retrieve(graph, contigs).withColumn("forward", F.col("kmer") == F.col("query"))
    one = r.select("query", F.posexplode("edges").alias("color", "m"), "forward").withColumn("m", dna.strand_mask("m", F.col("forward")))
    graph_edges = one.where(F.col("color") < last)
    out = graph_edges.select(F.col("query").alias("src"), F.explode(dna.successors("query", "m", k)).alias("dst"), "color")
    back = graph_edges.select(F.explode(dna.predecessors("query", "m", k)).alias("src"), F.col("query").alias("dst"), "color")
    nxt = F.lead("query").over(Window.partitionBy("contig_id").orderBy("pos"))
    own = r.select(F.col("query").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL").withColumn("color", F.lit(last))
    e = out.unionByName(back).unionByName(own).distinct()
    on = r.select(F.col("query").alias("node"), "coverage").distinct()
    off = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(on, "node", "left_anti")
    return on.unionByName(off.withColumn("coverage", F.array_repeat(F.lit(0).cast("long"), last + 1))), e
