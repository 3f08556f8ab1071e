"""Views of a graph: oriented nodes, edges, degrees, filters, overlays and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.graph import Graph


def oriented(graph: Graph) -> DataFrame:
    """Both strands of every row: ``node, kmer, forward, color, coverage, edges`` (mask in the strand of node)."""
    both = F.explode(F.array(F.struct(F.col("kmer").alias("node"), F.lit(True).alias("forward"), F.col("edges").alias("edges")), F.struct(dna.revcomp("kmer").alias("node"), F.lit(False).alias("forward"), dna.swap("edges").alias("edges"))))
    return graph.nodes.select("kmer", "color", "coverage", both.alias("o")).select("o.node", "kmer", "o.forward", "color", "coverage", "o.edges")


def edges_out(graph: Graph) -> DataFrame:
    """``src, dst, color``: edges that follow from the canonical string, dangling ones too."""
    return graph.nodes.select(F.col("kmer").alias("src"), F.explode(dna.successors("kmer", "edges", graph.k)).alias("dst"), "color")


def edges_in(graph: Graph) -> DataFrame:
    """``src, dst, color``: edges into the canonical string."""
    return graph.nodes.select(F.explode(dna.predecessors("kmer", "edges", graph.k)).alias("src"), F.col("kmer").alias("dst"), "color")


def oriented_edges(graph: Graph) -> DataFrame:
    """``src, dst, color``: every edge of both strands whose ends are in the graph.

    The ends are checked by a semi join on the canonical k-mer of the target.
    """
    o = oriented(graph)
    e = o.select(F.col("node").alias("src"), F.explode(dna.successors("node", "edges", graph.k)).alias("dst"), "color")
    return e.withColumn("kmer", dna.canonical("dst")).join(graph.nodes.select("kmer"), "kmer", "left_semi").select("src", "dst", "color")


def canonical_edges(graph: Graph) -> DataFrame:
    """``a, b, color, flipped``: each edge once, its ends canonical and in order, both in the graph."""
    e = oriented_edges(graph).select(dna.canonical("src").alias("x"), dna.canonical("dst").alias("y"), "color", (dna.is_canonical("src") != dna.is_canonical("dst")).alias("flipped"))
    return e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "color", "flipped").distinct()


def degrees(graph: Graph) -> DataFrame:
    """``kmer, in_degree, out_degree`` over colors and neighbours, and the same over distinct neighbours."""
    count = lambda c, bits: F.bit_count(F.col(c).bitwiseAND(bits))
    n = graph.nodes.groupBy("kmer").agg(F.sum(count("edges", 0xF0)).alias("in_degree"), F.sum(count("edges", 0x0F)).alias("out_degree"), F.bit_or("edges").alias("m"))
    return n.select("kmer", F.col("in_degree").cast("long"), F.col("out_degree").cast("long"), count("m", 0xF0).alias("n_before"), count("m", 0x0F).alias("n_after"))


def ends(graph: Graph) -> DataFrame:
    """``kmer, kind``: k-mers without an edge before (source), after (sink) or at all (isolated)."""
    d = degrees(graph)
    kind = F.when((F.col("n_before") == 0) & (F.col("n_after") == 0), "isolated").when(F.col("n_before") == 0, "source").when(F.col("n_after") == 0, "sink")
    return d.select("kmer", kind.alias("kind")).where("kind IS NOT NULL")


def neighbours(graph: Graph) -> DataFrame:
    """``kmer, neighbour``: distinct canonical neighbours on either side, over all colors."""
    m = graph.nodes.groupBy("kmer").agg(F.bit_or("edges").alias("edges"))
    both = F.concat(dna.successors("kmer", "edges", graph.k), dna.predecessors("kmer", "edges", graph.k))
    return m.select("kmer", F.explode(both).alias("n")).select("kmer", dna.canonical("n").alias("neighbour")).distinct()


def edge_colors(graph: Graph) -> DataFrame:
    """``src, dst, colors``: the colors of each edge from a canonical string, as text in order."""
    return edges_out(graph).groupBy("src", "dst").agg(F.concat_ws(",", F.sort_array(F.collect_set("color"))).alias("colors"))


def keep_color(graph: Graph, color: int, self_loops: bool = False) -> Graph:
    """Edges of one color, without loops unless asked, and the k-mers they touch; coverage keeps all colors."""
    e = canonical_edges(graph).where(F.col("color") == color)
    if not self_loops:
        e = e.where("a <> b")
    touched = e.select(F.explode(F.array("a", "b")).alias("kmer")).distinct()
    return graph.with_nodes(graph.nodes.join(touched, "kmer", "left_semi").withColumn("edges", F.when(F.col("color") == color, F.col("edges")).otherwise(0)))


def colors_present(graph: Graph) -> DataFrame:
    """``kmer, colors``: colors with coverage, as text in order."""
    return graph.nodes.where("coverage > 0").groupBy("kmer").agg(F.concat_ws(",", F.sort_array(F.collect_set("color"))).alias("colors"))


def without(graph: Graph, kmers: DataFrame) -> Graph:
    """The graph less some k-mers (either strand): their rows go, and the flags of neighbours that name them."""
    gone = kmers.select(dna.canonical("kmer").alias("kmer")).distinct()
    kept = graph.nodes.join(gone, "kmer", "left_anti")
    # flags to clear: from each removed k-mer's own flags to its neighbours
    lost = graph.nodes.join(gone, "kmer", "left_semi").groupBy("kmer").agg(F.bit_or("edges").alias("edges"))
    clear = back_flags(lost, graph.k).groupBy("kmer").agg(F.bit_or("flag").alias("clear"))
    nodes = kept.join(clear, "kmer", "left").withColumn("edges", F.col("edges").bitwiseAND(F.bitwise_not(F.coalesce("clear", F.lit(0))))).drop("clear")
    return graph.with_nodes(nodes)


def back_flags(nodes: DataFrame, k: int, *keep: str) -> DataFrame:
    """``kmer, flag, keep...``: for each edge of ``nodes (kmer, edges)`` the flag of the far end that points back."""
    both = F.array(F.struct(F.col("kmer").alias("node"), F.col("edges").alias("m")), F.struct(dna.revcomp("kmer").alias("node"), dna.swap("edges").alias("m")))
    o = nodes.select(F.explode(both).alias("o"), *keep).select("o.node", F.explode(dna.successors("o.node", "o.m", k)).alias("dst"), *keep)
    flag = dna.flag(F.substring("node", 1, 1), dna.BEFORE)
    return o.select(dna.canonical("dst").alias("kmer"), dna.strand_mask(flag, dna.is_canonical("dst")).alias("flag"), *keep)


def upsert(graph: Graph, rows: DataFrame) -> Graph:
    """Rows by (k-mer, color), the new ones in place of the old."""
    return graph.with_nodes(graph.nodes.join(rows.select("kmer").distinct(), "kmer", "left_anti").unionByName(rows))


def compose(left: Graph, right: Graph) -> Graph:
    """Both graphs; where both have a k-mer, the right one's rows stand."""
    return upsert(left, right.nodes)


def change_edges(graph: Graph, pairs: DataFrame, connect: bool) -> Graph:
    """Set or clear the flags at both ends of ``pairs (a, b, color)``.

    A pair is joined in every strand in which its ends share k - 1 bases. k-mers that are not in
    the graph do not change it.
    """
    k = graph.k
    strands = lambda c: F.array(F.col(c), dna.revcomp(c))
    p = pairs.select(F.explode(strands("a")).alias("x"), "b", "color").select("x", F.explode(strands("b")).alias("y"), "color").where(F.substring("x", 2, k - 1) == F.substring("y", 1, k - 1))
    out = p.select(dna.canonical("x").alias("kmer"), "color", dna.strand_mask(dna.flag(F.substring("y", k, 1), dna.AFTER), dna.is_canonical("x")).alias("flag"))
    back = p.select(dna.canonical("y").alias("kmer"), "color", dna.strand_mask(dna.flag(F.substring("x", 1, 1), dna.BEFORE), dna.is_canonical("y")).alias("flag"))
    delta = out.unionByName(back).groupBy("kmer", "color").agg(F.bit_or("flag").alias("flag"))
    flag = F.coalesce("flag", F.lit(0))
    new = F.col("edges").bitwiseOR(flag) if connect else F.col("edges").bitwiseAND(F.bitwise_not(flag))
    return graph.with_nodes(graph.nodes.join(delta, ["kmer", "color"], "left").withColumn("edges", new).drop("flag"))


def one_sided_edges(graph: Graph) -> DataFrame:
    """``kmer, color, missing``: flags that the other end of an edge implies and that are not set."""
    implied = back_flags(graph.nodes.select("kmer", "edges", "color"), graph.k, "color").groupBy("kmer", "color").agg(F.bit_or("flag").alias("implied"))
    j = implied.join(graph.nodes, ["kmer", "color"])
    return j.select("kmer", "color", F.col("implied").bitwiseAND(F.bitwise_not("edges")).alias("missing")).where("missing <> 0")


def boundary(graph: Graph, collected: DataFrame) -> Graph:
    """Collected k-mers with the neighbours just outside them as empty k-mers.

    An added k-mer has coverage 1 in every color and only flags that point back to the collected.
    """
    inside = graph.nodes.join(collected.select("kmer").distinct(), "kmer", "left_semi")
    flags = back_flags(inside.select("kmer", "edges", "color"), graph.k, "color").groupBy("kmer", "color").agg(F.bit_or("flag").alias("edges"))
    outside = flags.join(collected.select("kmer").distinct(), "kmer", "left_anti")
    colors = F.explode(F.sequence(F.lit(0), F.lit(graph.num_colors - 1))).alias("color")
    full = outside.select("kmer").distinct().select("kmer", colors)
    added = full.join(outside, ["kmer", "color"], "left").select("kmer", F.col("color").cast("int"), F.lit(1).cast("long").alias("coverage"), F.coalesce("edges", F.lit(0)).alias("edges"))
    return graph.with_nodes(inside.unionByName(added))


def text_lines(graph: Graph) -> DataFrame:
    """``line``: k-mer, coverages, edge strings, over the colors."""
    from ..plans.graph import to_wide

    w = to_wide(graph)
    return w.select(F.concat_ws(" ", "kmer", F.array_join(F.transform("coverage", lambda c: c.cast("string")), " "), F.array_join(F.transform("edges", dna.edge_string), " ")).alias("line"))
