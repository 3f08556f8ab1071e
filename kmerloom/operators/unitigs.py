"""Maximal unbranched runs of k-mers.

For k up to 31 they are made of blocks of two-bit k-mers (``plans.compact``), beyond it by pointer
doubling over oriented k-mers as text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..plans import compact
from ..plans import local as one_task
from ..plans.graph import Graph, to_wide
from ..plans.persist import written
from .views import oriented_edges


def oriented_summary(graph: Graph) -> DataFrame:
    """Both strands of each k-mer: ``node, kmer, present, after, before, has_before, has_after``.

    ``present`` lists the colors with coverage. ``after`` is the one base that follows in all
    present colors, null if there is none, more than one, or another color has an edge there.
    """
    covered = F.col("coverage") > 0
    half = lambda bits: F.when(covered, F.col("edges").bitwiseAND(bits))
    n = graph.nodes.groupBy("kmer").agg(
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(covered, F.col("color"))))).alias("present"),
        F.min(half(0x0F)).alias("a0"), F.max(half(0x0F)).alias("a1"), F.min(half(0xF0)).alias("b0"), F.max(half(0xF0)).alias("b1"),
        F.coalesce(F.bit_or(F.when(~covered, F.col("edges"))), F.lit(0)).alias("other"), F.bit_or("edges").alias("any"),
    )
    letter = lambda mask, flags: F.coalesce(*[F.when(mask == v, b) for b, v in flags.items()])
    after = F.when((F.col("a0") == F.col("a1")) & (F.col("other").bitwiseAND(0x0F) == 0), letter(F.col("a0"), dna.AFTER))
    before = F.when((F.col("b0") == F.col("b1")) & (F.col("other").bitwiseAND(0xF0) == 0), letter(F.col("b0"), dna.BEFORE))
    n = n.select("kmer", "present", after.alias("after"), before.alias("before"), (F.col("any").bitwiseAND(0xF0) != 0).alias("hb"), (F.col("any").bitwiseAND(0x0F) != 0).alias("ha"))
    one = lambda node, a, b, hb, ha: F.struct(node.alias("node"), a.alias("after"), b.alias("before"), hb.alias("has_before"), ha.alias("has_after"))
    c = F.col
    both = F.array(one(c("kmer"), c("after"), c("before"), c("hb"), c("ha")), one(dna.revcomp("kmer"), dna.revcomp("before"), dna.revcomp("after"), c("ha"), c("hb")))
    return n.select("kmer", "present", F.explode(both).alias("o")).select("o.node", "kmer", "present", "o.after", "o.before", "o.has_before", "o.has_after")


def _double(pointers: DataFrame) -> DataFrame:
    """``node, head, pos, low, done`` of ``node, ptr, weight``: distance to the head of the chain.

    ``ptr`` is the node before (null at a head) and ``weight`` the distance to it. Each round
    replaces a pointer by that of its target, so distances double. Members of cycles never find
    a head: they come back with done = false and the least node of the cycle.
    """
    if one_task.is_small(pointers):
        return one_task.chains(pointers)
    head = F.col("ptr").isNull()
    state = pointers.select("node", F.coalesce("ptr", "node").alias("head"), F.when(head, 0).otherwise(F.col("weight")).cast("long").alias("pos"), F.least("node", F.coalesce("ptr", "node")).alias("low"), head.alias("done"))
    state = written(state, "chains")
    finished, active = state.where("done"), state.where("NOT done")
    count, reach = active.count(), 1
    while count:
        beyond = finished.unionByName(active).select(F.col("node").alias("head"), F.col("head").alias("h2"), F.col("pos").alias("p2"), F.col("low").alias("l2"), F.col("done").alias("d2"))
        step = active.join(beyond, "head").select("node", F.col("h2").alias("head"), (F.col("pos") + F.col("p2")).alias("pos"), F.least("low", "l2").alias("low"), F.col("d2").alias("done"))
        step = written(step, "chains")
        finished = finished.unionByName(step.where("done"))
        active = step.where("NOT done")
        reach *= 2
        before, count = count, active.count()
        if count == before and reach > count:
            break
    return finished.unionByName(active)


#: Bases of the shortest words by which neighbouring k-mers come to one place.
MINIMIZER = 9


def minimizer(kmer: str, k: int) -> Column:
    """The least hash of the short words of either strand; neighbours mostly share it."""
    m = min(MINIMIZER, k)
    least = lambda c: F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda i: F.xxhash64(F.substring(c, i, F.lit(m)))))
    return F.least(least(F.col(kmer)), least(dna.revcomp(kmer)))


def _local_chains(batches):
    """Chains within one partition: ``node, ptr, lhead, lpos``; numpy doubling over its rows."""
    table = pa.Table.from_batches(list(batches))
    if not len(table):
        return
    node, ptr = table.column("node").combine_chunks(), table.column("ptr").combine_chunks()
    before = pc.fill_null(pc.index_in(ptr, value_set=node, skip_nulls=True), -1).to_numpy().astype(np.int64)
    n = len(before)
    jump, pos = np.where(before >= 0, before, np.arange(n)), (before >= 0).astype(np.int64)
    for _ in range(n.bit_length() + 1):
        pos, jump = pos + pos[jump], jump[jump]
    loop = before[jump] >= 0
    jump[loop], pos[loop] = np.flatnonzero(loop), 0
    yield pa.RecordBatch.from_arrays([node, ptr, node.take(pa.array(jump)), pa.array(pos)], names=["node", "ptr", "lhead", "lpos"])


def _rank(pointers: DataFrame, k: int) -> DataFrame:
    """``node, head, pos, done`` of ``node, kmer, ptr``: chains are first closed up within partitions.

    K-mers are dealt out by minimizer, so most pointers stay in a partition; what is doubled
    across the cluster are only the heads of these local chains.
    """
    pointers = written(pointers, "pointers")
    if one_task.is_small(pointers):
        return one_task.chains(pointers.withColumn("weight", F.lit(1))).select("node", "head", "pos", "done")
    dealt = pointers.withColumn("part", minimizer("kmer", k)).repartition("part").select("node", "ptr")
    local = written(dealt.mapInArrow(_local_chains, "node string, ptr string, lhead string, lpos long"), "local-chains")
    heads = local.where("node = lhead").select("node", "ptr")
    before = local.select(F.col("node").alias("ptr"), "lhead", (F.col("lpos") + 1).alias("weight"))
    across = heads.join(before, "ptr", "left").select("node", F.col("lhead").alias("ptr"), "weight")
    ranked = _double(written(across, "chain-heads")).select(F.col("node").alias("lhead"), "head", F.col("pos").alias("hpos"), "done")
    return local.join(ranked, "lhead").select("node", "head", (F.col("lpos") + F.col("hpos")).alias("pos"), "done")


@dataclass(frozen=True)
class Unitigs:
    """``members``: ``head, pos, node, kmer, is_cycle`` of oriented unitigs, both strands of each;
    ``unitigs``: ``head, left_node, right_node, contig, repr, n_kmers, is_cycle, primary``."""

    graph: Graph
    members: DataFrame
    unitigs: DataFrame

    def primary(self) -> DataFrame:
        """One strand of every unitig."""
        return self.unitigs.where("primary").drop("primary", "head")

    def edges(self) -> DataFrame:
        """``src, dst, color`` between oriented unitigs, named by their heads; loops only of cycles."""
        e = oriented_edges(self.graph)
        right = self.unitigs.select(F.col("right_node").alias("src"), F.col("head").alias("u"), "is_cycle")
        left = self.unitigs.select(F.col("left_node").alias("dst"), F.col("head").alias("v"))
        return e.join(right, "src").join(left, "dst").where("u <> v OR is_cycle").select(F.col("u").alias("src"), F.col("v").alias("dst"), "color")

    def coverage(self) -> DataFrame:
        """``contig, coverage``: per k-mer in order, per color."""
        w = to_wide(self.graph).select("kmer", "coverage")
        m = self.members.join(self.unitigs.where("primary").select("head", "contig"), "head").join(w, "kmer")
        rows = m.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("pos", "coverage"))).alias("r"))
        return rows.select("contig", F.col("r.coverage").alias("coverage"))

    def totals(self) -> DataFrame:
        """``contig, coverage``: summed over its k-mers, per color."""
        add = lambda i: F.aggregate("coverage", F.lit(0).cast("long"), lambda a, row: a + row[i])
        return self.coverage().select("contig", F.array(*[add(i) for i in range(self.graph.num_colors)]).alias("coverage"))

    def named_edges(self) -> DataFrame:
        """``a, b, color``: the edges with the strings of the unitigs."""
        name = self.unitigs.select("head", "contig")
        e = self.edges().join(name.withColumnsRenamed({"head": "src", "contig": "a"}), "src").join(name.withColumnsRenamed({"head": "dst", "contig": "b"}), "dst")
        return e.select("a", "b", "color")

    def having(self, nodes: DataFrame) -> DataFrame:
        """``head, pos`` of the members among ``nodes (node)``."""
        return self.members.join(nodes.select("node").distinct(), "node", "left_semi").select("head", "pos")

    def spelled(self, chosen: DataFrame) -> DataFrame:
        """``node, kmer, ...`` of the members of ``chosen (head, halved, ...)``; halved ones have only canonical nodes."""
        return self.members.select("head", "pos", "node", "kmer").join(chosen, "head").where("NOT halved OR node = kmer")


class BlockUnitigs(Unitigs):
    """The same of ``strands`` by ``plans.compact``; heads are codes, which compare as the strings do."""

    def __init__(self, graph: Graph, mode: str = "none"):
        object.__setattr__(self, "graph", graph)
        object.__setattr__(self, "mode", mode)
        object.__setattr__(self, "strands", compact.strands(graph, mode))

    @property
    def members(self) -> DataFrame:
        return compact.spelled(self.strands, self.graph.k, "head long, pos long, node string, kmer string, is_cycle boolean")

    @property
    def unitigs(self) -> DataFrame:
        k, c = self.graph.k, F.col("contig")
        right = F.expr(f"right(contig, {k})")
        tail = F.when(F.col("has_before"), F.substring(c, k, 1 << 30)).otherwise(c)
        return self.strands.select("head", F.substring(c, 1, k).alias("left_node"), right.alias("right_node"), "contig", tail.alias("repr"), "n_kmers", "is_cycle", "primary", F.col("least").alias("least_node"))

    def edges(self) -> DataFrame:
        e = compact.out_edges(self.strands, self.graph.k, self.graph.num_colors)
        return e.join(self.strands.select(F.col("head").alias("next")), "next").where("src <> next OR src_cycle").select("src", F.col("next").alias("dst"), "color")

    def coverage(self) -> DataFrame:
        return compact.by_kmer(self.strands if self.mode == "all" else compact.strands(self.graph, "all"), self.graph.num_colors)

    def totals(self) -> DataFrame:
        return compact.totals(self.strands if self.mode == "sum" else compact.strands(self.graph, "sum"), self.graph.num_colors)

    def having(self, nodes: DataFrame) -> DataFrame:
        fit = F.col("node").rlike(f"^[ACGT]{{{self.graph.k}}}$")
        return compact.holding(self.strands, self.graph.k, nodes.where(fit).select(dna.pack("node").alias("code")))

    def spelled(self, chosen: DataFrame) -> DataFrame:
        kept = [(f.name, f.dataType.simpleString()) for f in chosen.schema if f.name != "halved"]
        rows = self.strands.select("head", "contig").join(chosen, "head")
        return compact.spelled(rows, self.graph.k, ", ".join(f"{n} {t}" for n, t in [("node", "string"), ("kmer", "string"), *kept]), "halved")


def find_unitigs(graph: Graph, mode: str = "none") -> Unitigs:
    """Unitigs of all components; ``mode`` says what coverage is brought along: none, its sum or all.

    x and y are joined where all colors present in x, and no other, have exactly the edge to y,
    the same holds backwards, and the same colors are present in y. A k-mer never follows its
    own reverse. A cycle is cut at its least string. A collected run is as long as its unitig.
    """
    return BlockUnitigs(graph, mode) if compact.fits(graph) else _find_long(graph)


def _find_long(graph: Graph) -> Unitigs:
    """Unitigs for any k."""
    o = written(oriented_summary(graph), "oriented")
    k = graph.k
    x = o.where("after IS NOT NULL").select(F.col("node").alias("ptr"), F.concat(F.substring("node", 2, k - 1), "after").alias("node"), F.col("present").alias("px"), F.col("kmer").alias("kx"), F.substring("node", 1, 1).alias("first"))
    linked = o.select("node", "kmer", "present", "before").join(x, "node").where("before = first AND present = px AND kmer <> kx").select("node", "ptr")
    chains = written(_rank(o.select("node", "kmer").join(linked, "node", "left"), k), "ranked")
    lines = chains.where("done").select("node", "head", "pos", F.lit(False).alias("is_cycle"))
    loops = chains.where("NOT done").select("node")
    if not loops.isEmpty():
        weight = F.lit(1).alias("weight")
        loops = written(linked.join(loops, "node", "left_semi").select("node", "ptr", weight), "loops")
        low = _double(loops).select("node", "low")
        cut = loops.join(low, "node").select("node", F.when(F.col("node") != F.col("low"), F.col("ptr")).alias("ptr"), "weight")
        # twins of cycles: the one that holds the smaller string is primary
        lines = lines.unionByName(_double(cut).select("node", "head", "pos", F.lit(True).alias("is_cycle")))
    members = written(lines.join(o.select("node", "kmer", "has_before"), "node").select("head", "pos", "node", "kmer", "is_cycle", "has_before"), "members")
    runs = members.groupBy("head", "is_cycle").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("r"), F.max(F.when(F.col("pos") == 0, F.col("has_before"))).alias("has_before"), F.min("kmer").alias("least_kmer"), F.min("node").alias("least_node"))
    contig = F.concat(F.substring("head", 1, k - 1), F.array_join(F.transform("r.node", lambda n: F.substring(n, k, 1)), ""))
    u = runs.select("head", F.col("head").alias("left_node"), F.element_at("r.node", -1).alias("right_node"), contig.alias("contig"), F.size("r").cast("long").alias("n_kmers"), "is_cycle", "has_before", "least_kmer", "least_node")
    primary = F.when(F.col("is_cycle"), F.col("least_node") == F.col("least_kmer")).otherwise(F.col("contig") <= dna.revcomp("contig"))
    u = u.withColumn("repr", F.when(F.col("has_before"), F.substring("contig", k, 1 << 30)).otherwise(F.col("contig"))).withColumn("primary", primary)
    unitigs = written(u.select("head", "left_node", "right_node", "contig", "repr", "n_kmers", "is_cycle", "primary", "least_node"), "unitigs")
    return Unitigs(graph, members.drop("has_before"), unitigs)
