"""Components, strand orientation, exploration and tips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.graph import Graph
from ..plans import compact
from ..plans import local as one_task
from ..plans.persist import written
from .unitigs import BlockUnitigs, Unitigs, find_unitigs
from .views import degrees, without


class BudgetExceeded(ValueError):
    """A limit on nodes or paths was passed."""


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` of ``nodes (id)``: the least id reachable over ``edges (a, b)``, by rounds of joins."""
    plain = written(edges.select("a", "b").distinct(), "edges")
    wide = plain.schema["a"].dataType.simpleString() == "string"
    if one_task.is_small(plain, one_task.ONE_TASK if wide else one_task.ONE_TASK_PAIRS):
        found = one_task.components(plain)
        return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    edges = plain
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("heard")).withColumnRenamed("a", "id")
        step = labels.join(heard, "id", "left").select("id", F.least("component", F.coalesce("heard", "component")).alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        step = written(step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("beyond", "next")).alias("component"), "was"), "labels")
        labels = step.select("id", "component")
        if step.where("component <> was").isEmpty():
            return labels


def oriented_components(u: Unitigs) -> DataFrame:
    """``head, component, label``: components of oriented unitigs; the label is their least string."""
    e = u.edges().select(F.col("src").alias("a"), F.col("dst").alias("b"))
    c = components(u.unitigs.select(F.col("head").alias("id")), e).withColumnRenamed("id", "head").join(u.unitigs.select("head", "least_node"), "head")
    return c.join(c.groupBy("component").agg(F.min("least_node").alias("label")), "component").select("head", "component", "label")


def chosen_strands(u: BlockUnitigs, seeds: list[str] | DataFrame | None = None) -> DataFrame:
    """``head, component, non_orientable, halved``: the strands that :func:`orient` takes.

    Of a unitig that cannot be oriented both are there, halved: only their canonical k-mers count.
    """
    c, wanted = oriented_components(u), F.lit(1)
    if isinstance(seeds, DataFrame) or seeds:
        if not isinstance(seeds, DataFrame):
            seeds = u.strands.sparkSession.createDataFrame([(s,) for s in seeds], "node string")
        first = u.having(seeds).join(c, "head").select("component").distinct().withColumn("seeded", F.lit(True))
        c = c.join(first, "component", "left")
        wanted = F.when(F.coalesce("seeded", F.lit(False)), 0).otherwise(1)
    c = written(c.withColumn("w", wanted).join(u.strands.select("head", F.least("head", "twin").alias("unitig")), "head").select("unitig", "w", "label", "head", "component"), "strands")
    best = c.groupBy("unitig").agg(F.min(F.struct("w", "label", "head")).alias("c"), (F.min("component") == F.max("component")).alias("non_orientable"))
    taken = c.join(best, "unitig").where(F.col("non_orientable") | (F.col("head") == F.col("c.head")))
    return taken.select("head", "component", "non_orientable", F.col("non_orientable").alias("halved"))


def orient(u: Unitigs, seeds: list[str] | DataFrame | None = None) -> DataFrame:
    """``node, kmer, head, component, non_orientable``: one strand of each k-mer, so that overlaps read as plain strings.

    Each component exists on both strands; that with a seed in it is taken, else that with its
    least string (which is the canonical form of its least k-mer). A component that meets its own
    reverse cannot be oriented: its k-mers keep their canonical strand and are marked. Seeds are
    strings, or a table of them in ``node``.
    """
    if isinstance(u, BlockUnitigs):
        return u.spelled(chosen_strands(u, seeds)).select("node", "kmer", "head", "component", "non_orientable")
    c = oriented_components(u)
    m = u.members.join(c, "head")
    wanted = F.lit(1)
    if isinstance(seeds, DataFrame) or seeds:
        seeded = m.join(seeds.select("node").distinct(), "node", "left_semi") if isinstance(seeds, DataFrame) else m.where(F.col("node").isin(seeds))
        first = seeded.groupBy("component").agg(F.lit(True).alias("seeded"))
        m = m.join(first, "component", "left")
        wanted = F.when(F.coalesce("seeded", F.lit(False)), 0).otherwise(1)
    choice = F.struct(wanted.alias("w"), F.col("label").alias("label"), (F.col("node") != F.col("kmer")).alias("reverse"), F.col("node").alias("node"), F.col("head").alias("head"), F.col("component").alias("component"))
    best = m.groupBy("kmer").agg(F.min(choice).alias("c"), F.min("component").alias("x"), F.max("component").alias("y"))
    # an oriented k-mer and its reverse in one component
    return best.select("c.node", "kmer", "c.head", "c.component", (F.col("x") == F.col("y")).alias("non_orientable"))


def restricted(graph: Graph, colors: tuple[int, ...] | None) -> Graph:
    return graph if colors is None else graph.with_nodes(graph.nodes.where(F.col("color").isin(list(colors))))


def _kmers_of(u: Unitigs, heads: DataFrame) -> DataFrame:
    """``kmer``: canonical k-mers of unitigs, each once."""
    if not isinstance(u, BlockUnitigs):
        return u.members.join(heads, "head", "left_semi").select("kmer").distinct()
    one = u.strands.select("head", F.least("head", "twin").alias("unitig")).join(heads, "head", "left_semi").select(F.col("unitig").alias("head")).distinct()
    return compact.spelled(u.strands.select("head", "contig").join(one, "head"), u.graph.k, "kmer string")


def _reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``id``: what one step or more over ``edges (a, b)`` reaches from ``starts (id)``."""
    if edges.schema["a"].dataType.simpleString() == "bigint" and one_task.is_small(edges, one_task.ONE_TASK_PAIRS):
        return one_task.reached(edges, starts)
    step = lambda of: of.select(F.col("id").alias("a")).join(edges, "a").select(F.col("b").alias("id")).distinct()
    seen = frontier = written(step(starts), "frontier")
    while not frontier.isEmpty():
        frontier = written(step(frontier).join(seen, "id", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def explore(graph: Graph, seeds: DataFrame, orientation: str = "both", colors: tuple[int, ...] | None = None, max_nodes: int | None = None) -> DataFrame:
    """``kmer``: k-mers reachable from the seed strings ``(seq)`` over edges of the given colors.

    ``original`` follows successors in the strand of the seed, ``reverse`` predecessors, ``both``
    takes whole components. Runs without branches are passed in one step. Seed k-mers that the
    graph lacks are ignored. Raises BudgetExceeded if there are more than ``max_nodes``.
    """
    u = find_unitigs(restricted(graph, colors))
    start = seeds.select(F.explode(dna.kmer_array("seq", graph.k)).alias("node")).distinct()
    if orientation == "both":
        c = oriented_components(u)
        hit = u.having(start).select("head").distinct().join(c, "head").select("component").distinct()
        heads = c.join(hit, "component", "left_semi").select("head")
        reached = _kmers_of(u, heads)
    else:
        if orientation == "reverse":
            start = start.select(dna.revcomp("node").alias("node"))
        elif orientation != "original":
            raise ValueError(f"orientation must be original, reverse or both, not {orientation}")
        at = written(u.having(start).groupBy("head").agg(F.min("pos").alias("from")), "seeds")
        edges = written(u.edges().select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "unitig-edges")
        seen = written(_reached(edges, at.select(F.col("head").alias("id"))).withColumnRenamed("id", "head"), "seen")
        partly = at.join(seen, "head", "left_anti")
        if isinstance(u, BlockUnitigs):
            rows = compact.spelled(u.strands.select("head", "contig").join(partly, "head"), graph.k, "pos long, kmer string, from long").where("pos >= from").select("kmer")
        else:
            rows = u.members.join(partly, "head").where("pos >= from").select("kmer")
        reached = rows.unionByName(_kmers_of(u, seen)).distinct()
    if max_nodes is not None:
        reached = written(reached, "reached")
        found = reached.count()
        if found > max_nodes:
            raise BudgetExceeded(f"Max nodes ({max_nodes}) exceeded: {found} nodes found")
    return reached


def tips(graph: Graph, n: int) -> DataFrame:
    """``kmer``: k-mers of tips shorter than n.

    From each dead end the walk goes inwards over distinct neighbours. It ends at a k-mer with
    more than one neighbour on either side, which is not part of the tip; met within n steps, all
    before it is a tip. A walk that simply ends is a tip if it has at most n k-mers.
    """
    if graph.source is not None and compact.fits(graph):
        return _tips_of_unitigs(BlockUnitigs(graph), n)
    d = degrees(graph).select("kmer", "n_before", "n_after").join(graph.nodes.groupBy("kmer").agg(F.bit_or("edges").alias("m")), "kmer")
    strand = lambda node, b, a, m: F.struct(node.alias("node"), b.alias("before"), a.alias("after"), m.alias("m"))
    c = F.col
    both = F.explode(F.array(strand(c("kmer"), c("n_before"), c("n_after"), c("m")), strand(dna.revcomp("kmer"), c("n_after"), c("n_before"), dna.swap("m"))))
    o = d.select("kmer", both.alias("o")).select("kmer", "o.*")
    o = written(o.select("node", "kmer", "before", "after", F.get(dna.successors("node", "m", graph.k), F.lit(0)).alias("next")), "strands")
    walk = o.where("before = 0").select(F.col("node").alias("start"), "node", F.array().cast("array<string>").alias("tip"))
    found = None
    for _ in range(n):
        here = walk.join(o, "node", "left")
        branch = F.coalesce((F.col("before") > 1) | (F.col("after") > 1), F.lit(False))
        absent = F.col("kmer").isNull()
        ended = here.where(branch | absent).select("tip")
        on = here.where(~branch & ~absent).select("start", F.col("next").alias("node"), F.array_append("tip", F.col("kmer")).alias("tip"))
        on = written(on, "walk")
        ended = ended.unionByName(on.where("node IS NULL").select("tip"))
        found = ended if found is None else found.unionByName(ended)
        walk = on.where("node IS NOT NULL")
    # the step after the last: a walk whose next k-mer is not in the graph has ended as well
    last = walk.join(o.select("node"), "node", "left_anti").select("tip")
    found = last if found is None else found.unionByName(last)
    return found.select(F.explode("tip").alias("kmer")).distinct()


def _tips_of_unitigs(u: BlockUnitigs, n: int) -> DataFrame:
    """The same over unitigs: within one a walk meets no branch but at the last k-mer.

    Flags of reads are set at both ends of an edge, so that a walk comes to the first k-mer of the next.
    """
    k = u.graph.k
    all_ = written(compact.ends(u.strands, k, u.graph.num_colors, n), "ends")
    none = F.array().cast("array<string>")
    here = all_.where("n_before = 0 AND n_kmers <= :n".replace(":n", str(n))).select(F.lit(0).cast("long").alias("used"), none.alias("tip"), F.lit(True).alias("present"), *[c for c in all_.columns if c != "head"])
    found = None
    while True:
        c, last = F.col, F.col("used") + F.col("n_kmers")
        cut = lambda m: F.array_append("tip", F.substring(c("contig"), F.lit(1), (m + (k - 1)).cast("int")))
        stopped = ~c("present") | (c("n_before") > 1) & (c("used") < n)
        inside = c("present") & (c("n_before") <= 1) & (c("used") < n) & (last <= n)
        tip = F.when(stopped, c("tip")).when(inside & (c("n_after") > 1), cut(c("n_kmers") - 1)).when(inside & (c("n_after") == 0), cut(c("n_kmers")))
        state = written(here.select(tip.alias("done"), F.when(inside & (c("n_after") == 1), cut(c("n_kmers"))).alias("tip"), last.alias("used"), "next"), "walks")
        ended = state.where("done IS NOT NULL").select(F.explode("done").alias("seq"))
        found = ended if found is None else found.unionByName(ended)
        on = state.where("tip IS NOT NULL").select("used", "tip", F.col("next").alias("head"))
        count = on.count()
        if not count:
            return found.select(F.explode(dna.kmer_array("seq", k)).alias("kmer")).select(dna.canonical("kmer").alias("kmer")).distinct()
        if count <= one_task.ONE_TASK:
            # of the strands only those that a walk comes to
            met = all_.join(F.broadcast(on.select("head").distinct()), "head", "left_semi")
        else:
            met = all_
        here = on.join(met.withColumn("present", F.lit(True)), "head", "left").drop("head").withColumn("present", F.coalesce("present", F.lit(False)))


#: K-mers to remove that each task may know.
KNOWN = 4_000_000


def prune_tips(graph: Graph, n: int) -> Graph:
    """The graph without its tips, all of them found before any is removed."""
    if n < 2:
        raise ValueError("tips must be shorter than 2 at least")
    gone = tips(graph, n)
    if graph.source is not None and compact.fits(graph):
        gone = written(gone, "tips")
        if one_task.is_small(gone, KNOWN):
            codes = gone.select(dna.pack("kmer").alias("code")).toPandas()["code"].to_numpy("int64")
            return graph.with_nodes(compact.without(graph, codes))
    return without(graph, gone)
