"""The colored graph as a DataFrame, and its construction from reads.

Long form, the working form: one row per (canonical k-mer, color), ``kmer, color, coverage,
edges``. Wide form, the file form: one row per k-mer with arrays over the colors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, dna


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    k: int
    samples: tuple[str, ...]
    #: ``color, text`` of which the nodes are counted, where these are not changed since.
    source: DataFrame | None = None

    @property
    def num_colors(self) -> int:
        return len(self.samples)

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes, source=None)


def sequences(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, seq``: the letters acgt of each text, in capitals."""
    seq = F.upper(F.regexp_replace(F.col("text"), "[^ACGTacgt]+", ""))
    return docs.select("doc_id", "lang", seq.alias("seq"))


def kmer_rows(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """``keep..., pos, kmer, before, after`` of every k-mer of ``reads (seq)``."""
    return reads.where(F.length("seq") >= k).select(*keep, F.explode(dna.occurrences("seq", k)).alias("o")).select(*keep, "o.*")


def coded(reads: DataFrame, k: int) -> DataFrame:
    """Partial counts of ``reads (color, seq)``: ``w0, ..., color, coverage, edges`` of two-bit codes.

    Each occurrence brings one to the coverage of its canonical k-mer and the flags of its two
    neighbours, turned to the strand of that k-mer. A sequence shorter than k has no k-mer, nor
    has a window with a letter other than ACGT.
    """
    rows = reads.where("color IS NOT NULL AND seq IS NOT NULL").select(F.col("color").cast("int").alias("color"), "seq")
    return rows.mapInArrow(codes.counter(dna.checked_k(k)), codes.schema(k))


def summed(partial: DataFrame, k: int) -> DataFrame:
    """``kmer, color, coverage, edges`` of partial counts; one shuffle, of integers."""
    nodes = partial.groupBy(*codes.names(k), "color").agg(F.sum("coverage").alias("coverage"), F.bit_or("edges").alias("edges"))
    return nodes.select(codes.text(k).alias("kmer"), "color", "coverage", "edges")


def build(reads: DataFrame, k: int, samples: tuple[str, ...]) -> Graph:
    """A graph of ``reads (color, seq)``; see :func:`coded`. Text is made only of what is aggregated."""
    return Graph(summed(coded(reads, k), k), k, tuple(samples))


def read_graph(spark, reads: list[tuple[str, str]], k: int) -> Graph:
    """A graph of literal ``(sample, seq)`` reads; colors in the order of first mention."""
    samples = tuple(dict.fromkeys(s for s, _ in reads))
    rows = [(samples.index(s), q) for s, q in reads]
    return build(spark.createDataFrame(rows, "color int, seq string"), k, samples)


def text_graph(spark, lines: list[str], k: int) -> Graph:
    """A graph of literal lines ``KMER coverage... edges...``; edge fields left out are empty."""
    rows, colors = [], 0
    for line in lines:
        kmer, *fields = line.split()
        edges = [f for f in fields if len(f) == 8 and not f.isdigit()]
        coverage = [int(f) for f in fields[: len(fields) - len(edges)]]
        colors = max(colors, len(coverage))
        rows += [(kmer, c, coverage[c], edges[c] if c < len(edges) else "." * 8) for c in range(len(coverage))]
    nodes = spark.createDataFrame(rows, "kmer string, color int, coverage long, e string").select("kmer", "color", "coverage", dna.mask_of_string("e").alias("edges"))
    return Graph(nodes, k, tuple(f"sample_{c}" for c in range(colors)))


def to_wide(graph: Graph) -> DataFrame:
    """``kmer, coverage array, edges array``; colors without a row are zero."""
    byte = F.map_from_entries(F.collect_list(F.struct("color", F.struct("coverage", "edges"))))
    rows = graph.nodes.groupBy("kmer", "color").agg(F.sum("coverage").alias("coverage"), F.bit_or("edges").alias("edges")).groupBy("kmer").agg(byte.alias("m"))
    colors = F.sequence(F.lit(0), F.lit(graph.num_colors - 1))
    pick = lambda field: F.transform(colors, lambda c: F.coalesce(F.element_at("m", c.cast("int"))[field], F.lit(0)))
    return rows.select("kmer", pick("coverage").cast("array<long>").alias("coverage"), pick("edges").cast("array<int>").alias("edges"))


def from_wide(wide: DataFrame, k: int, samples: tuple[str, ...]) -> Graph:
    rows = wide.select("kmer", F.posexplode(F.arrays_zip("coverage", "edges")).alias("color", "v")).select("kmer", "color", "v.coverage", "v.edges")
    return Graph(rows.where("coverage > 0 OR edges <> 0"), k, samples)


def merge(*graphs: Graph) -> Graph:
    """All colors of all graphs side by side; a k-mer that a graph lacks has zeros in its colors.

    In the long form a full outer join over any number of graphs is a union with shifted colors.
    """
    if len({g.k for g in graphs}) != 1:
        raise ValueError("graphs of different k cannot be merged")
    nodes, shift = None, 0
    for g in graphs:
        part = g.nodes.withColumn("color", (F.col("color") + shift).cast("int"))
        nodes = part if nodes is None else nodes.unionByName(part)
        shift += g.num_colors
    return Graph(nodes, graphs[0].k, sum((g.samples for g in graphs), ()))


def validate(graph: Graph) -> DataFrame:
    """Rows that break the data model, with the reason; none in a sound graph."""
    n = graph.nodes
    reasons = [
        (F.length("kmer") != graph.k, "length"), (~F.col("kmer").rlike("^[ACGT]+$"), "letters"), (~dna.is_canonical("kmer"), "not canonical"),
        ((F.col("color") < 0) | (F.col("color") >= graph.num_colors), "color"), ((F.col("coverage") < 0) | (F.col("coverage") > 4294967295), "coverage"), ((F.col("edges") < 0) | (F.col("edges") > 255), "edges"),
    ]
    reason = F.lit(None).cast("string")
    for test, name in reversed(reasons):
        reason = F.when(test, name).otherwise(reason)
    broken = n.withColumn("reason", reason).where("reason IS NOT NULL")
    # a k-mer needs coverage in some color
    empty = n.groupBy("kmer").agg(F.max("coverage").alias("most")).where("most = 0").select("kmer")
    return broken.unionByName(n.join(empty, "kmer", "left_semi").withColumn("reason", F.lit("no coverage")).select(broken.columns))
