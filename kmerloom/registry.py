"""The registered graph queries, over the driver's tables, and the SQL they must equal.

Reads are the letters acgt of ``documents``; the language is the sample, and documents of no
language or of one without a color of its own share the last. ``benchmark`` brings contigs and
seeds. Every query reads its tables whole.
"""

from __future__ import annotations

import functools
import io
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import align, lookup, paths, traverse, unitigs, views
from .plans import graph as g
from .plans.persist import shared_root, written

LANGUAGES = ("de", "en", "es", "fr")
#: Colors of the graph: the last takes documents of every other language and of none.
SAMPLES = (*LANGUAGES, "other")
COLORS = len(SAMPLES)
#: k of scans and aggregates, and of operators that walk the graph.
K, LONG_K = 11, 31

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, k: int = K):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = _tables(k) + sql.replace("{k}", str(k))
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- inputs -------------------------------------------------------------------------------------


def reads(spark: SparkSession, sf: str) -> DataFrame:
    docs = g.sequences(spark.read.parquet(f"{sf}/documents.parquet"))
    return docs.select("doc_id", "lang", _color(), "seq")


def _color():
    own = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("lang")) - 1
    return F.when(F.col("lang").isin(*LANGUAGES), own).otherwise(len(LANGUAGES)).cast("int").alias("color")


def graph(spark: SparkSession, sf: str, k: int = K) -> g.Graph:
    """The graph of the reads; operators that take k-mers by blocks count them from the texts."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(_color(), "text")
    return replace(g.build(reads(spark, sf), k, SAMPLES), source=texts)


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("lang"), "text")
    return g.sequences(b).select(F.col("doc_id").alias("contig_id"), "seq")


def contig_graph(spark: SparkSession, sf: str, k: int = K) -> g.Graph:
    return g.build(contigs(spark, sf).select(F.lit(0).alias("color"), "seq"), k, ("benchmark",))


# --- SQL fragments ------------------------------------------------------------------------------


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _canon(x: str) -> str:
    return f"least({x}, {_rc(x)})"


def _swap(x: str) -> str:
    return f"(((({x}) << 4) | (({x}) >> 4)) & 255)"


def _turn(mask: str, x: str) -> str:
    return f"CASE WHEN {x} <= {_rc(x)} THEN {mask} ELSE {_swap(mask)} END"


_AFTER = "(VALUES ('A', 1), ('C', 2), ('G', 4), ('T', 8)) v(b, bit)"
_BEFORE_OF = "CASE substr({x}, 1, 1) WHEN 'A' THEN 128 WHEN 'C' THEN 64 WHEN 'G' THEN 32 WHEN 'T' THEN 16 END"


def _shown(m: str) -> str:
    bits = [(128, "a"), (64, "c"), (32, "g"), (16, "t"), (1, "A"), (2, "C"), (4, "G"), (8, "T")]
    return "(" + " || ".join(f"CASE WHEN {m} & {b} <> 0 THEN '{x}' ELSE '.' END" for b, x in bits) + ")"


def _oriented(source: str, keep: str = "") -> str:
    keep = f", {keep}" if keep else ""
    return f"(SELECT kmer AS node, kmer{keep}, edges FROM {source} UNION ALL SELECT {_rc('kmer')}, kmer{keep}, {_swap('edges')} FROM {source})"


def _back(source: str, keep: str = "") -> str:
    """Flags of the far ends of all edges of a relation (kmer, edges)."""
    kept = f", {keep}" if keep else ""
    return f"""(SELECT {_canon('dst')} AS kmer, {_turn('flag', 'dst')} AS flag{kept} FROM (
      SELECT substr(node, 2) || b AS dst, {_BEFORE_OF.replace('{x}', 'node')} AS flag{kept} FROM {_oriented(source, keep)} JOIN {_AFTER} ON edges & bit <> 0))"""


def _tables(k: int) -> str:
    def occurrences(source: str, keep: str) -> str:
        return f"""SELECT {keep}, pos, substr(seq, pos, {k}) AS kmer, CASE WHEN pos > 1 THEN substr(seq, pos - 1, 1) ELSE '' END AS before, substr(seq, pos + {k}, 1) AS after
      FROM (SELECT {keep}, seq, unnest(range(1, length(seq) - {k} + 2))::INTEGER AS pos FROM {source} WHERE length(seq) >= {k})"""

    seen = "(CASE before WHEN 'A' THEN 128 WHEN 'C' THEN 64 WHEN 'G' THEN 32 WHEN 'T' THEN 16 ELSE 0 END | CASE after WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END)"
    letters = "regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g')"
    return f"""WITH RECURSIVE dna AS (SELECT doc_id, lang, {letters} AS seq FROM documents),
    occ AS ({occurrences('dna', 'doc_id, lang')}),
    g AS MATERIALIZED (SELECT {_canon('kmer')} AS kmer, (CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END)::INTEGER AS color, count(*) AS coverage, bit_or({_turn(seen, 'kmer')})::INTEGER AS edges FROM occ GROUP BY ALL),
    ctg AS (SELECT item_id AS contig_id, {letters} AS seq FROM benchmark),
    cocc AS ({occurrences('ctg', 'contig_id')}),
    cg AS MATERIALIZED (SELECT {_canon('kmer')} AS kmer, 0 AS color, count(*) AS coverage, bit_or({_turn(seen, 'kmer')})::INTEGER AS edges FROM cocc GROUP BY ALL),
    """


def _wide(source: str, colors: int) -> str:
    cols = ", ".join(f"coalesce(max(coverage) FILTER (color = {c}), 0) AS c{c}, coalesce(max(edges) FILTER (color = {c}), 0)::INTEGER AS e{c}" for c in range(colors))
    return f"(SELECT kmer, {cols} FROM {source} GROUP BY kmer)"


# --- strings and k-mers -------------------------------------------------------------------------


@query("x AS (SELECT 1) SELECT doc_id, lang, seq FROM dna")
def dna_sequences(spark, sf):
    return reads(spark, sf).select("doc_id", "lang", "seq")


@query("x AS (SELECT 1) SELECT doc_id, pos, kmer FROM occ")
def kmerize(spark, sf):
    return g.kmer_rows(reads(spark, sf), K, "doc_id").select("doc_id", "pos", "kmer")


@query(f"d AS (SELECT DISTINCT kmer FROM occ) SELECT kmer, {_rc('kmer')} AS rc, {_canon('kmer')} AS canonical, kmer <= {_rc('kmer')} AS is_canonical FROM d")
def revcomp_canonical(spark, sf):
    d = g.kmer_rows(reads(spark, sf), K, "doc_id").select("kmer").distinct()
    return d.select("kmer", dna.revcomp("kmer").alias("rc"), dna.canonical("kmer").alias("canonical"), dna.is_canonical("kmer").alias("is_canonical"))


@query("d AS (SELECT DISTINCT kmer FROM g) SELECT kmer, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(kmer, ''), lambda c: (instr('ACGT', c) - 1)::BIGINT)), lambda a, x: a * 4 + x) AS code, kmer AS unpacked FROM d")
def kmer_pack_2bit(spark, sf):
    d = graph(spark, sf).nodes.select("kmer").distinct().withColumn("code", dna.pack("kmer"))
    return d.select("kmer", "code", dna.unpack("code", K).alias("unpacked"))


# --- construction and aggregates ----------------------------------------------------------------


@query("x AS (SELECT 1) SELECT kmer, color, coverage FROM g")
def kmer_color_coverage(spark, sf):
    return graph(spark, sf).nodes.select("kmer", "color", "coverage")


@query("x AS (SELECT 1) SELECT kmer, sum(coverage)::BIGINT AS coverage, count(*) AS colors FROM g GROUP BY kmer")
def kmer_coverage(spark, sf):
    return graph(spark, sf).nodes.groupBy("kmer").agg(F.sum("coverage").alias("coverage"), F.count("*").alias("colors"))


@query("x AS (SELECT 1) SELECT color, count(*) AS kmers, sum(coverage)::BIGINT AS coverage, sum(bit_count(edges))::BIGINT AS flags FROM g GROUP BY color")
def graph_totals(spark, sf):
    return graph(spark, sf).nodes.groupBy("color").agg(F.count("*").alias("kmers"), F.sum("coverage").alias("coverage"), F.sum(F.bit_count("edges")).alias("flags"))


@query("x AS (SELECT 1) SELECT count(DISTINCT kmer) AS kmers FROM g")
def kmer_count_distinct(spark, sf):
    return graph(spark, sf).nodes.select("kmer").distinct().agg(F.count("*").alias("kmers"))


@query("x AS (SELECT 1) SELECT kmer, color, edges FROM g")
def edge_masks(spark, sf):
    return graph(spark, sf).nodes.select("kmer", "color", "edges")


@query(f"x AS (SELECT 1) SELECT kmer, color, {_shown('edges')} AS shown, {'reverse(translate(' + _shown('edges') + chr(44) + chr(39) + 'ACGTacgt' + chr(39) + chr(44) + chr(39) + 'TGCAtgca' + chr(39) + '))'} AS reversed FROM g")
def edge_strings(spark, sf):
    return graph(spark, sf).nodes.select("kmer", "color", dna.edge_string("edges").alias("shown"), dna.edge_string_revcomp("edges").alias("reversed"))


@query(f"w AS {_wide('g', COLORS)} SELECT concat_ws(' ', kmer, {', '.join(f'c{c}' for c in range(COLORS))}, {', '.join(_shown(f'e{c}') for c in range(COLORS))}) AS line FROM w")
def graph_view_text(spark, sf):
    return views.text_lines(graph(spark, sf))


@query("d AS (SELECT DISTINCT kmer FROM g) SELECT row_number() OVER (ORDER BY kmer) - 1 AS id, kmer AS seq FROM d")
def graph_fasta_kmers(spark, sf):
    from .sources.text import kmer_records

    return kmer_records(graph(spark, sf))


@query(f"""x AS (SELECT kmer, color, coverage, edges, unnest(range(0, 8)) AS way FROM g),
y AS (SELECT CASE way WHEN 1 THEN substr(kmer, 2) WHEN 2 THEN 'N' || substr(kmer, 2) WHEN 3 THEN {_rc('kmer')} WHEN 7 THEN 'A' || substr(kmer, 1, {{k}} - 2) || 'A' ELSE kmer END AS kmer,
  CASE way WHEN 4 THEN color + 5 ELSE color END AS color, CASE way WHEN 5 THEN -coverage WHEN 7 THEN 0 ELSE coverage END AS coverage, CASE way WHEN 6 THEN edges + 256 ELSE edges END AS edges, way FROM x),
z AS (SELECT DISTINCT kmer, color, coverage, edges FROM y WHERE way <> 7 UNION ALL SELECT DISTINCT kmer, color, coverage, 0 FROM y WHERE way = 7 AND kmer = {_canon('kmer')} AND kmer NOT IN (SELECT kmer FROM g)),
v AS (SELECT kmer, color, list_filter([CASE WHEN length(kmer) <> {{k}} THEN 'length' END, CASE WHEN regexp_matches(kmer, '[^ACGT]') THEN 'letters' END, CASE WHEN kmer > {_rc('kmer')} THEN 'not canonical' END, CASE WHEN color NOT IN (0, 1, 2, 3, 4) THEN 'color' END, CASE WHEN coverage < 0 OR coverage >= 4294967296 THEN 'coverage' END, CASE WHEN edges NOT BETWEEN 0 AND 255 THEN 'edges' END], lambda r: r IS NOT NULL)[1] AS reason FROM z)
SELECT kmer, color::INTEGER AS color, reason FROM v WHERE reason IS NOT NULL UNION ALL SELECT kmer, color, 'no coverage' FROM z WHERE kmer IN (SELECT kmer FROM z GROUP BY kmer HAVING max(coverage) = 0)""")
def graph_validate(spark, sf):
    """The graph with rows that break each rule: those are found and no others."""
    base = graph(spark, sf)
    n, c = base.nodes, F.col
    broken = [
        n, n.withColumn("kmer", F.substring("kmer", 2, K)), n.withColumn("kmer", F.concat(F.lit("N"), F.substring("kmer", 2, K))), n.withColumn("kmer", dna.revcomp("kmer")),
        n.withColumn("color", c("color") + COLORS), n.withColumn("coverage", -c("coverage")), n.withColumn("edges", c("edges") + 256),
    ]
    rows = functools.reduce(DataFrame.unionByName, broken).distinct()
    absent = n.select(F.concat(F.lit("A"), F.substring("kmer", 1, K - 2), F.lit("A")).alias("kmer"), "color", F.lit(0).cast("long").alias("coverage"), F.lit(0).alias("edges")).distinct()
    rows = rows.unionByName(absent.where(dna.is_canonical("kmer")).join(n.select("kmer"), "kmer", "left_anti"))
    return g.validate(base.with_nodes(rows)).select("kmer", "color", "reason")


# --- views --------------------------------------------------------------------------------------

_OUT = f"(SELECT kmer AS src, substr(kmer, 2) || b AS dst, color FROM g JOIN {_AFTER} ON edges & bit <> 0)"
_ORIENTED_EDGES = f"(SELECT node AS src, substr(node, 2) || b AS dst, color FROM {_oriented('g', 'color')} JOIN {_AFTER} ON edges & bit <> 0 WHERE {_canon('substr(node, 2) || b')} IN (SELECT kmer FROM g))"
_DEGREE = "(SELECT kmer, sum(bit_count(edges & 240))::BIGINT AS in_degree, sum(bit_count(edges & 15))::BIGINT AS out_degree, bit_count(bit_or(edges) & 240)::INTEGER AS n_before, bit_count(bit_or(edges) & 15)::INTEGER AS n_after FROM g GROUP BY kmer)"


@query(f"x AS (SELECT 1) SELECT * FROM {_OUT}")
def out_edges(spark, sf):
    return views.edges_out(graph(spark, sf))


@query("x AS (SELECT 1) SELECT b || substr(kmer, 1, {k} - 1) AS src, kmer AS dst, color FROM g JOIN (VALUES ('A', 128), ('C', 64), ('G', 32), ('T', 16)) v(b, bit) ON edges & bit <> 0")
def in_edges(spark, sf):
    return views.edges_in(graph(spark, sf))


@query(f"x AS (SELECT 1) SELECT * FROM {_ORIENTED_EDGES}")
def consistent_edges(spark, sf):
    return views.oriented_edges(graph(spark, sf))


@query(f"e AS (SELECT {_canon('src')} AS x, {_canon('dst')} AS y, color, (src <= {_rc('src')}) <> (dst <= {_rc('dst')}) AS flipped FROM {_ORIENTED_EDGES}) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, color, flipped FROM e")
def canonical_edges(spark, sf):
    return views.canonical_edges(graph(spark, sf))


@query(f"x AS (SELECT 1) SELECT * FROM {_DEGREE}")
def degrees(spark, sf):
    return views.degrees(graph(spark, sf))


@query(f"x AS (SELECT 1) SELECT kmer, CASE WHEN n_before = 0 AND n_after = 0 THEN 'isolated' WHEN n_before = 0 THEN 'source' ELSE 'sink' END AS kind FROM {_DEGREE} WHERE n_before = 0 OR n_after = 0")
def sources_sinks(spark, sf):
    return views.ends(graph(spark, sf))


@query(f"x AS (SELECT 1) SELECT kmer, n_before, n_after FROM {_DEGREE} WHERE n_before > 1 OR n_after > 1")
def branch_kmers(spark, sf):
    return views.degrees(graph(spark, sf)).where("n_before > 1 OR n_after > 1").select("kmer", "n_before", "n_after")


@query(f"x AS (SELECT 1) SELECT DISTINCT kmer, {_canon('substr(node, 2) || b')} AS neighbour FROM {_oriented('g')} JOIN {_AFTER} ON edges & bit <> 0")
def neighbors_distinct(spark, sf):
    return views.neighbours(graph(spark, sf))


@query(f"x AS (SELECT 1) SELECT src, dst, string_agg(DISTINCT color::VARCHAR, ',' ORDER BY color::VARCHAR) AS colors FROM {_OUT} GROUP BY src, dst")
def edge_colors(spark, sf):
    return views.edge_colors(graph(spark, sf))


@query(f"""e AS (SELECT {_canon('src')} AS x, {_canon('dst')} AS y FROM {_ORIENTED_EDGES} WHERE color = 1), t AS (SELECT x AS kmer FROM e WHERE x <> y UNION SELECT y FROM e WHERE x <> y)
SELECT kmer, color, coverage, CASE WHEN color = 1 THEN edges ELSE 0 END AS edges FROM g WHERE kmer IN (SELECT kmer FROM t)""")
def color_filter(spark, sf):
    return views.keep_color(graph(spark, sf), 1).nodes


@query("x AS (SELECT 1) SELECT kmer, string_agg(color::VARCHAR, ',' ORDER BY color) AS colors FROM g WHERE coverage > 0 GROUP BY kmer")
def non_missing_colors(spark, sf):
    return views.colors_present(graph(spark, sf))


@query(f"x AS (SELECT 1), b AS (SELECT kmer, color, bit_or(flag) AS implied FROM {_back('g', 'color')} GROUP BY ALL) SELECT kmer, color, implied & ~edges AS missing FROM b JOIN g USING (kmer, color) WHERE implied & ~edges <> 0")
def edge_symmetry_check(spark, sf):
    return views.one_sided_edges(graph(spark, sf))


# --- lookups ------------------------------------------------------------------------------------


@query("x AS (SELECT 1) SELECT kmer, color, coverage, edges FROM g WHERE kmer IN ('AAAAAAAAAAA', 'ATATATATATA')")
def point_lookup(spark, sf):
    graph_ = graph(spark, sf)
    graph_ = graph_.with_nodes(written(graph_.nodes, "graph"))
    return lookup.by_string(graph_, "AAAAAAAAAAA").unionByName(lookup.by_either_strand(graph_, "TATATATATAT"))


@query(f"x AS (SELECT 1) SELECT kmer, color, coverage, edges FROM g WHERE kmer IN (SELECT {_canon('kmer')} FROM cocc)")
def seed_lookup(spark, sf):
    return lookup.by_seeds(graph(spark, sf), contigs(spark, sf))


@query("d AS (SELECT DISTINCT kmer, true AS here FROM g UNION ALL SELECT kmer, false FROM (SELECT DISTINCT kmer FROM cocc)), r AS (SELECT kmer, here, sum(here::INTEGER) OVER (ORDER BY kmer RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - max(here::INTEGER) OVER (PARTITION BY kmer) AS n FROM d) SELECT kmer AS probe, n::BIGINT AS rank FROM r WHERE NOT here")
def sorted_rank(spark, sf):
    probes = g.kmer_rows(contigs(spark, sf), K, "contig_id").select(F.col("kmer").alias("probe"))
    return lookup.ranks(graph(spark, sf), probes)


@query(f"u AS (SELECT * FROM g UNION ALL SELECT kmer, {COLORS}, coverage, edges FROM cg) SELECT kmer, {', '.join(f'c{c}, e{c}' for c in range(COLORS + 1))} FROM {_wide('u', COLORS + 1)}")
def merge_graphs_full_outer(spark, sf):
    w = g.to_wide(g.merge(graph(spark, sf), contig_graph(spark, sf)))
    return w.select("kmer", *[x for c in range(COLORS + 1) for x in (F.col("coverage")[c].alias(f"c{c}"), F.col("edges")[c].alias(f"e{c}"))])


@query(f"""gone AS (SELECT DISTINCT {_canon('kmer')} AS kmer FROM cocc), lost AS (SELECT kmer, bit_or(edges) AS edges FROM g WHERE kmer IN (SELECT kmer FROM gone) GROUP BY kmer),
clear AS (SELECT kmer, bit_or(flag) AS clear FROM {_back('lost')} GROUP BY kmer) SELECT kmer, color, coverage, (edges & ~coalesce(clear, 0))::INTEGER AS edges FROM g LEFT JOIN clear USING (kmer) WHERE kmer NOT IN (SELECT kmer FROM gone)""")
def overlay_delete(spark, sf):
    gone = g.kmer_rows(contigs(spark, sf), K, "contig_id").select("kmer")
    return views.without(graph(spark, sf), gone).nodes


@query("x AS (SELECT 1) SELECT * FROM g WHERE kmer NOT IN (SELECT kmer FROM cg) UNION ALL SELECT * FROM cg")
def overlay_upsert(spark, sf):
    return views.upsert(graph(spark, sf), contig_graph(spark, sf).nodes).nodes


@query("x AS (SELECT 1) SELECT kmer, count(*) AS colors, sum(coverage)::BIGINT AS coverage FROM (SELECT * FROM cg WHERE kmer NOT IN (SELECT kmer FROM g) UNION ALL SELECT * FROM g) GROUP BY kmer")
def compose_graphs(spark, sf):
    both = views.compose(contig_graph(spark, sf), graph(spark, sf))
    return both.nodes.groupBy("kmer").agg(F.count("*").alias("colors"), F.sum("coverage").alias("coverage"))


_OWN = f"own AS (SELECT contig_id, {_canon('kmer')} AS kmer, count(*) AS n FROM cocc GROUP BY ALL), w AS {_wide('g', COLORS)}, m AS (SELECT contig_id, {_canon('kmer')} AS kmer, bit_or({_turn('(CASE before WHEN ' + chr(39) + 'A' + chr(39) + ' THEN 128 WHEN ' + chr(39) + 'C' + chr(39) + ' THEN 64 WHEN ' + chr(39) + 'G' + chr(39) + ' THEN 32 WHEN ' + chr(39) + 'T' + chr(39) + ' THEN 16 ELSE 0 END | CASE after WHEN ' + chr(39) + 'A' + chr(39) + ' THEN 1 WHEN ' + chr(39) + 'C' + chr(39) + ' THEN 2 WHEN ' + chr(39) + 'G' + chr(39) + ' THEN 4 WHEN ' + chr(39) + 'T' + chr(39) + ' THEN 8 ELSE 0 END)', 'kmer')})::INTEGER AS mask FROM cocc GROUP BY ALL)"


@query(f"{_OWN} SELECT c.contig_id, c.pos, c.kmer AS query, own.kmer, {', '.join(f'coalesce(c{i}, 0) AS c{i}, coalesce(e{i}, 0) AS e{i}' for i in range(COLORS))}, own.n AS c{COLORS}, m.mask AS e{COLORS} FROM cocc c JOIN own ON own.contig_id = c.contig_id AND own.kmer = {_canon('c.kmer')} JOIN m ON m.contig_id = own.contig_id AND m.kmer = own.kmer LEFT JOIN w ON w.kmer = own.kmer")
def contig_retrieve(spark, sf):
    r = lookup.retrieve(graph(spark, sf), contigs(spark, sf))
    return r.select("contig_id", "pos", "query", "kmer", *[x for c in range(COLORS + 1) for x in (F.col("coverage")[c].alias(f"c{c}"), F.col("edges")[c].alias(f"e{c}"))])


def _line(mask: str) -> str:
    return f"CASE WHEN own.kmer = c.kmer THEN {_shown(mask)} ELSE reverse(translate({_shown(mask)}, 'ACGTacgt', 'TGCAtgca')) END"


@query(f"{_OWN} SELECT c.contig_id, c.pos, concat_ws(' ', own.kmer || ':', c.kmer, {', '.join(f'coalesce(c{i}, 0)' for i in range(COLORS))}, own.n, {', '.join(_line(f'coalesce(e{i}, 0)') for i in range(COLORS))}, {_line('m.mask')}) AS line FROM cocc c JOIN own ON own.contig_id = c.contig_id AND own.kmer = {_canon('c.kmer')} JOIN m ON m.contig_id = own.contig_id AND m.kmer = own.kmer LEFT JOIN w ON w.kmer = own.kmer")
def contig_edges(spark, sf):
    return lookup.contig_lines(graph(spark, sf), contigs(spark, sf))


_AROUND = f"""ori AS (SELECT * FROM {_oriented('g', 'color')} WHERE node IN (SELECT kmer FROM cocc)),
around AS (SELECT node AS src, substr(node, 2) || b AS dst, color FROM ori JOIN {_AFTER} ON edges & bit <> 0
  UNION SELECT b || substr(node, 1, {{k}} - 1), node, color FROM ori JOIN (VALUES ('A', 128), ('C', 64), ('G', 32), ('T', 16)) v(b, bit) ON edges & bit <> 0
  UNION SELECT x.kmer, y.kmer, {COLORS} FROM cocc x JOIN cocc y ON x.contig_id = y.contig_id AND y.pos = x.pos + 1)"""


@query(f"{_AROUND} SELECT src, dst, color::INTEGER AS color FROM around")
def contig_neighbourhood(spark, sf):
    """Edges around all contigs, in their strand; their own edges have the last color."""
    return lookup.contig_graph(graph(spark, sf), contigs(spark, sf))[1].select("src", "dst", F.col("color").cast("int").alias("color"))


@query(f"""{_OWN}, {_AROUND}, ends AS (SELECT src AS node FROM around UNION SELECT dst FROM around)
SELECT DISTINCT c.kmer AS node, {', '.join(f'coalesce(c{i}, 0) AS c{i}' for i in range(COLORS))}, own.n AS c{COLORS} FROM cocc c JOIN own ON own.contig_id = c.contig_id AND own.kmer = {_canon('c.kmer')} LEFT JOIN w ON w.kmer = own.kmer
UNION ALL SELECT node, {', '.join('0' for _ in range(COLORS + 1))} FROM ends WHERE node NOT IN (SELECT kmer FROM cocc)""")
def contig_neighbourhood_nodes(spark, sf):
    """Nodes around all contigs with their coverage; zeros off the contigs."""
    nodes = lookup.contig_graph(graph(spark, sf), contigs(spark, sf))[0]
    return nodes.select("node", *[F.col("coverage")[c].alias(f"c{c}") for c in range(COLORS + 1)])


@query(f"x AS (SELECT 1) SELECT DISTINCT contig_id, {_canon('kmer')} AS kmer FROM cocc WHERE {_canon('kmer')} NOT IN (SELECT kmer FROM g)", LONG_K)
def contig_missing(spark, sf):
    own = lookup.contig_kmers(contigs(spark, sf), LONG_K).select("contig_id", "kmer").distinct()
    return own.join(graph(spark, sf, LONG_K).nodes.select("kmer"), "kmer", "left_anti")


@query(f"""inside AS (SELECT kmer, color, coverage, edges FROM g WHERE kmer IN (SELECT kmer FROM cg)), f AS (SELECT kmer, color, bit_or(flag)::INTEGER AS edges FROM {_back('inside', 'color')} WHERE kmer NOT IN (SELECT kmer FROM cg) GROUP BY ALL)
SELECT * FROM inside UNION ALL SELECT d.kmer, c.color, 1, coalesce(f.edges, 0) FROM (SELECT DISTINCT kmer FROM f) d CROSS JOIN (SELECT unnest(range(0, {COLORS}))::INTEGER AS color) c LEFT JOIN f ON f.kmer = d.kmer AND f.color = c.color""")
def boundary_annotation(spark, sf):
    return views.boundary(graph(spark, sf), contig_graph(spark, sf).nodes).nodes


_PAIRS = f"p AS (SELECT x.kmer AS a, y.kmer AS b FROM cocc x JOIN cocc y ON x.contig_id = y.contig_id AND y.pos = x.pos + 1), s AS (SELECT x, y FROM (SELECT unnest([a, {_rc('a')}]) AS x, b FROM p) CROSS JOIN LATERAL (SELECT unnest([b, {_rc('b')}]) AS y) WHERE substr(x, 2) = substr(y, 1, {{k}} - 1)), delta AS (SELECT kmer, bit_or(flag) AS flag FROM (SELECT {_canon('x')} AS kmer, {_turn('(CASE substr(y, {k}, 1) WHEN ' + chr(39) + 'A' + chr(39) + ' THEN 1 WHEN ' + chr(39) + 'C' + chr(39) + ' THEN 2 WHEN ' + chr(39) + 'G' + chr(39) + ' THEN 4 ELSE 8 END)', 'x')} AS flag FROM s UNION ALL SELECT {_canon('y')}, {_turn('(' + _BEFORE_OF.replace('{x}', 'x') + ')', 'y')} FROM s) GROUP BY kmer)"


def _pairs(spark, sf):
    o = g.kmer_rows(contigs(spark, sf), K, "contig_id").where("after <> ''")
    return o.select(F.col("kmer").alias("a"), F.concat(F.substring("kmer", 2, K - 1), "after").alias("b"), F.lit(0).alias("color"))


@query(f"{_PAIRS} SELECT g.kmer, g.color, (CASE WHEN g.color = 0 THEN edges | coalesce(flag, 0) ELSE edges END)::INTEGER AS edges FROM g LEFT JOIN delta ON g.kmer = delta.kmer")
def connect_kmers(spark, sf):
    return views.change_edges(graph(spark, sf), _pairs(spark, sf), True).nodes.select("kmer", "color", "edges")


@query(f"{_PAIRS} SELECT g.kmer, g.color, (CASE WHEN g.color = 0 THEN edges & ~coalesce(flag, 0) ELSE edges END)::INTEGER AS edges FROM g LEFT JOIN delta ON g.kmer = delta.kmer")
def disconnect_kmers(spark, sf):
    return views.change_edges(graph(spark, sf), _pairs(spark, sf), False).nodes.select("kmer", "color", "edges")


# --- walks --------------------------------------------------------------------------------------

#: Doublings that close up every chain of the tables: chains are shorter than 2^DOUBLINGS.
DOUBLINGS = 17


def _doubled(name: str) -> str:
    """Tables name1, name2, ...: each replaces a pointer of the one before by that of its target."""
    return ", ".join(f"{name}{i + 1} AS MATERIALIZED (SELECT a.id, b.prev, a.pos + b.pos AS pos, least(a.low, b.low) AS low FROM {name}{i} a JOIN {name}{i} b ON b.id = a.prev)" for i in range(DOUBLINGS))


def _base(flags: dict[str, int], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {v} THEN '{b}'" for b, v in flags.items()) + " END"


_TURNED = "translate({}, 'ACGT', 'TGCA')"
# unitigs u (head, left_node, right_node, contig, repr, n_kmers, is_cycle, own), members m (head, id, pos) of oriented k-mers o
_UNITIG_SQL = f"""s AS (SELECT kmer, string_agg(color::VARCHAR, ',' ORDER BY color) AS present, min(edges & 15) AS a0, max(edges & 15) AS a1, min(edges & 240) AS b0, max(edges & 240) AS b1, bit_or(edges) AS every FROM g GROUP BY kmer),
h AS MATERIALIZED (SELECT kmer, present, CASE WHEN a0 = a1 THEN {_base(dna.AFTER, 'a0')} END AS after, CASE WHEN b0 = b1 THEN {_base(dna.BEFORE, 'b0')} END AS before, every & 240 <> 0 AS hb, every & 15 <> 0 AS ha FROM s),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY node) AS id, * FROM (SELECT kmer AS node, kmer, present, after, before, hb FROM h UNION ALL SELECT {_rc('kmer')}, kmer, present, {_TURNED.format('before')}, {_TURNED.format('after')}, ha FROM h)),
l AS (SELECT y.id, x.id AS prev FROM o x JOIN o y ON y.node = substr(x.node, 2) || x.after WHERE y.before = substr(x.node, 1, 1) AND y.present = x.present AND x.kmer <> y.kmer),
j0 AS MATERIALIZED (SELECT o.id, coalesce(l.prev, o.id) AS prev, (l.prev IS NOT NULL)::BIGINT AS pos, least(o.id, coalesce(l.prev, o.id)) AS low FROM o LEFT JOIN l USING (id)), {_doubled('j')},
ring AS MATERIALIZED (SELECT j.id, j.low FROM j{DOUBLINGS} j JOIN j0 r ON r.id = j.prev WHERE r.prev <> r.id),
c0 AS MATERIALIZED (SELECT j0.id, CASE WHEN j0.id = ring.low THEN j0.id ELSE prev END AS prev, (j0.id <> ring.low)::BIGINT AS pos, 0 AS low FROM j0 JOIN ring USING (id)), {_doubled('c')},
m AS MATERIALIZED (SELECT id, prev AS head, pos, false AS is_cycle FROM j{DOUBLINGS} WHERE NOT EXISTS (SELECT 1 FROM ring WHERE ring.id = j{DOUBLINGS}.id) UNION ALL SELECT id, prev, pos, true FROM c{DOUBLINGS}),
r AS (SELECT head, any_value(is_cycle) AS is_cycle, count(*) AS n_kmers, arg_max(node, pos) AS right_node, arg_min(node, pos) AS left_node, arg_min(hb, pos) AS hb, min(kmer) AS least_kmer, min(node) AS least_node, string_agg(substr(node, {{k}}, 1), '' ORDER BY pos) AS tail FROM m JOIN o USING (id) GROUP BY head),
w AS (SELECT *, substr(left_node, 1, {{k}} - 1) || tail AS contig FROM r),
u AS MATERIALIZED (SELECT head, left_node, right_node, contig, CASE WHEN hb THEN substr(contig, {{k}}) ELSE contig END AS repr, n_kmers, is_cycle, least_node, CASE WHEN is_cycle THEN least_node = least_kmer ELSE contig <= {_rc('contig')} END AS own FROM w),
x AS MATERIALIZED (SELECT a.head AS a, z.head AS z, a.contig AS from_contig, z.contig AS to_contig, color FROM {_oriented('g', 'color')} q JOIN u a ON a.right_node = q.node JOIN {_AFTER} ON q.edges & bit <> 0 JOIN u z ON z.left_node = substr(q.node, 2) || b WHERE a.head <> z.head OR a.is_cycle)"""
_COMPONENT_SQL = _UNITIG_SQL + """, y AS (SELECT a AS one, z AS two FROM x UNION SELECT z, a FROM x), t AS (SELECT head AS id, head AS low FROM u UNION SELECT y.two, t.low FROM t JOIN y ON y.one = t.id),
comp AS MATERIALIZED (SELECT id AS head, min(low) AS component FROM t GROUP BY id)"""
_HIT_SQL = _COMPONENT_SQL + ", found AS MATERIALIZED (SELECT DISTINCT o.kmer FROM m JOIN o USING (id) JOIN comp USING (head) WHERE component IN (SELECT component FROM comp JOIN m USING (head) JOIN o USING (id) JOIN (SELECT DISTINCT kmer AS node FROM cocc) USING (node)))"


def _way_sql(start: str) -> str:
    return _UNITIG_SQL + f""", at_ AS MATERIALIZED (SELECT head, min(pos) AS pos FROM m JOIN o USING (id) JOIN (SELECT DISTINCT {start} AS node FROM cocc) USING (node) GROUP BY head),
    f AS (SELECT z AS id FROM x JOIN at_ ON at_.head = x.a UNION SELECT x.z FROM f JOIN x ON x.a = f.id)
    SELECT kmer FROM m JOIN o USING (id) JOIN at_ USING (head) WHERE m.pos >= at_.pos UNION SELECT kmer FROM m JOIN o USING (id) WHERE head IN (SELECT id FROM f)"""


_TIP_SQL = f"""n AS (SELECT kmer, bit_or(edges) AS edges FROM g GROUP BY kmer),
p AS MATERIALIZED (SELECT node, kmer, bit_count((edges & 240)::INTEGER) AS before, bit_count((edges & 15)::INTEGER) AS after, substr(node, 2) || CASE WHEN edges & 1 <> 0 THEN 'A' WHEN edges & 2 <> 0 THEN 'C' WHEN edges & 4 <> 0 THEN 'G' WHEN edges & 8 <> 0 THEN 'T' END AS next FROM {_oriented('n')}),
t AS (SELECT 0 AS step, node, []::VARCHAR[] AS tip FROM p WHERE before = 0 UNION ALL SELECT step + 1, p.next, list_append(tip, p.kmer) FROM t JOIN p USING (node) WHERE step < 5 AND before <= 1 AND after <= 1),
tip AS MATERIALIZED (SELECT DISTINCT unnest(tip) AS kmer FROM t LEFT JOIN p USING (node) WHERE p.kmer IS NULL OR step < 5 AND (before > 1 OR after > 1))"""


def _unitigs(spark, sf, mode: str = "none") -> unitigs.Unitigs:
    return unitigs.find_unitigs(graph(spark, sf, LONG_K), mode)


@query(_UNITIG_SQL + " SELECT contig, repr, n_kmers, is_cycle FROM u WHERE own", LONG_K)
def unitig_strings(spark, sf):
    return _unitigs(spark, sf).primary().select("contig", "repr", "n_kmers", "is_cycle")


@query(_UNITIG_SQL + f" SELECT contig, {', '.join(f'coalesce(sum(coverage) FILTER (color = {c}), 0)::BIGINT AS c{c}' for c in range(COLORS))} FROM u JOIN m USING (head) JOIN o USING (id) JOIN g USING (kmer) WHERE own GROUP BY contig", LONG_K)
def unitig_coverage(spark, sf):
    c = _unitigs(spark, sf, "sum").totals()
    return c.select("contig", *[F.col("coverage")[i].alias(f"c{i}") for i in range(COLORS)])


@query(_UNITIG_SQL + " SELECT from_contig AS a, to_contig AS b, color FROM x", LONG_K)
def unitig_edges(spark, sf):
    return _unitigs(spark, sf).named_edges()


@query(_UNITIG_SQL + " SELECT contig, n_kmers FROM u WHERE own AND is_cycle", LONG_K)
def cycle_unitigs(spark, sf):
    return _unitigs(spark, sf).primary().where("is_cycle").select("contig", "n_kmers")


@query(_COMPONENT_SQL + ", label AS (SELECT component, min(least_node) AS label FROM comp JOIN u USING (head) GROUP BY component) SELECT arg_min(node, {'a': label, 'b': node <> kmer, 'c': node}) AS node, kmer, min(component) = max(component) AS non_orientable FROM m JOIN o USING (id) JOIN comp USING (head) JOIN label USING (component) GROUP BY kmer", LONG_K)
def consistent_orientation(spark, sf):
    return traverse.orient(_unitigs(spark, sf)).select("node", "kmer", "non_orientable")


@query()
def unitig_json(spark, sf):
    from .sources.text import unitig_json as to_json

    return to_json(_unitigs(spark, sf, "all"))


def _explore(way: str):
    def run(spark, sf):
        return traverse.explore(graph(spark, sf, LONG_K), contigs(spark, sf), way)

    run.__name__ = f"subgraph_{'forward' if way == 'original' else way}"
    return run


for _way, _sql in (("both", _HIT_SQL + " SELECT kmer FROM found"), ("original", _way_sql("kmer")), ("reverse", _way_sql(_rc("kmer")))):
    query(_sql, LONG_K)(_explore(_way))


@query(_HIT_SQL + " SELECT CASE WHEN count(*) > 1 THEN 'Max nodes (1) exceeded: ' || count(*) || ' nodes found' ELSE 'within budget' END AS message FROM found", LONG_K)
def max_nodes_guard(spark, sf):
    """The message of a budget that is too small, as a row."""
    base = graph(spark, sf, LONG_K)
    try:
        traverse.explore(base, contigs(spark, sf), "both", max_nodes=1)
        said = "within budget"
    except traverse.BudgetExceeded as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "message string")


@query(_TIP_SQL + " SELECT kmer FROM tip", LONG_K)
def tips(spark, sf):
    return traverse.tips(graph(spark, sf, LONG_K), 5)


@query(_TIP_SQL + f", lost AS (SELECT kmer, edges FROM n WHERE kmer IN (SELECT kmer FROM tip)), clear AS (SELECT kmer, bit_or(flag) AS clear FROM {_back('lost')} GROUP BY kmer) SELECT kmer, color, coverage, (edges & ~coalesce(clear, 0))::INTEGER AS edges FROM g LEFT JOIN clear USING (kmer) WHERE kmer NOT IN (SELECT kmer FROM tip)", LONG_K)
def prune_tips(spark, sf):
    return traverse.prune_tips(graph(spark, sf, LONG_K), 5).nodes


@query()
def simple_paths(spark, sf):
    """All paths: of components with more than 64 as the graph whose ways they are, of others one by one."""
    return paths.simple_paths(graph(spark, sf, LONG_K), component_paths=64)


@query()
def fasta_paths(spark, sf):
    from .sources.text import fasta_lines

    return fasta_lines(paths.numbered(written(simple_paths(spark, sf), "paths")))


@query()
def max_paths_guard(spark, sf):
    """The message of a path budget that is too small, as a row; the walk is over the contigs' graph."""
    base = contig_graph(spark, sf, LONG_K)
    try:
        paths.simple_paths(base.with_nodes(written(base.nodes, "graph")), max_paths=1)
        said = "within budget"
    except traverse.BudgetExceeded as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "message string")


@query()
def simple_paths_cut(spark, sf):
    return paths.simple_paths(g.read_graph(spark, [("s", "ACCCAAA")], 3), ["CCC"], extra_start="CCC").select("seq")


_LINKS = [("CAAAA", "F", 1, 1, "T"), ("TAAAA", "F", 1, 1, "C"), ("CCCCC", "R", 1, 1, "A"), ("AGGGG", "F", 1, 1, "G")]
_LINK_VALUES = ", ".join(f"('{a}', '{b}', {c}, {d}, '{e}')" for a, b, c, d, e in _LINKS)


@query(f"x AS (SELECT 1) SELECT * FROM (VALUES {_LINK_VALUES}) l(kmer, orientation, num_juncs, count, juncs)".replace("1, 1,", "1::INTEGER, 1::BIGINT,"))
def links_parse(spark, sf):
    from .sources.text import parse_links

    text = ["# comment", ""] + [line for kmer, way, n, count, juncs in _LINKS for line in (f"{kmer} 1", f"{way} {n} {count} {juncs}")]
    return parse_links(spark.createDataFrame(list(enumerate(text)), "line_no long, value string"))


@query(f"x AS (SELECT 1) SELECT kmer, orientation, substr(juncs, 1, 1) AS base, count(*) AS n FROM (VALUES {_LINK_VALUES}) l(kmer, orientation, num_juncs, count, juncs) GROUP BY ALL")
def link_next_bases(spark, sf):
    return links_parse(spark, sf).groupBy("kmer", "orientation", F.substring("juncs", 1, 1).alias("base")).agg(F.count("*").alias("n"))


@query("x AS (SELECT 1) SELECT * FROM (VALUES ('CAAAACCCCT'), ('TAAAACCCCC')) p(seq)")
def link_paths(spark, sf):
    tangle = g.read_graph(spark, [("s", "CAAAACCCCC"), ("s", "TAAAACCCCT")], 5)
    return paths.simple_paths(tangle, ["CAAAA"], links_parse(spark, sf)).select("seq")


@query()
def mosaic_align(spark, sf):
    """Each contig against all others."""
    rows = contigs(spark, sf).select(F.col("contig_id").alias("id"), "seq")
    return align.align_panel(rows, rows)


# --- files --------------------------------------------------------------------------------------


@query("x AS (SELECT 1) SELECT kmer, color, coverage, edges FROM g", LONG_K)
def binary_roundtrip(spark, sf):
    """Write the graph as a file, read it back in splits."""
    from .sources import binary

    path = f"{shared_root(spark)}/graph-{uuid.uuid4().hex}.bin"
    binary.write_graph_file(graph(spark, sf, LONG_K), path)
    return written(binary.read_graph_file(spark, path).nodes, "read-back")


@query(f"x AS (SELECT 1) SELECT kmer, {', '.join(f'c{c}, e{c}' for c in range(COLORS))} FROM {_wide('g', COLORS)} WHERE kmer IN ('AAAAAAAAAAA', 'ATATATATATA') OR kmer LIKE 'ACGT%'")
def file_lookup(spark, sf):
    """Write the graph as a file; its reader seeks single k-mers and those of a prefix."""
    from .sources import binary

    path = f"{shared_root(spark)}/graph-{uuid.uuid4().hex}.bin"
    binary.write_graph_file(graph(spark, sf), path)
    found = binary.find_kmers(spark, path, ["AAAAAAAAAAA", "ATATATATATA"]).unionByName(binary.read_wide(spark, path, prefix="ACGT"))
    return written(found.select("kmer", *[x for c in range(COLORS) for x in (F.col("coverage")[c].alias(f"c{c}"), F.col("edges")[c].alias(f"e{c}"))]), "read-back")


@query("x AS (SELECT 1) SELECT * FROM (VALUES (6, 31, 1, 5, 33)) h(version, k, words, colors, record_size)")
def header_roundtrip(spark, sf):
    from .sources import binary

    h = binary.Header.load(io.BytesIO(binary.Header(LONG_K, tuple(s.encode() for s in SAMPLES)).dump()))
    return spark.createDataFrame([(h.version, h.k, h.words, h.num_colors, h.record_size)], "version int, k int, words int, colors int, record_size int")


@query("x AS (SELECT 1) SELECT contig_id::VARCHAR AS seq_id, seq FROM ctg")
def fasta_roundtrip(spark, sf):
    """Write the contigs as gzip FASTA files, read them back."""
    from .sources import text

    path = f"{shared_root(spark)}/fasta-{uuid.uuid4().hex}"
    text.fasta_lines(contigs(spark, sf).withColumnRenamed("contig_id", "id")).write.option("compression", "gzip").text(path)
    return text.read_fasta(spark, path)


@query("x AS (SELECT 1) SELECT substr(seq, 1, {k}) AS kmer, 'F' AS orientation, (length(seq) - {k})::INTEGER AS num_juncs, 1::BIGINT AS count, substr(seq, {k} + 1) AS juncs FROM ctg WHERE length(seq) > {k}")
def links_roundtrip(spark, sf):
    """Write a gzip link file that leads along each contig, read it back. One file is one task by its format."""
    from .sources import text

    path = f"{shared_root(spark)}/links-{uuid.uuid4().hex}"
    kmer, juncs = F.substring("seq", 1, K), F.expr(f"substr(seq, {K + 1})")
    group = F.concat(kmer, F.lit(" 1\nF "), F.length(juncs).cast("string"), F.lit(" 1 "), juncs)
    lines = contigs(spark, sf).where(F.length("seq") > K).select(group.alias("value"))
    head = spark.createDataFrame([('{"graph": {"num_colours": 1}}',)], "value string")
    head.unionByName(lines).coalesce(1).write.option("compression", "gzip").text(path)
    return text.read_links(spark, path)


@query("x AS (SELECT 1) SELECT kmer, color, coverage, edges FROM g")
def stream_coverage(spark, sf):
    """The same graph from a stream of reads."""
    from .streaming.counts import count_folder

    source = written(reads(spark, sf).select("color", "seq"), "reads")
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    return count_folder(spark, folder, "color int, seq string", K)
