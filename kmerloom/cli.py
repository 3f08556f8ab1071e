"""Command line: view, traverse, subgraph, prune and assemble graphs in files."""

from __future__ import annotations

import argparse
import logging
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import dna
from .operators import lookup, paths, traverse, unitigs, views
from .plans import graph as g
from .sources import binary, text

#: Exit code of a passed path budget.
MAX_PATHS_EXCEEDED = 64


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    loud = shared.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true")
    loud.add_argument("-s", "--silent", action="store_true")
    shared.add_argument("-o", "--out", default="-")
    top = argparse.ArgumentParser(prog="kmerloom")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)

    view = commands.add_parser("view").add_subparsers(dest="what", required=True)
    p = view.add_parser("graph", parents=[shared])
    p.add_argument("graph")
    p.add_argument("--kmers", action="store_true")
    p = view.add_parser("contig", parents=[shared])
    p.add_argument("graph")
    p.add_argument("contig")
    p = commands.add_parser("traverse", parents=[shared])
    p.add_argument("graph")
    p.add_argument("--to-json", action="store_true")
    p.add_argument("--seed-strings", nargs="*", default=[])
    p.add_argument("--color", type=int)
    p.add_argument("--max-paths", type=int, default=0)
    p.add_argument("--graph-index", type=int, default=0)
    p.add_argument("--extra-start-kmer")
    p.add_argument("--links-file")
    p = commands.add_parser("subgraph", parents=[shared])
    p.add_argument("contig")
    p.add_argument("--graphs", nargs="+", required=True)
    p.add_argument("--orientation", choices=["original", "reverse", "both"], default="both")
    p.add_argument("-c", "--colors", nargs="*", type=int)
    p.add_argument("--initial-fasta", action="store_true")
    p.add_argument("--max-nodes", type=int)
    p = commands.add_parser("prune", parents=[shared])
    p.add_argument("graph")
    p.add_argument("-t", "--remove-tips", type=int, required=True)
    p = commands.add_parser("assemble", parents=[shared])
    p.add_argument("graph")
    p.add_argument("fasta")
    p.add_argument("--color", type=int)
    p.add_argument("--max-nodes", type=int, default=1000)
    return top


def load(spark: SparkSession, path: str) -> g.Graph:
    """A graph file; ``-`` is standard input, spooled to a file first."""
    if path == "-":
        with tempfile.NamedTemporaryFile(delete=False, suffix=".graph") as f:
            f.write(sys.stdin.buffer.read())
        path = f.name
    return binary.read_graph_file(spark, path)


def say(lines: DataFrame, column: str, out: str, order: str | None = None) -> None:
    rows = (lines.orderBy(order) if order else lines).select(column).toLocalIterator()
    stream = sys.stdout if out == "-" else open(out, "w", encoding="utf-8")  # noqa: SIM115
    try:
        for row in rows:
            print(row[0], file=stream)
    finally:
        if out != "-":
            stream.close()


def save(graph: g.Graph, out: str) -> None:
    if out != "-":
        binary.write_graph_file(graph, out)
        return
    with tempfile.NamedTemporaryFile(suffix=".graph") as f:
        binary.write_graph_file(graph, f.name)
        sys.stdout.buffer.write(f.read())


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "view" and args.what == "graph":
        graph = load(spark, args.graph)
        if args.kmers:
            records = text.kmer_records(graph)
            say(text.fasta_lines(records.orderBy("id")), "value", args.out)
        else:
            say(views.text_lines(graph), "line", args.out, "line")
    elif args.command == "view":
        contig = spark.createDataFrame([(0, args.contig)], "contig_id int, seq string")
        say(lookup.contig_lines(load(spark, args.graph), contig), "line", args.out, "pos")
    elif args.command == "traverse":
        graph = load(spark, args.graph)
        if args.color is not None:
            graph = views.keep_color(graph, args.color)
        if args.to_json:
            say(text.unitig_json(unitigs.find_unitigs(graph, "all")), "json", args.out, "part")
            return 0
        links = text.read_links(spark, args.links_file) if args.links_file else None
        try:
            found = paths.simple_paths(graph, [s[i : i + graph.k] for s in args.seed_strings for i in range(len(s) - graph.k + 1)], links, args.extra_start_kmer, args.max_paths or None)
        except traverse.BudgetExceeded as e:
            print(e, file=sys.stderr)
            return MAX_PATHS_EXCEEDED
        say(text.fasta_lines(paths.numbered(found, args.graph_index)), "value", args.out)
    elif args.command == "subgraph":
        graph = g.merge(*[load(spark, p) for p in args.graphs])
        seeds = text.read_fasta(spark, args.contig).select("seq") if args.initial_fasta else spark.createDataFrame([(args.contig,)], "seq string")
        found = traverse.explore(graph, seeds, args.orientation, tuple(args.colors) if args.colors else None, args.max_nodes)
        save(views.boundary(graph, found), args.out)
    elif args.command == "prune":
        if args.remove_tips < 2:
            print("tips must be shorter than 2 at least", file=sys.stderr)
            return 1
        save(traverse.prune_tips(load(spark, args.graph), args.remove_tips), args.out)
    else:
        graph = load(spark, args.graph)
        seeds = text.read_fasta(spark, args.fasta).select("seq")
        found = traverse.explore(graph, seeds, "both", (args.color,) if args.color is not None else None, args.max_nodes)
        part = graph.with_nodes(graph.nodes.join(found, "kmer", "left_semi"))
        first = seeds.select(F.explode(dna.kmer_array("seq", graph.k)).alias("node"))
        result = paths.simple_paths(part, first)
        say(text.fasta_lines(paths.numbered(result, None)), "value", args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING if args.silent else logging.INFO)
    spark = SparkSession.builder.appName("kmerloom").getOrCreate()
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
