"""Registered queries against DuckDB on the smallest tables, where these are at hand."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from kmerloom import registry

from . import conftest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(frame, columns):
    return sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", ["kmer_color_coverage", "graph_view_text", "consistent_edges", "overlay_delete", "color_filter", "unitig_edges", "subgraph_forward", "tips", "graph_validate", "contig_edges", "boundary_annotation", "sorted_rank", "file_lookup"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    expected = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", ["dna_sequences", "kmer_color_coverage", "graph_view_text", "contig_retrieve", "contig_neighbourhood", "contig_neighbourhood_nodes", "fasta_roundtrip", "links_roundtrip"])
def test_documents_of_any_language_or_none_are_in(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'pt' ELSE lang END AS lang) FROM '{SF}/documents.parquet') TO '{tmp_path}/documents.parquet'")
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    expected = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns) and rows(got, columns) == rows(expected, columns)


#: Queries whose working tables have a row for each unitig or dead end, not for each k-mer (66,257 here).
COMPACT = ["unitig_strings", "prune_tips", "tips", "simple_paths", "unitig_json", "consistent_orientation", "subgraph_forward", "subgraph_both", "unitig_edges", "cycle_unitigs", "unitig_coverage", "fasta_paths", "subgraph_reverse", "max_nodes_guard"]


@pytest.mark.parametrize("name", COMPACT)
def test_no_table_of_single_kmers_is_written(spark, tmp_path, monkeypatch, name):
    import pyarrow.parquet as pq

    from kmerloom.plans import persist

    monkeypatch.setattr(persist, "shared_root", lambda _: f"file://{tmp_path}")
    entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert max(sum(pq.ParquetFile(f).metadata.num_rows for f in folder.glob("*.parquet")) for folder in tmp_path.iterdir()) < 5000


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(registry.queries()) > 50


def test_entry(spark):
    assert entry.entry(spark).columns == ["line"]


def test_queries_are_listed_without_the_llm_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(conftest.ROOT, copy, ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__", ".pytest_cache")])
    code = "import __spark_entry__ as e; q = e.queries(); assert e.oracle_sql().keys() <= q.keys(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(registry.queries())), "False", "False"]
