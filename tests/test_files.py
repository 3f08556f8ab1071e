"""Files, alignment, streaming and the command line."""

import gzip
import io
import json
import random

import pytest

from kmerloom import cli
from kmerloom.operators import align, unitigs
from kmerloom.plans import graph as g
from kmerloom.sources import binary, text
from kmerloom.streaming import counts

from .test_graph import lines, reads


def test_header_of_a_small_graph():
    h = binary.Header(3, (b"sample_0",), mean_read_lengths=(5,), total_sequence=(5,))
    back = binary.Header.load(io.BytesIO(h.dump()))
    assert back == h and back.size == len(h.dump())
    assert (back.version, back.record_size, back.words, back.mean_read_lengths, back.total_sequence) == (6, 13, 1, (5,), (5,))


def test_header_with_cleaning_and_long_kmers():
    clean = binary.Cleaning(True, False, True, True, 3, 4, b"against")
    h = binary.Header(47, (b"a", b""), error_rates=(bytes(range(16)),) * 2, cleaning=(clean, binary.Cleaning()))
    back = binary.Header.load(io.BytesIO(h.dump()))
    assert back == h and back.record_size == 26


@pytest.mark.parametrize("change", [lambda b: b"X" + b[1:], lambda b: b[:-1] + b"Y", lambda b: b[:-3], lambda b: b[:6] + b"\x05" + b[7:]])
def test_bad_headers_are_refused(change):
    with pytest.raises(ValueError):
        binary.Header.load(io.BytesIO(change(binary.Header(3, (b"s",)).dump())))


@pytest.mark.parametrize("bad", [{"k": 4, "samples": (b"s",)}, {"k": 3, "samples": ()}, {"k": 3, "samples": (b"s",), "version": 7}])
def test_bad_header_values(bad):
    with pytest.raises(ValueError):
        binary.Header(**bad)


@pytest.mark.parametrize("k", [3, 31, 33, 65])
def test_kmer_words_round_trip(k):
    rng = random.Random(k)
    kmers = sorted("".join(rng.choice("ACGT") for _ in range(k)) for _ in range(50))
    words = binary.encode_kmers(kmers, k, -(-k // 32))
    assert binary.decode_kmers(words, k) == kmers
    assert [tuple(w) for w in words.tolist()] == sorted(tuple(w) for w in words.tolist())


@pytest.mark.parametrize("k", [3, 33])
def test_graph_file_round_trip(spark, tmp_path, k):
    rng = random.Random(1)
    graph = g.read_graph(spark, [(s, "".join(rng.choice("ACGT") for _ in range(80))) for s in ("a", "b")], k)
    path = str(tmp_path / "x.graph")
    binary.write_graph_file(graph, path)
    back = binary.read_graph_file(spark, path)
    assert back.samples == graph.samples and lines(back) == lines(graph)
    wide = binary.read_wide(spark, path, "row_idx,kmer", recordsPerPartition=7)
    rows = wide.orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(len(rows))) and [r.kmer for r in rows] == sorted(r.kmer for r in rows)
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="whole number"):
        binary.read_wide(spark, path).collect()


@pytest.mark.parametrize("k", [5, 33])
def test_lookups_read_their_own_records_only(spark, tmp_path, k):
    rng = random.Random(2)
    path = str(tmp_path / "x.graph")
    binary.write_graph_file(g.read_graph(spark, [("a", "".join(rng.choice("ACGT") for _ in range(300)))], k), path)
    rows = [tuple(r) for r in binary.read_wide(spark, path, "row_idx,kmer").orderBy("row_idx").collect()]
    kmers = [kmer for _, kmer in rows]
    some, middle = kmers[len(rows) // 2], len(rows) // 2
    absent = next(x for x in ("A" * k, "G" * k, "T" * k, "C" * k) if x not in kmers)
    for asked in ([some], [absent], [], [kmers[-1], some, absent, kmers[0], some], kmers, kmers[3:7]):
        assert sorted(map(tuple, binary.find_kmers(spark, path, asked, "row_idx,kmer").collect())) == [r for r in rows if r[1] in asked]
    for prefix in ("", "A", some[:3], some, some + "A", "TTTTT"):
        got = binary.read_wide(spark, path, "row_idx,kmer", prefix=prefix, recordsPerPartition=3)
        assert sorted(map(tuple, got.collect())) == [r for r in rows if r[1].startswith(prefix)]
    parts = binary._SeekingReader(path, ["kmer"], 1 << 20, [(x, x + "~") for x in (kmers[0], some, kmers[middle + 1])]).partitions()
    assert [(p.first, p.count) for p in parts] == [(0, 1), (middle, 2)]
    with pytest.raises(ValueError, match="mers"):
        binary.find_kmers(spark, path, ["AC"])
    with pytest.raises(Exception, match="not both"):
        binary.read_wide(spark, path, kmers=some, prefix="A").count()


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">one first\nACGT\nAC\n\n>two\nTT\n")
    assert sorted(map(tuple, text.read_fasta(spark, str(path)).collect())) == [("one", "ACGTAC"), ("two", "TT")]
    rows = text.kmer_records(reads(spark, "ACCTT")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(0, "AAG"), (1, "ACC"), (2, "AGG")]
    out = text.fasta_lines(spark.createDataFrame([(0, "AC")], "id int, seq string"))
    assert out.first().value == ">0\nAC"


def test_link_file(spark, tmp_path):
    path = str(tmp_path / "x.gz")
    body = '{\n "graph": {"num_colours": 1}\n}\n\n# comment\nATCGA 1\nR 3 1 GGC\nATCGC 2\nR 2 1 GC\nR 1 1 C\n'
    with gzip.open(path, "wt") as f:
        f.write(body)
    got = sorted(map(tuple, text.read_links(spark, path).collect()))
    assert got == [("ATCGA", "R", 3, 1, "GGC"), ("ATCGC", "R", 1, 1, "C"), ("ATCGC", "R", 2, 1, "GC")]
    with gzip.open(path, "wt") as f:
        f.write('{"graph": {"num_colours": 2}}\n')
    with pytest.raises(NotImplementedError):
        text.read_links(spark, path)


def test_unitig_json_of_three_samples(spark):
    graph = g.read_graph(spark, [("a", "AAAT"), ("b", "AAAGG"), ("c", "CAAA")], 3)
    doc = json.loads(text.unitig_json(unitigs.find_unitigs(graph)).first().json)
    assert doc["graph"] == {"colors": [0, 1, 2], "sample_names": ["a", "b", "c"]}
    assert sum(len(n["coverage"][0]) for n in doc["nodes"]) == 5 and all(len(n["coverage"]) == 3 for n in doc["nodes"])
    assert {e["key"] for e in doc["edges"]} == {0, 1, 2}


def test_unitig_json_in_rows_is_one_document(spark, monkeypatch):
    graph = g.read_graph(spark, [("a", "AAATCCGCTTAGC"), ("b", "AAAGGCATTACG"), ("c", "CAAAGTCCGATT")], 3)
    whole = json.loads(text.unitig_json(unitigs.find_unitigs(graph, "all")).first().json)
    monkeypatch.setattr(text, "JSON_ROWS", 2)
    rows = text.unitig_json(unitigs.find_unitigs(graph, "all")).orderBy("part").collect()
    assert len(rows) > 5 and json.loads("".join(r.json for r in rows)) == whole
    assert [n["id"] for n in whole["nodes"]] == list(range(len(whole["nodes"]))) and len(whole["nodes"]) > 2


def test_alignment_golden():
    a = align.align("GTAGGCGAGATGACGCCAT", ["GTAGGCGAGTCCCGTTTATA", "CCACAGAAGATGACGCCATT"])
    assert a.tracks == [("query", "GTAGGCGAGATGACGCCAT", 0, 18), ("template0", "GTAGGCG", 0, 6), ("template1", " " * 7 + "AGATGACGCCAT", 7, 18)]
    assert -27 <= a.llk <= -26 and a.edits == "|" * 19


@pytest.mark.parametrize("size", [100, 200])
def test_alignment_splits_at_the_middle(size):
    rng = random.Random(size)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    query = make(size)
    half = size // 2
    a = align.align(query, [query[:half] + make(half), make(half) + query[half:]])
    assert [t[0] for t in a.tracks] == ["query", "template0", "template1"]
    assert abs(len(a.tracks[1][1]) - half) <= 3 and a.tracks[2][1].strip() in query


def test_alignment_with_a_gap_and_nothing():
    rng = random.Random(4)
    target = "".join(rng.choice("ACGT") for _ in range(60))
    a = align.align(target[:30] + target[33:], [target])
    assert a.edits.count("~") == 3 and a.tracks[0][1].count("-") == 3
    assert align.align("", ["ACGT"]).steps == [] and align.align("ACGT", []).steps == []


@pytest.mark.parametrize("size", [1, 2, 19, 100, 150])
def test_low_memory_alignment_is_the_same(size):
    rng = random.Random(size)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    query = make(size)
    targets = [query[: size // 3] + make(40), make(7) + query[size // 3 + 2 :], "", make(30) + query[size // 4 : size // 2]]
    whole, frugal = align.align(query, targets), align.align(query, targets, low_memory=True)
    assert whole.rows_held == size and frugal.rows_held <= size**0.5 + 1
    whole.rows_held = frugal.rows_held
    assert frugal == whole


def test_panel_by_low_memory(spark):
    rows = spark.createDataFrame([(1, "GTAGGCGAGTCCCGTTTATA"), (2, "CCACAGAAGATGACGCCATT"), (3, "GTAGGCGAGATGACGCCAT")], "id long, seq string")
    shown = [sorted(map(tuple, align.align_panel(rows, rows, cells=cells).collect())) for cells in (0, 1 << 20)]
    assert shown[0] == shown[1]


def test_align_all_rows(spark):
    df = spark.createDataFrame([(1, "ACGTACGT", ["ACGTACGT"]), (2, None, None)], "query_id long, query string, targets array<string>")
    rows = align.align_all(df).orderBy("n").collect()
    assert [(r.query_id, r.track, r.text) for r in rows] == [(1, "query", "ACGTACGT"), (1, "template0", "ACGTACGT")]


def test_panel_is_all_other_targets_or_an_error(spark):
    rows = spark.createDataFrame([(1, "GTAGGCGAGTCCCGTTTATA"), (2, "CCACAGAAGATGACGCCATT"), (3, "GTAGGCGAGATGACGCCAT"), (4, None), (4, "ACGT"), (None, "ACGT")], "id long, seq string")
    got = align.align_panel(rows, rows).toPandas()
    plain = align.align("GTAGGCGAGATGACGCCAT", ["GTAGGCGAGTCCCGTTTATA", "CCACAGAAGATGACGCCATT", "", "ACGT"])
    third = got[got["query_id"] == 3].sort_values("n")
    assert list(zip(third["track"], third["text"], strict=True)) == [t[:2] for t in plain.tracks] and third["llk"].iloc[0] == plain.llk
    # rows of one id are no targets of each other, nor has a row without an id part in it
    assert set(got["query_id"]) == {1, 2, 3, 4}
    assert align.align_panel(rows.limit(0), rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="panel"):
        align.align_panel(rows, rows, letters=50)



def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(0, "ACGTT"), (1, "ACCTTA"), (0, "ACGTT")], "color int, seq string")
    df.repartition(3).write.parquet(str(tmp_path / "reads"))
    got = sorted(map(tuple, counts.count_folder(spark, str(tmp_path / "reads"), "color int, seq string", 3).collect()))
    assert got == sorted(map(tuple, g.build(df, 3, ("a", "b")).nodes.collect()))


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "x.graph")
    binary.write_graph_file(reads(spark, "CAACC", "CAACT"), path)
    go = lambda *args: cli.run(cli.parser().parse_args(list(args)), spark)
    assert go("view", "graph", path) == 0 and capsys.readouterr().out.splitlines()[0].startswith("AAC 2 ")
    assert go("view", "graph", path, "--kmers") == 0 and capsys.readouterr().out.startswith(">0\nAAC\n")
    assert go("view", "contig", path, "CAA") == 0 and capsys.readouterr().out.startswith("CAA: CAA 2 1 ")
    assert go("traverse", path, "--seed-strings", "CAA", "--max-paths", "1") == cli.MAX_PATHS_EXCEEDED
    assert go("traverse", path, "--seed-strings", "CAA") == 0 and sorted(capsys.readouterr().out.split()) == [">g0_p0", ">g0_p1", "CAACC", "CAACT"]
    assert go("prune", path, "-t", "1") == 1
    out = str(tmp_path / "y.graph")
    assert go("subgraph", "CAACC", "--graphs", path, "-o", out) == 0
    assert {line.split()[0] for line in lines(binary.read_graph_file(spark, out))} == {"CAA", "AAC", "ACC", "ACT"}
