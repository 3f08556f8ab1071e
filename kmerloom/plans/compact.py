"""Unitigs from reads or from a graph's rows: blocks of k-mers, then pieces put together.

One shuffle brings the windows of the reads to blocks (see ``functions.blocks``), a second the
pieces of each block home to the least slice of reads that holds them, where most become whole. The
few ends that are still open meet by name, in one task while they are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as b
from . import local as one_task
from .graph import Graph
from .persist import written

#: Bytes of text in a slice, bases of runs kept before they are passed on, and windows counted at a time.
SLICE, KEPT, COUNTED = 4 << 20, 32 << 20, 2 << 20
#: Bases of open pieces that one task may hold.
ONE_TASK_BASES = 256 << 20
_RUNS = "block int, size binary, ends binary, color binary, home binary, data binary"
_ROWS = "block int, code binary, color binary, coverage binary, edges binary"
_PIECES = "home long, nk binary, data binary, edges binary, present binary, open binary, key binary, loop binary, extra binary"
_LINES = "id long, seq string, nk long, edges binary, present long, loop boolean, before long, after long, extra binary"
_STRANDS = "head long, twin long, right long, contig string, n_kmers long, is_cycle boolean, primary boolean, has_before boolean, least long, edges binary, extra binary"


def fits(graph: Graph) -> bool:
    return graph.k <= b.MAX_K and graph.num_colors <= b.MAX_COLORS


# --- Arrow --------------------------------------------------------------------------------------


def _binary(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    data = np.ascontiguousarray(data).view(np.uint8).ravel()
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of text or bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def _grouped(batches, key: str, names: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Bytes of the named columns of rows that follow each other with one key."""
    last, parts = None, {}
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        raw = {n: _raw(batch.column(n)) for n in names}
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if last is None or keys[i] != last:
                if last is not None:
                    yield last, {n: np.concatenate(x) for n, x in parts.items()}
                last, parts = int(keys[i]), {n: [] for n in names}
            for n, (data, offsets) in raw.items():
                parts[n].append(data[offsets[i] : offsets[j]])
    if last is not None:
        yield last, {n: np.concatenate(x) for n, x in parts.items()}


def _dealt(key: np.ndarray, fields: dict[str, np.ndarray], data: tuple[np.ndarray, np.ndarray] | None, name: str) -> pa.RecordBatch:
    """A row for each of the sorted keys; ``data`` are bytes and how many belong to each element."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    cut = np.append(first, len(key))
    columns = {n: _binary(v, cut * (v.nbytes // max(1, len(v)))) for n, v in fields.items()}
    if data is not None:
        columns["data"] = _binary(data[0], np.concatenate([[0], np.cumsum(data[1])])[cut])
    return pa.RecordBatch.from_arrays([pa.array(key[first]), *columns.values()], names=[name, *columns])


# --- blocks -------------------------------------------------------------------------------------


def _from_text(k: int, blocks: int):
    def flush(kept: list) -> pa.RecordBatch:
        block, size, ends, color, home, data, four = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(block, kind="stable")
        start = np.cumsum(four) - four
        data = data[b.places(start[order], four[order])]
        fields = {"size": size[order].astype(np.int32), "ends": ends[order], "color": color[order], "home": home[order]}
        return _dealt(block[order], fields, (data, four[order]), "block").select(["block", "size", "ends", "color", "home", "data"])

    def run(batches):
        kept, bases, slices, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = _raw(batch.column("text").cast(pa.large_string()).fill_null(""))
            color, at = batch.column("color").to_numpy(zero_copy_only=False).astype(np.uint8), 0
            while at < len(color):
                end = min(len(color), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1))
                seq, begin = b.letters(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                found = b.runs(seq, begin, k, blocks)
                if found is not None and len(found[0]):
                    block, row, size, ends, first = found
                    runs, four = b.packed(seq, first, size + k - 1)
                    kept.append((block, size, ends, color[at:end][row], np.full(len(row), part << 24 | slices, np.int64), runs, four))
                    bases += len(runs) * 4
                slices, at = slices + 1, end
                if bases > KEPT:
                    yield flush(kept)
                    kept, bases = [], 0
        if kept:
            yield flush(kept)

    return run


def _from_rows(k: int, blocks: int):
    def flush(kept: list) -> pa.RecordBatch:
        code, color, coverage, edges = (np.concatenate(x) for x in zip(*kept, strict=True))
        block = b.block_of_codes(code, k, blocks)
        order = np.argsort(block, kind="stable")
        return _dealt(block[order], {"code": code[order], "color": color[order], "coverage": coverage[order], "edges": edges[order]}, None, "block")

    def run(batches):
        kept, rows = [], 0
        for batch in batches:
            if not len(batch):
                continue
            data, offsets = _raw(batch.column("kmer"))
            code = b.segments(b._BASE[data[offsets[0] : offsets[-1]]] & 3, k)[0][::k]
            number = lambda name, kind: batch.column(name).to_numpy(zero_copy_only=False).astype(kind)
            kept.append((code, number("color", np.uint8), number("coverage", np.int64), number("edges", np.uint8)))
            rows += len(batch)
            if rows > SLICE // 4:
                yield flush(kept)
                kept, rows = [], 0
        if kept:
            yield flush(kept)

    return run


def dealt(graph: Graph) -> tuple[DataFrame, bool, int]:
    """Runs of the reads (or rows of the graph) by block, whether they are runs, and how many blocks there are."""
    source = graph.nodes if graph.source is None else graph.source
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(64, 8 * parts)
    if graph.source is None:
        rows = source.select("kmer", F.col("color").cast("int"), F.col("coverage").cast("long"), F.col("edges").cast("int")).mapInArrow(_from_rows(graph.k, blocks), _ROWS)
    else:
        rows = source.where("color IS NOT NULL AND text IS NOT NULL").select(F.col("color").cast("int"), "text").mapInArrow(_from_text(graph.k, blocks), _RUNS)
    return rows.repartition(parts, "block").sortWithinPartitions("block"), graph.source is not None, blocks


def nodes_of_blocks(batches, runs: bool, k: int, colors: int, most: int):
    """``block, codes, coverage, edges, home`` of each block that comes along, ``most`` windows at a time."""
    if not runs:
        for block, r in _grouped(batches, "block", ["code", "color", "coverage", "edges"]):
            code = r["code"].view(np.uint64)
            home = np.full(len(code), TaskContext.get().partitionId(), np.int64)
            yield block, *b.gathered(code, r["color"].astype(np.int64), r["coverage"].view(np.int64), r["edges"], home, colors)
        return
    for block, r in _grouped(batches, "block", ["size", "ends", "color", "home", "data"]):
        size, home = r["size"].view(np.int32).astype(np.int64), r["home"].view(np.int64)
        color = r["color"].astype(np.int64)
        where = np.concatenate([[0], np.cumsum((size + k - 1 + 3) // 4)])
        seen, at, found = np.cumsum(size), 0, None
        # a block with a very common k-mer is counted in parts
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(seen, (seen[at - 1] if at else 0) + most, side="right")))
            some = b.counted(size[at:end], r["ends"][at:end], color[at:end], home[at:end], r["data"][where[at] : where[end]], k, colors)
            if found is not None:
                codes, coverage, edges, homes = (np.concatenate(x) for x in zip(found, some, strict=True))
                row, c = np.nonzero(coverage)
                some = b.gathered(codes[row], c, coverage[row, c], edges[row, c], homes[row], colors)
            found, at = some, end
        yield block, *found


# --- pieces -------------------------------------------------------------------------------------


def _compactor(runs: bool, k: int, colors: int, mode: str):
    def flush(kept: list) -> pa.RecordBatch:
        p, home = b.merged([x for x, _ in kept]), np.concatenate([h for _, h in kept])
        order = np.argsort(home, kind="stable")
        p, home = b.select(p, order, k, mode), home[order]
        data, four = b.packed(p.bases, p.starts(k), p.nk + k - 1)
        wide = {"nk": p.nk.astype(np.int32), "edges": p.edges, "present": p.present, "open": p.open.reshape(-1, 2), "key": p.key.reshape(-1, 2), "loop": p.loop}
        row = _dealt(home, wide, (data, four), "home")
        first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        at = np.append(first, len(home))
        if mode == "all":
            at = np.concatenate([[0], np.cumsum(p.nk)])[at]
        extra = _binary(p.extra, at * 8 * colors) if mode != "none" else _binary(np.zeros(0, np.uint8), np.zeros(len(at)))
        return row.append_column("extra", extra).select([c.split()[0] for c in _PIECES.split(", ")])

    def run(batches):
        kept, bases = [], 0
        for _, codes, coverage, edges, home in nodes_of_blocks(batches, runs, k, colors, COUNTED):
            p, node = b.compacted(codes, coverage, edges, k, mode)
            kept.append((p, np.minimum.reduceat(home[node], np.cumsum(p.nk) - p.nk)))
            bases += len(p.bases)
            if bases > (KEPT if mode != "all" else KEPT >> 5):
                yield flush(kept)
                kept, bases = [], 0
        if kept:
            yield flush(kept)

    return run


def _lines(p: b.Pieces, k: int, mode: str, ids: np.ndarray) -> pa.RecordBatch:
    """A row for each piece."""
    n, colors = len(p), p.edges.shape[1]
    size = p.nk + k - 1
    name = lambda side: pa.array(p.key.view(np.int64)[side::2], mask=~p.open[side::2])
    rows = np.cumsum(p.nk) if mode == "all" else np.arange(1, n + 1)
    extra = _binary(p.extra, np.concatenate([[0], rows]) * 8 * colors) if mode != "none" else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), _binary(b.LETTER[p.bases], np.concatenate([[0], np.cumsum(size)]), pa.string()), pa.array(p.nk), _binary(p.edges, np.arange(n + 1) * colors), pa.array(p.present.view(np.int64)), pa.array(p.loop), name(0), name(1), extra],
        names=[c.split()[0] for c in _LINES.split(", ")],
    )


def _homes(k: int, colors: int, mode: str):
    names = ["nk", "data", "edges", "present", "open", "key", "loop", "extra"]

    def run(batches):
        made, part = 0, TaskContext.get().partitionId()
        for _, r in _grouped(batches, "home", names):
            nk = r["nk"].view(np.int32).astype(np.int64)
            size = nk + k - 1
            four = (size + 3) // 4 * 4
            bases = b.unpacked(r["data"])[b.places(np.cumsum(four) - four, size)]
            extra = None if mode == "none" else r["extra"].view(np.int64).reshape(-1, colors)
            p = b.joined(b.Pieces(bases, nk, r["edges"].reshape(-1, colors), r["present"].view(np.uint64), r["open"].view(bool), r["key"].view(np.uint64), r["loop"].view(bool), extra), k, mode)
            yield _lines(p, k, mode, (part << 40) + made + np.arange(len(p)))
            made += len(p)

    return run


def pieces_of_lines(batches, colors: int, mode: str) -> b.Pieces | None:
    table = pa.Table.from_batches([x for x in batches if len(x)]) if batches else None
    if table is None or not len(table):
        return None
    table = table.combine_chunks()
    column = lambda n: table.column(n).chunk(0) if table.column(n).num_chunks else table.column(n).combine_chunks()
    cut = lambda n: (lambda data, at: data[at[0] : at[-1]])(*_raw(column(n)))
    sides = lambda f: np.stack([f(column("before")), f(column("after"))], 1).ravel()
    extra = None if mode == "none" else cut("extra").view(np.int64).reshape(-1, colors)
    return b.Pieces(
        b._BASE[cut("seq")], column("nk").to_numpy(), cut("edges").reshape(-1, colors), column("present").to_numpy().view(np.uint64),
        sides(lambda c: c.is_valid().to_numpy(zero_copy_only=False)), sides(lambda c: c.fill_null(0).to_numpy()).view(np.uint64), column("loop").to_numpy(zero_copy_only=False), extra,
    )


def _glue(k: int, colors: int, mode: str):
    def run(batches):
        p = pieces_of_lines(list(batches), colors, mode)
        if p is not None:
            p = b.joined(p, k, mode)
            yield _lines(p, k, mode, np.zeros(len(p), np.int64))

    return run


def _closed(pieces: DataFrame, k: int, colors: int, mode: str) -> DataFrame:
    """Pieces with all ends that have a counterpart put together."""
    ends = pieces.select("present", "id", F.explode(F.array("before", "after")).alias("key")).where("key IS NOT NULL")
    pairs = ends.groupBy("key", "present").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2").drop("n")
    pairs = written(pairs, "open-ends")
    count = pairs.count()
    if not count:
        return pieces
    few = (lambda d: F.broadcast(d)) if count <= one_task.ONE_TASK else (lambda d: d)
    touched = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    done = pieces.join(few(touched), "id", "left_anti")
    rest = pieces.join(few(touched), "id", "left_semi")
    for side in ("before", "after"):
        good = pairs.select(F.col("key").alias(side), "present", F.col("key").alias("_key"))
        rest = rest.join(few(good), [side, "present"], "left").withColumn(side, F.col("_key")).drop("_key")
    names = pieces.columns
    rest = written(rest.select(names), "open-pieces")
    parts, round_ = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    while True:
        size = rest.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases")).first()
        if not size.n:
            return done
        if size.n <= one_task.ONE_TASK and size.bases <= ONE_TASK_BASES:
            return done.select(names).unionByName(rest.coalesce(1).mapInArrow(_glue(k, colors, mode), _LINES))
        # every piece goes where the least of its names does: at least the ends of least names meet
        least = F.least(*[F.xxhash64(F.lit(round_), F.when(F.col(c).isNotNull(), F.col(c))) + F.when(F.col(c).isNull(), F.lit(None).cast("long")).otherwise(0) for c in ("before", "after")])
        met = written(rest.withColumn("_to", least).repartition(parts, "_to").drop("_to").mapInArrow(_glue(k, colors, mode), _LINES), "open-pieces")
        done = done.select(names).unionByName(met.where("before IS NULL AND after IS NULL"))
        rest, round_ = met.where("before IS NOT NULL OR after IS NOT NULL"), round_ + 1


# --- unitigs ------------------------------------------------------------------------------------

_TURN = bytes.maketrans(b"ACGT", b"TGCA")
_FLAG_BEFORE = dict(zip(b"ACGT", b._BEFORE.tolist(), strict=False))
_FLAG_AFTER = dict(zip(b"ACGT", b._AFTER.tolist(), strict=False))


def _code(kmer: bytes) -> int:
    out = 0
    for c in b._BASE[np.frombuffer(kmer, np.uint8)].tolist():
        out = out << 2 | c
    return out


def _strands(k: int, colors: int, mode: str):
    """Both strands of each unitig; a cycle begins at the least string of its strand."""

    def run(batches):
        for batch in batches:
            p = pieces_of_lines([batch], colors, mode)
            if p is None:
                continue
            forward, backward = b.segments(p.bases, k)
            at = p.starts(k)
            inside = b.places(at, p.nk)
            first = np.cumsum(p.nk) - p.nk
            f, r = forward[inside], backward[inside]
            least = np.minimum.reduceat(f, first), np.minimum.reduceat(r, first)
            text = b.LETTER[p.bases].tobytes()
            size = p.nk + k - 1
            contigs, heads, rights, primary, edges = [], [], [], [], np.repeat(p.edges, 2, axis=0)
            edges[1::2] = b.SWAP[edges[1::2]]
            left, right = (f[first], r[first + p.nk - 1]), (f[first + p.nk - 1], r[first])
            for i, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
                one = text[a : a + n]
                two = one.translate(_TURN)[::-1]
                if p.loop[i]:
                    n -= k - 1
                    own = [f[first[i] : first[i] + n], r[first[i] : first[i] + n][::-1]]
                    turned = []
                    for way, (s, codes) in enumerate(zip((one, two), own, strict=True)):
                        j = int(np.argmin(codes))
                        ring = s[j:n] + s[:j]
                        whole = ring * (1 + (k - 1) // n + 1)
                        turned.append(whole[: n + k - 1])
                        heads.append(int(codes[j]))
                        rights.append(int(codes[j - 1]))
                        flags = _FLAG_BEFORE[ring[-1]] | _FLAG_AFTER[whole[k - 1]]
                        here = p.present[i] >> np.arange(colors, dtype=np.uint64) & np.uint64(1)
                        edges[2 * i + way] = np.where(here > 0, flags, 0)
                    one, two = turned
                    own_first = bool(least[0][i] <= least[1][i])
                    primary += [own_first, not own_first]
                else:
                    primary += [one <= two, two <= one]
                    heads += [int(left[0][i]), int(left[1][i])]
                    rights += [int(right[0][i]), int(right[1][i])]
                contigs += [one, two]
            n = len(p)
            extra = pa.nulls(2 * n, pa.binary())
            if mode == "sum":
                extra = _binary(np.repeat(p.extra, 2, axis=0), np.arange(2 * n + 1) * 8 * colors)
            elif mode == "all":
                extra = _kept_coverage(p, f, r, first, primary, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads, pa.int64()), pa.array(np.array(heads, np.int64).reshape(-1, 2)[:, ::-1].ravel()), pa.array(rights, pa.int64()), pa.array(contigs, pa.binary()).cast(pa.string()), pa.array(np.repeat(p.nk, 2)), pa.array(np.repeat(p.loop, 2)), pa.array(primary), pa.array((edges & 240).any(1)), pa.array(np.stack(least, 1).ravel().view(np.int64)), _binary(edges, np.arange(2 * n + 1) * colors), extra],
                names=[c.split()[0] for c in _STRANDS.split(", ")],
            )

    return run


def _kept_coverage(p: b.Pieces, f, r, first, primary, k: int) -> pa.Array:
    """Coverage by k-mer along the primary strand, none along the other."""
    rows = []
    for i, (a, n) in enumerate(zip(first.tolist(), p.nk.tolist(), strict=True)):
        own = p.extra[a : a + n]
        for way in (0, 1):
            if not primary[2 * i + way]:
                rows.append(None)
                continue
            one = own[::-1] if way else own
            if p.loop[i]:
                one = np.roll(one, -int(np.argmin(r[a : a + n][::-1] if way else f[a : a + n])), axis=0)
            rows.append(np.ascontiguousarray(one).tobytes())
    return pa.array(rows, pa.binary())


def strands(graph: Graph, mode: str = "none") -> DataFrame:
    """``head, twin, right, contig, n_kmers, is_cycle, primary, has_before, least, edges, extra``: both strands of all unitigs.

    ``head`` and ``right`` are the codes of the first and last k-mer, ``twin`` the head of the other
    strand, ``least`` the code of the least string; ``edges`` has a byte for each color, with the flags before the first and after the last
    k-mer. ``extra`` is coverage by color: none, its sum, or all of it by k-mer.
    """
    rows, runs, _ = dealt(graph)
    k, colors = graph.k, graph.num_colors
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(_compactor(runs, k, colors, mode), _PIECES)
    lines = written(sent.repartition(parts, "home").sortWithinPartitions("home").mapInArrow(_homes(k, colors, mode), _LINES), "pieces")
    return written(_closed(lines, k, colors, mode).mapInArrow(_strands(k, colors, mode), _STRANDS), "unitigs")


# --- k-mers of unitigs --------------------------------------------------------------------------

#: K-mers that are spelled at a time.
SPELLED = 1 << 18


def _slices(nk: np.ndarray) -> Iterator[tuple[int, int]]:
    seen, at = np.concatenate([[0], np.cumsum(nk)]), 0
    while at < len(nk):
        end = max(at + 1, int(np.searchsorted(seen, seen[at] + SPELLED, side="right")) - 1)
        yield at, end
        at = end


def _windows(contig: pa.Array, k: int):
    """Letters, k-mers by contig and where each window begins; codes of both strands are made of them."""
    data, offsets = _raw(contig)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    nk = np.diff(offsets) - (k - 1)
    return data, nk, b.places(offsets[:-1], nk)


def spelled(strands: DataFrame, k: int, columns: str, canonical_only: str | None = None) -> DataFrame:
    """A row for each k-mer of ``contig``: ``columns`` are those of the input that are kept and any of
    ``pos long, code long, node string, kmer string``. Of rows where ``canonical_only`` holds
    only k-mers that are canonical."""
    made = [c.split() for c in columns.split(", ")]
    kept = [n for n, _ in made if n not in ("pos", "code", "node", "kmer")]
    names = [n for n, _ in made]

    def run(batches):
        for batch in batches:
            whole, nk = batch, None
            if not len(batch):
                continue
            nk = np.diff(_raw(batch.column("contig"))[1]) - (k - 1)
            for i, j in _slices(nk):
                part = whole.slice(i, j - i)
                data, n, at = _windows(part.column("contig"), k)
                forward, backward = b.segments(b._BASE[data], k)
                f, r = forward[at], backward[at]
                row = np.repeat(np.arange(len(n)), n)
                pos = b.places(np.zeros(len(n), np.int64), n)
                if canonical_only:
                    keep = (f <= r) | ~part.column(canonical_only).to_numpy(zero_copy_only=False)[row]
                    f, r, row, pos, at = f[keep], r[keep], row[keep], pos[keep], at[keep]
                ends = np.arange(len(f) + 1) * k
                out = {n: part.column(n).take(pa.array(row)) for n in kept}
                node = np.lib.stride_tricks.sliding_window_view(data, k)[at] if "node" in names or "kmer" in names else None
                if "kmer" in names:
                    own = node.copy()
                    back = f > r
                    own[back] = b.LETTER[3 - b._BASE[own[back][:, ::-1]]]
                    out["kmer"] = _binary(own, ends, pa.string())
                if "node" in names:
                    out["node"] = _binary(node, ends, pa.string())
                out["pos"], out["code"] = pa.array(pos), pa.array(f.view(np.int64))
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    inner = [n for n in dict.fromkeys(["contig", *kept, *([canonical_only] if canonical_only else [])])]
    return strands.select(inner).mapInArrow(run, columns)


def out_edges(strands: DataFrame, k: int, colors: int) -> DataFrame:
    """``src, next, color, src_cycle``: the k-mers that follow the last one of a strand, by color."""
    mask = np.uint64((1 << 2 * k) - 1)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            data, offsets = _raw(batch.column("edges"))
            flags = data[offsets[0] : offsets[-1]].reshape(len(batch), colors)
            right = batch.column("right").to_numpy().view(np.uint64)
            for base in range(4):
                row, color = np.nonzero(flags & b._AFTER[base])
                code = (right[row] << np.uint64(2) | np.uint64(base)) & mask
                yield pa.RecordBatch.from_arrays([batch.column("head").take(pa.array(row)), pa.array(code.view(np.int64)), pa.array(color.astype(np.int32)), batch.column("is_cycle").take(pa.array(row))], names=["src", "next", "color", "src_cycle"])

    return strands.select("head", "right", "edges", "is_cycle").mapInArrow(run, "src long, next long, color int, src_cycle boolean")


def totals(strands: DataFrame, colors: int) -> DataFrame:
    """``contig, coverage`` summed by color, of strands made with the sums."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            data, offsets = _raw(batch.column("extra"))
            sums = data[offsets[0] : offsets[-1]].view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * colors), pa.array(sums))
            yield pa.RecordBatch.from_arrays([batch.column("contig"), flat], names=["contig", "coverage"])

    return strands.where("primary").select("contig", "extra").mapInArrow(run, "contig string, coverage array<long>")


def by_kmer(strands: DataFrame, colors: int) -> DataFrame:
    """``contig, coverage``: coverage by k-mer and color, of strands made with all of it."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                data, offsets = _raw(one.column("extra"))
                values = data[offsets[0] : offsets[-1]].view(np.int64)
                n = len(values) // colors
                inner = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * colors), pa.array(values))
                yield pa.RecordBatch.from_arrays([one.column("contig"), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), inner)], names=["contig", "coverage"])

    return strands.where("primary").select("contig", "extra").mapInArrow(run, "contig string, coverage array<array<long>>")


def holding(strands: DataFrame, k: int, codes: DataFrame) -> DataFrame:
    """``head, pos`` of the k-mers of strands that are among ``codes (code)``."""
    codes = written(codes.select("code").distinct(), "codes")
    if not one_task.is_small(codes):
        return spelled(strands, k, "head long, pos long, code long").join(codes, "code", "left_semi").select("head", "pos")
    wanted = codes.sparkSession.sparkContext.broadcast(np.sort(codes.toPandas()["code"].to_numpy(np.int64)).view(np.uint64))

    def run(batches):
        own = wanted.value
        for batch in batches:
            if not len(batch) or not len(own):
                continue
            data, n, at = _windows(batch.column("contig"), k)
            f = b.segments(b._BASE[data], k)[0][at]
            hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, f), len(own) - 1)] == f)
            row, pos = np.repeat(np.arange(len(n)), n)[hit], b.places(np.zeros(len(n), np.int64), n)[hit]
            yield pa.RecordBatch.from_arrays([batch.column("head").take(pa.array(row)), pa.array(pos)], names=["head", "pos"])

    return strands.select("head", "contig").mapInArrow(run, "head long, pos long")


# --- dead ends ----------------------------------------------------------------------------------


def ends(strands: DataFrame, k: int, colors: int, most: int) -> DataFrame:
    """``head, n_kmers, n_before, n_after, next, contig`` of strands: distinct neighbours on both sides over all
    colors, the k-mer that follows if it is the only one, and the string if it has at most ``most`` k-mers."""
    mask = np.uint64((1 << 2 * k) - 1)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            data, offsets = _raw(batch.column("edges"))
            flags = np.bitwise_or.reduce(data[offsets[0] : offsets[-1]].reshape(len(batch), colors), 1)
            base = b._ONE_AFTER[flags]
            code = (batch.column("right").to_numpy().view(np.uint64) << np.uint64(2) | np.maximum(base, 0).astype(np.uint64)) & mask
            count = lambda bits: pa.array(np.bitwise_count(flags & bits).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("n_kmers"), count(np.uint8(240)), count(np.uint8(15)), pa.array(code.view(np.int64), mask=base < 0), batch.column("short")], names=["head", "n_kmers", "n_before", "n_after", "next", "contig"])

    short = F.when(F.col("n_kmers") <= most, F.col("contig")).alias("short")
    return strands.select("head", "right", "n_kmers", "edges", short).mapInArrow(run, "head long, n_kmers long, n_before int, n_after int, next long, contig string")


def _beside(codes: np.ndarray, k: int) -> list[tuple[np.uint8, np.ndarray]]:
    """For each flag of codes the canonical k-mer to which it leads."""
    out = []
    for base in range(4):
        one = np.uint64(base)
        after = (codes << np.uint64(2) | one) & np.uint64((1 << 2 * k) - 1)
        before = one << np.uint64(2 * k - 2) | codes >> np.uint64(2)
        out += [(b._AFTER[base], np.minimum(after, b.reverse(after, k))), (b._BEFORE[base], np.minimum(before, b.reverse(before, k)))]
    return out


def _among(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, codes), len(table) - 1)] == codes if len(table) else np.zeros(len(codes), bool)


def without(graph: Graph, codes: np.ndarray) -> DataFrame:
    """``kmer, color, coverage, edges`` of a graph of reads less some canonical k-mers, and less the flags that lead to them."""
    rows, runs, blocks = dealt(graph)
    k, colors = graph.k, graph.num_colors
    gone = np.sort(codes.astype(np.uint64))
    near = np.unique(np.concatenate([c for _, c in _beside(gone, k)])) if len(gone) else gone
    place = b.block_of_codes(near, k, blocks)
    order = np.argsort(place, kind="stable")
    near, cut = near[order], np.searchsorted(place[order], np.arange(blocks + 1))
    sent = rows.sparkSession.sparkContext.broadcast((gone, near, cut))

    def run(batches):
        gone, near, cut = sent.value
        for block, codes, coverage, edges, _ in nodes_of_blocks(batches, runs, k, colors, COUNTED):
            own = near[cut[block] : cut[block + 1]]
            at = np.searchsorted(codes, own)
            at = at[_among(own, codes)]
            clear = np.zeros(len(at), np.uint8)
            for flag, far in _beside(codes[at], k):
                clear |= np.where(_among(far, gone), flag, np.uint8(0))
            edges[at] &= ~clear[:, None]
            row, color = np.nonzero((coverage > 0) & ~_among(codes, gone)[:, None])
            for i in range(0, len(row), SPELLED):
                r, c = row[i : i + SPELLED], color[i : i + SPELLED]
                kmer = _binary(b.LETTER[b.bases_of(codes[r], k)], np.arange(len(r) + 1) * k, pa.string())
                yield pa.RecordBatch.from_arrays([kmer, pa.array(c.astype(np.int32)), pa.array(coverage[r, c].astype(np.int64)), pa.array(edges[r, c].astype(np.int32))], names=["kmer", "color", "coverage", "edges"])

    return rows.mapInArrow(run, "kmer string, color int, coverage long, edges int")
