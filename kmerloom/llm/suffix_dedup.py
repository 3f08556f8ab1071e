"""Exact removal of repeated strings by distributed prefix doubling over sampled suffixes.

A suffix array would sort every position of the corpus. Two facts make a sparse one enough:

* A rank is only ever compared for equality, so the name of a prefix (a hash made by doubling:
  the name of 2n bytes is made of the names of its halves) serves as its rank.
* Of any run of ``s`` neighbouring positions, take the one with the least name of 64 bytes. Which
  one that is depends on the bytes of a window alone, so equal windows have the same anchors, and
  a window whose anchor has a name of its own cannot repeat.

Round 1 names 64 bytes at the anchors of windows of 400 bytes; Spark brings equal names together
and anchors with a unique name leave, with all windows that belong to them. Round 2 takes denser
anchors in what is left and compares pairs of longer names: a short one that all windows of an
anchor contain, and a long one that contains them all. A unique short name ends the anchor; a
long name that occurs twice proves all its windows repeated. Round 3 names the 400 bytes of each
window of the few anchors between the two, the edges of passages, and of one anchor for every
long name they are to be compared with.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, mix64, rows_of, slices, utf8, written

LENGTH = 400
#: Bytes of the names that choose anchors, a power of two.
GRAM = 64
#: Neighbouring windows among which round 2 takes one anchor.
DENSE = 48

_RNG = np.random.default_rng(400)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0x9FB21C651E98DF25)
#: Positions take the low bits of an ordering key; longer texts are cut into overlapping units.
_BITS = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)
UNIT_BYTES = 1 << 20
LONGEST_UNIT = 1 << 23


def gram_names(data: np.ndarray) -> np.ndarray:
    """Names of the GRAM bytes from each position on, made by doubling from single bytes."""
    names, n, k = _BYTE[data], 1, 0
    while n < GRAM:
        head = names[:-n] * _STEP[k]
        head ^= head >> np.uint64(31)
        head += names[n:]
        names, n, k = head, 2 * n, k + 1
    names = names * _STEP[k]
    names ^= names >> np.uint64(29)
    return names * _STEP[k + 1]


def long_names(grams: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of data[start:end], each from the grams that cover it."""
    last = end - GRAM
    out = (end - start).astype(np.uint64)
    for k in range(int(((last - start).max() + GRAM - 1) // GRAM) + 1 if len(start) else 0):
        at = np.minimum(start + k * GRAM, last)
        out = mix64(out * _FOLD + grams[at])
    return out


def window_minima(keys: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, by doubling."""
    least, n = keys, 1
    while 2 * n <= size:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    rest = size - n
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def anchors(grams: np.ndarray, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows (rising positions): their places, and their first and last window."""
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    chosen = (window_minima(keys, size)[windows] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    return chosen[first], windows[first], windows[last]


def units(data: np.ndarray, offsets: np.ndarray):
    """(first row, bytes, offsets, position of the first byte in its text, first window, end): whole rows, or pieces of one.

    Pieces of a long text overlap, so that each window is in one piece with all around it that names reach.
    """
    for a, b in slices(offsets, UNIT_BYTES):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= LONGEST_UNIT:
            yield a, data[lo:hi], offsets[a : b + 1] - lo, 0, 0, hi - lo
            continue
        for at in range(0, hi - lo, LONGEST_UNIT):
            x, y = max(0, at - DENSE), min(hi - lo, at + LONGEST_UNIT + LENGTH + 2 * DENSE)
            yield a, data[lo + x : lo + y], np.array([0, y - x]), x, at - x, min(y, at + LONGEST_UNIT) - x


def flags(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def open_windows(offsets: np.ndarray, closed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which positions begin a window inside their row that no closed range (start, end) holds."""
    full = np.diff(offsets) >= LENGTH
    inside = flags(int(offsets[-1]), offsets[:-1][full], offsets[1:][full] - LENGTH + 1)
    return inside if closed is None else inside & ~flags(int(offsets[-1]), *closed)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _keys() -> list[Column]:
    """Two hashes that name a text; copies share them and all that is found out about them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(LENGTH)).alias("k2")]


def coarse_anchors(docs: DataFrame) -> DataFrame:
    """``name, k1, k2, lo, n``: anchors of round 1 with their first window and number of windows."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            k1, k2 = batch.column("k1"), batch.column("k2")
            for first, buf, at, base, w0, w1 in units(data, offsets):
                inside = open_windows(at)
                inside[:w0] = inside[w1:] = False
                windows = np.flatnonzero(inside)
                if not len(windows):
                    continue
                grams = gram_names(buf)
                places, lo, hi = anchors(grams, windows, LENGTH - GRAM + 1)
                rows = np.searchsorted(at, places, side="right") - 1
                take = pa.array(rows + first)
                yield pa.RecordBatch.from_arrays([_longs(grams[places]), k1.take(take), k2.take(take), _longs(lo - at[rows] + base), _longs(hi - lo + 1)], names=["name", "k1", "k2", "lo", "n"])

    return docs.select("text", *_keys()).mapInArrow(frugal(run), "name long, k1 long, k2 long, lo long, n long")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text compressed: ``k1, k2, z`` and the other columns."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in others]

    def run(batches):
        for batch in batches:
            z = [zstandard.compress((t.as_py() or "").encode(), 1) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(z, pa.binary()), *[batch.column(n) for n in names]], names=["k1", "k2", "z", *names])

    schema = T.StructType([*[T.StructField(k, T.LongType()) for k in ("k1", "k2")], T.StructField("z", T.BinaryType()), *others])
    return docs.select(*_keys(), "text", *names).mapInArrow(frugal(run), schema)


def by_text(ranges: DataFrame) -> DataFrame:
    """One row per text with its codes; a text has fewer of them than bytes."""
    return ranges.groupBy("k1", "k2").agg(F.collect_list("code").alias("codes"))


def _range_code(lo: Column, n: Column) -> Column:
    return F.shiftleft(lo, 24) + n


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array([zstandard.decompress(z) for z in batch.column("z").to_pylist()], pa.large_binary()))


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each code of the batch."""
    lists = batch.column("codes")
    counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()] if lists.null_count else np.diff(lists.offsets.to_numpy()), np.int64)
    return rows_of(counts), lists.flatten().to_numpy()


def _clip(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.clip(start, 0, size), np.clip(end, 0, size)


def _unit_codes(rows: np.ndarray, codes: np.ndarray, first: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mine = slice(*np.searchsorted(rows, [first, first + len(at) - 1]))
    return rows[mine] - first, codes[mine]


def dense_anchors(joined: DataFrame) -> DataFrame:
    """``short, long, k1, k2, code``: anchors of round 2 in windows that no code has closed."""

    def run(batches):
        for batch in batches:
            data, offsets = _texts(batch)
            rows, codes = _codes(batch)
            k1, k2 = batch.column("k1"), batch.column("k2")
            for first, buf, at, base, w0, w1 in units(data, offsets):
                own, code = _unit_codes(rows, codes, first, at)
                lo = (code >> 24) + at[own] - base
                inside = open_windows(at, _clip(lo, lo + (code & 0xFFFFFF), len(buf)))
                inside[:w0] = inside[w1:] = False
                windows = np.flatnonzero(inside)
                if not len(windows):
                    continue
                grams = gram_names(buf)
                places, lo, hi = anchors(grams, windows, DENSE)
                at_row = np.searchsorted(at, places, side="right") - 1
                left = np.minimum(DENSE - 1, places - at[at_row])
                right = np.minimum(LENGTH, at[at_row + 1] - places)
                short = long_names(grams, places, places + LENGTH - DENSE + 1)
                long = mix64(long_names(grams, places - left, places + right) + left.astype(np.uint64) * _STEP[20] + right.astype(np.uint64) * _STEP[21] + ((places - lo) << 8 | (places - hi)).astype(np.uint64) * _STEP[23])
                take = pa.array(at_row + first)
                yield pa.RecordBatch.from_arrays([_longs(short), _longs(long), k1.take(take), k2.take(take), _longs((places - at[at_row] + base) << 16 | (places - lo) << 8 | (places - hi))], names=["short", "long", "k1", "k2", "code"])

    return joined.mapInArrow(frugal(run), "short long, long long, k1 long, k2 long, code long")


def window_names(joined: DataFrame) -> DataFrame:
    """``short, name, k1, k2, p, weight``: every window of the anchors in the codes (lowest bit: stands for several)."""

    def run(batches):
        last = None
        for batch in batches:
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            new = [i for i, key in enumerate(keys) if key != (keys[i - 1] if i else last)]
            last = keys[-1] if keys else last
            batch = batch.take(pa.array(new, pa.int64()))
            data, offsets = _texts(batch)
            rows, codes = _codes(batch)
            k1, k2 = batch.column("k1"), batch.column("k2")
            for first, buf, at, base, w0, w1 in units(data, offsets):
                own, code = _unit_codes(rows, codes, first, at)
                several, code = code & 1, code >> 1
                places = (code >> 16) + at[own] - base
                lo = places - (code >> 8 & 255)
                mine = (lo >= w0) & (lo < w1)
                own, several, places, lo, n = own[mine], several[mine], places[mine], lo[mine], ((code >> 8 & 255) - (code & 255) + 1)[mine]
                if not len(places):
                    continue
                grams = gram_names(buf)
                short = long_names(grams, places, places + LENGTH - DENSE + 1)
                each = rows_of(n)
                p = lo[each] + np.arange(len(each)) - (np.cumsum(n) - n)[each]
                take = pa.array(own[each] + first)
                name = mix64(long_names(grams, p, p + LENGTH) + (places[each] - p).astype(np.uint64) * _STEP[22])
                yield pa.RecordBatch.from_arrays([_longs(short[each]), _longs(name), k1.take(take), k2.take(take), _longs(p - at[own[each]] + base), pa.array((1 + several[each]).astype(np.int32))], names=["short", "name", "k1", "k2", "p", "weight"])

    return joined.mapInArrow(frugal(run), "short long, name long, k1 long, k2 long, p long, weight int")


def once_ranges(docs: DataFrame, store: DataFrame) -> DataFrame:
    """``k1, k2, code``: ranges of windows that occur once, of each text (see :func:`_range_code`)."""
    named = coarse_anchors(docs).groupBy("name").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "lo", "n")).alias("m"))
    first = written(named.where("c = 1").select("m.k1", "m.k2", _range_code(F.col("m.lo"), F.col("m.n")).alias("code")), "once-coarse")
    pairs = dense_anchors(store.join(by_text(first), ["k1", "k2"], "left"))
    ranked = pairs.groupBy("short", "long").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "code")).alias("m"))
    ranked = written(ranked.select("short", "c", "m.k1", "m.k2", "m.code"), "ranked")
    # written, so that the join with a short name that many anchors share can be split
    classes = written(ranked.groupBy("short").agg(F.count("*").alias("longs"), F.sum("c").alias("members"), F.min(F.struct("k1", "k2", "code")).alias("m")).where("members = 1 OR longs > 1"), "classes")
    code = F.col("m.code")
    second = classes.where("members = 1").select("m.k1", "m.k2", _range_code(F.shiftright(code, 16) - F.shiftright(code, 8).bitwiseAND(255), F.shiftright(code, 8).bitwiseAND(255) - code.bitwiseAND(255) + 1).alias("code"))
    edges = ranked.join(classes.where("longs > 1").select("short"), "short").select("k1", "k2", (F.shiftleft("code", 1) + (F.col("c") > 1).cast("long")).alias("code"))
    names = window_names(store.join(by_text(edges), ["k1", "k2"]))
    single = names.groupBy("short", "name").agg(F.sum("weight").alias("c"), F.min(F.struct("k1", "k2", "p")).alias("m")).where("c = 1")
    third = single.select("m.k1", "m.k2", _range_code(F.col("m.p"), F.lit(1)).alias("code"))
    return first.unionByName(second).unionByName(third)


def apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of texts with very many copies, and all the others.

    Such a text is repeated throughout, so its rows need no names and no join. Texts with more
    copies than a thousandth of the rows are at most a thousand, which bounds what is broadcast.
    """
    most = max(1000, docs.count() // 1000)
    keyed = docs.withColumns(dict(zip(("k1", "k2"), _keys(), strict=True)))
    hot = keyed.where(F.octet_length("text") >= LENGTH).groupBy("k1", "k2").agg(F.count("*").alias("c")).where(F.col("c") > most).select(F.col("k1").alias("hot1"), F.col("k2").alias("hot2"))
    marked = keyed.join(F.broadcast(hot), (F.col("k1") == F.col("hot1")) & (F.col("k2") == F.col("hot2")), "left")
    return marked.where("hot1 IS NOT NULL").select(*docs.columns), marked.where("hot1 IS NULL").select(*docs.columns)


def _cleaned(docs: DataFrame, schema: T.StructType, make) -> DataFrame:
    """``make(batch, row, text, removed flags or None)`` values for each row, after the other columns."""
    docs = docs.select("*")
    hot, cold = apart(docs)
    # two copies of each such text make its strings repeated in the texts of others
    twice = hot.groupBy(*_keys()).agg(F.first("text").alias("text")).select("text", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select("text")
    texts = cold.select("text").unionByName(twice)
    ranges = by_text(once_ranges(texts, packed(texts)))
    joined = packed(cold).join(ranges, ["k1", "k2"], "left")
    joined = joined.unionByName(packed(hot).withColumn("codes", F.lit(None).cast(joined.schema["codes"].dataType)))
    others = [n for n in docs.columns if n != "text"]

    def run(batches):
        for batch in batches:
            data, offsets = _texts(batch)
            rows, codes = _codes(batch)
            out = []
            for a, b in slices(offsets, UNIT_BYTES):
                buf, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                own, code = _unit_codes(rows, codes, a, at)
                lo = (code >> 24) + at[own]
                repeated = open_windows(at, (lo, lo + (code & 0xFFFFFF)))
                start = np.flatnonzero(repeated)
                gone = flags(len(buf), start, start + LENGTH) if len(start) else None
                out += [make(buf[at[i] : at[i + 1]], None if gone is None else gone[at[i] : at[i + 1]]) for i in range(b - a)]
            made = [pa.array([x[k] for x in out], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for k, f in enumerate(schema.fields)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in others], *made], names=[*others, *schema.names])

    return joined.mapInArrow(frugal(run), T.StructType([*[docs.schema[n] for n in others], *schema.fields]))


def _digest(text: np.ndarray, gone: np.ndarray | None) -> tuple[int, int, int, str]:
    if gone is None or not gone.any():
        return len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()


def repeat_report(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Every byte of a LENGTH-byte string that also starts elsewhere, in this or another text, is
    removed; overlaps count and all is judged on the input. Null text is empty. Equal rows are
    documents of their own and so repeat each other. Ids play no part and may be null or equal.
    """
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    return _cleaned(docs.select("doc_id", "text"), schema, _digest)


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; a character that is cut in part goes whole.

    The other columns stay as they are, whatever their names; null text becomes empty.
    """
    places = [n for n, c in enumerate(docs.columns) if c == text_col]
    if len(places) != 1:
        raise ValueError(f"one column {text_col} is needed, there are {len(places)}")
    inner = docs.toDF(*["text" if n == places[0] else f"c{n}" for n in range(len(docs.columns))])
    make = lambda text, gone: ((text if gone is None else text[~gone]).tobytes().decode("utf-8", "ignore"),)
    out = _cleaned(inner, T.StructType([T.StructField("text", T.StringType())]), make)
    return out.select(*inner.columns).toDF(*docs.columns)
