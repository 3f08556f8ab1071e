"""Helpers that the training-data operators share.

Texts reach Python as Arrow batches. Everything here works on the UTF-8 bytes of a whole
batch at once, so no Python string is made for a document unless an operator needs one.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here counts it (a run of bytes that are no ASCII white space).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that an operator works on at a time.
BATCH_ROWS = 2048

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words when only letters make words; all bytes over 127 count as letters.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}_{n}"
    return name


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def text_slice(text: Column, h: Column, most: int) -> Column:
    """The text, or of one of more than ``most`` bytes a part of about so many at a place by the hash ``h`` (not negative)."""
    length, size = F.length(text).cast("long"), F.octet_length(text)
    shown = F.floor(length * most / size).cast("int")
    return F.when(size <= most, text).otherwise(F.substring(text, (h % (length - shown + 1) + 1).cast("int"), shown))


def one_of_each_id(rows: DataFrame, mark: str, *columns: str) -> DataFrame:
    """``mark, h, columns`` of one row for each doc_id, that whose text has the least hash ``h`` (not negative).

    Samples are bounded by ids; so the bound holds for rows too, however often an id repeats.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h")
    return rows.groupBy("doc_id", mark).agg(F.min(F.struct(h, *columns)).alias("r")).select(mark, "r.h", *[f"r.{c}" for c in columns])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared place that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, a laptop) a folder of this machine is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else "file:///tmp/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it survives executors and cuts lineage."""
    spark = df.sparkSession
    folder = scratch_folder(spark, what)
    df.write.option("compression", "zstd").parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table.written_to = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made and that nothing reads any more."""
    for table in tables:
        folder = getattr(table, "written_to", None)
        if folder:
            jvm = table.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give the memory that Arrow and the C library hold for reuse back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def frugal(run, rows: int | None = BATCH_ROWS):
    """``run`` for mapInArrow, in batches of so many rows at most; a worker that is done gives its memory back."""

    def slim(batches):
        for batch in batches:
            for at in range(0, len(batch), rows):
                yield batch.slice(at, rows)

    def inner(batches):
        yield from run(slim(batches) if rows else batches)
        release()

    return inner


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """(first row, row after the last): runs of whole rows of about ``most`` bytes at most each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~white[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.empty(len(data), dtype=bool)
    last[:-1] = first[1:] | ~inside[1:]
    last[-1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z if asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _MULT)]))
    table = _BYTE[_LOWER] if lower else _BYTE
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * power[:-1])])
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _MULT_INV)]))
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_buckets(data: np.ndarray, offsets: np.ndarray, bits: int, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed letter words of each row (buckets of 2^bits, sorted) and their counts.

    For each number in ``prefixes``, longer words also count by so many first bytes.
    """
    starts, ends, before = word_spans(data, offsets, NO_LETTER)
    row = rows_of(np.diff(before))
    pairs = [row << bits | (word_hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64)]
    for n in prefixes:
        longer = ends - starts > n
        heads = mix64(word_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n))
        pairs.append(row[longer] << bits | (heads >> np.uint64(64 - bits)).astype(np.int64))
    pairs = np.unique(np.concatenate(pairs))
    return pairs & ((1 << bits) - 1), np.bincount(pairs >> bits, minlength=len(offsets) - 1)


def rows_of(counts: np.ndarray) -> np.ndarray:
    """Row number of each of the ``counts[i]`` members of row i."""
    return np.repeat(np.arange(len(counts)), counts)
