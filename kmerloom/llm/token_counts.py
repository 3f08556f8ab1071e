"""Token counts from distinct pre-tokens: pieces are counted once, frequencies are joined."""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, slices, utf8, written

#: Bytes of text whose pre-tokens share one dictionary.
BLOCK_BYTES = 48 << 20
#: The set of all pre-tokens is counted in at least so many parts, and in so many a shuffle partition.
LEAST_BUCKETS, BUCKETS_A_PARTITION = 512, 4

# The byte-level splitting pattern and the white space it means.
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_BLOCK = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("n_bytes", T.ArrayType(T.LongType())),
    T.StructField("packed", T.BinaryType()),
])


@lru_cache(maxsize=2)
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def splitter(path: str):
    """Splits a text into pre-tokens; added tokens of the file stay whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} does not split texts as a plain byte-level vocabulary does")
    words = regex.compile(_SPLIT).findall
    added = [t.content for t in library_tokenizer(path).get_added_tokens_decoder().values()]
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def split(text: str) -> list[str]:
        if special is None or not special.search(text):
            return words(text)
        out = []
        for i, part in enumerate(special.split(text)):
            out += [part] if i % 2 else words(part)
        return out

    return split


def _planes(*columns: np.ndarray) -> bytes:
    """32-bit columns of one length, byte by byte, compressed."""
    return zstandard.compress(b"".join(c.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns), 3)


def _columns(raw: bytes, k: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(k, 4, -1)
    return [np.ascontiguousarray(p.T).view(np.int32).ravel() for p in planes]


def pack_rows(rows: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Rows of dictionary places (rising, kept as differences) and frequencies."""
    counts = np.array([len(r[0]) for r in rows], np.int32)
    steps = [np.diff(r[0], prepend=0) for r in rows]
    empty = [np.zeros(0, np.int32)]
    body = _planes(np.concatenate(steps or empty), np.concatenate([r[1] for r in rows] or empty) - 1)
    return len(counts).to_bytes(4, "little") + counts.tobytes() + body


def unpack_rows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    counts = np.frombuffer(raw, np.int32, n, 4).astype(np.int64)
    steps, less = _columns(raw[4 + 4 * n :], 2)
    run = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate([[0], run])[np.cumsum(counts) - counts]
    return counts, run - np.repeat(before, counts), less + 1


def pack_words(places: list[int], words: list[str]) -> bytes:
    column = pa.array(words, pa.string())
    _, where, data = column.buffers()
    text = zstandard.compress((data.to_pybytes() if data else b""), 3)
    head = _planes(np.array(places), np.diff(np.frombuffer(where, np.int32, len(words) + 1)))
    return len(head).to_bytes(4, "little") + head + text


def unpack_words(raw: bytes) -> tuple[np.ndarray, list[str]]:
    n = int.from_bytes(raw[:4], "little")
    places, sizes = _columns(raw[4 : 4 + n], 2)
    where = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    column = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(where.tobytes()), pa.py_buffer(zstandard.decompress(raw[4 + n :])))
    return places, column.to_pylist()


def bucket_count(partitions: int) -> int:
    """Parts of the set of all pre-tokens: they grow with the cluster's shuffle partitions, so that
    neither the tasks that count nor what one of them remembers is held to a fixed number."""
    return max(LEAST_BUCKETS, BUCKETS_A_PARTITION * partitions)


def pre_token_blocks(docs: DataFrame, path: str, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Per block of documents: their pre-token frequencies by place in the block's dictionary
    (bucket null), and the dictionary in rows of the words of one of ``buckets`` parts."""

    def run(batches):
        split = splitter(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            _, offsets = utf8(batch.column("text"))
            lengths = np.diff(offsets)
            for a, b in slices(offsets, BLOCK_BYTES):
                place: dict[str, int] = defaultdict()
                place.default_factory = place.__len__
                rows = []
                for text in batch.column("text").slice(a, b - a):
                    found = Counter(split(text.as_py() or ""))
                    at, n = np.fromiter(map(place.__getitem__, found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
                    order = np.argsort(at)
                    rows.append((at[order], n[order]))
                packed = pack_rows(rows)
                name = xxhash.xxh64_intdigest(packed + repr(ids[a:b]).encode()) - 2**63
                parts: dict[int, tuple[list[int], list[str]]] = {}
                for word in sorted(place):
                    places, words = parts.setdefault(zlib.crc32(word.encode()) % buckets, ([], []))
                    places.append(place[word])
                    words.append(word)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (n + 1), pa.int64()), pa.array([None, *parts], pa.int32()), pa.array([ids[a:b], *[None] * n], pa.list_(pa.int64())), pa.array([lengths[a:b].tolist(), *[None] * n], pa.list_(pa.int64())), pa.array([packed, *[pack_words(*x) for x in parts.values()]], pa.binary())],
                    names=_BLOCK.names,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run, None), _BLOCK)


def count_pieces(dictionaries: DataFrame, path: str) -> DataFrame:
    """``block, packed`` (places and pieces) of ``block, bucket, packed``: each distinct pre-token is cut once.

    A bucket's rows come from all blocks to one place, one after another; what a row has in
    common with those before it is known already. What is remembered at a time is one bucket's
    share of all distinct pre-tokens.
    """

    def run(batches):
        tokenizer = library_tokenizer(path)
        bucket, known = None, {}
        for batch in batches:
            packed = []
            for own, raw in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                places, words = unpack_words(raw)
                fresh = [w for w in words if w not in known]
                for at in range(0, len(fresh), 4096):
                    part = fresh[at : at + 4096]
                    known.update(zip(part, (len(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
                packed.append(_planes(places, np.fromiter(map(known.__getitem__, words), np.int64, len(words))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], names=["block", "packed"])

    parts = int(dictionaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dictionaries.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(run, None), "block long, packed binary")


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Every distinct pre-token of the corpus is cut into pieces once; documents hold only
    frequencies, kept per block against a dictionary of that block, so that what is shuffled is
    each block's distinct pre-tokens and not every document's. Null text is empty: no bytes, no
    tokens. Repeated rows are counted each for itself.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(pre_token_blocks(docs, path, bucket_count(partitions)), "pre-tokens")
    counted = count_pieces(blocks.where("bucket IS NOT NULL").select("block", "bucket", "packed"), path)
    tables = counted.groupBy("block").applyInArrow(_table, "block long, pieces binary")
    joined = blocks.where("bucket IS NULL").select("block", "doc_ids", "n_bytes", "packed").join(tables, "block", "left")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts, idx, freq = unpack_rows(row["packed"])
                pieces = np.frombuffer(row["pieces"] or b"", np.int32)
                ends = np.concatenate([[0], np.cumsum(freq.astype(np.int64) * pieces[idx])])
                stops = np.cumsum(counts)
                totals = ends[stops] - ends[stops - counts]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(totals, pa.int64()), pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return joined.mapInArrow(frugal(run, None), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _table(table: pa.Table) -> pa.Table:
    """Pieces of a block's pre-tokens in dictionary order; a block's dictionary is bounded by BLOCK_BYTES."""
    rows = [_columns(raw, 2) for raw in table.column("packed").to_pylist()]
    pieces = np.zeros(sum(len(p) for p, _ in rows), np.int32)
    for places, n in rows:
        pieces[places] = n
    return pa.table({"block": table.column("block").slice(0, 1), "pieces": pa.array([pieces.tobytes()], pa.binary())})
