"""K-mers as two-bit codes, made from Arrow batches of sequences.

A code is a few words of at most WORD bases each, so that it is a positive BIGINT and words
compare as the strings do. Windows with a letter other than ACGT are no k-mers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 31
#: Bases that are coded at a time.
SLICE = 1 << 20

_CODE = np.full(256, 4, np.int64)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
# Flags of the base before and after, by code.
_BEFORE = np.array([0x80, 0x40, 0x20, 0x10, 0], np.int64)
_AFTER = np.array([0x01, 0x02, 0x04, 0x08, 0], np.int64)


def words_of(k: int) -> list[tuple[int, int]]:
    """(first base, bases) of each word of a k-mer."""
    return [(at, min(WORD, k - at)) for at in range(0, k, WORD)]


def _segments(bases: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n bases from each place on, and of their reverse complement, by doubling."""
    forward, backward, size = np.zeros(len(bases) + 1, np.int64), np.zeros(len(bases) + 1, np.int64), 0
    one, other, have = bases, 3 - bases, 1
    while True:
        if n & have:
            count = len(bases) - size - have + 1
            forward, backward = forward[:count] << 2 * have | one[size : size + count], other[size : size + count] << 2 * size | backward[:count]
            size += have
        if 2 * have > n:
            return forward, backward
        m = len(one) - have
        one, other, have = one[:m] << 2 * have | one[have : have + m], other[have : have + m] << 2 * have | other[:m], 2 * have


def occurrences(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Row, words and edge flags of the canonical k-mer at each window of rows of letters."""
    bases = _CODE[data]
    if len(bases) < k:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in words_of(k)], np.zeros(0, np.int64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(bases))
    wrong = np.concatenate([[0], np.cumsum(bases > 3)])
    at = place[: len(bases) - k + 1]
    at = at[(at + k <= offsets[1:][row[at]]) & (wrong[at + k] == wrong[at])]
    row = row[at]
    before = np.where(at > offsets[:-1][row], bases[np.maximum(at - 1, 0)], 4)
    after = np.where(at + k < offsets[1:][row], bases[np.minimum(at + k, len(bases) - 1)], 4)
    clean = np.minimum(bases, 3)
    made = {n: _segments(clean, n) for n in {n for _, n in words_of(k)}}
    own = [made[n][0][at + first] for first, n in words_of(k)]
    reverse = [made[n][1][at + k - first - n] for first, n in words_of(k)]
    forward, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
    for a, b in zip(own, reverse, strict=True):
        forward |= equal & (a < b)
        equal &= a == b
    forward |= equal
    flags = _BEFORE[before] | _AFTER[after]
    turned = (flags << 4 | flags >> 4) & 255
    return row, [np.where(forward, a, b) for a, b in zip(own, reverse, strict=True)], np.where(forward, flags, turned)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, min(n, end)
        at = end


def names(k: int) -> list[str]:
    return [f"w{i}" for i in range(len(words_of(k)))]


def schema(k: int) -> str:
    return ", ".join([*[f"{n} long" for n in names(k)], "color int", "coverage long", "edges int"])


def counter(k: int):
    """For mapInArrow over ``color, seq``: words, color, coverage and edges, summed within each slice."""

    def run(batches):
        for batch in batches:
            column = batch.column("seq").cast(pa.large_string()).fill_null("")
            _, where, raw = column.buffers()
            offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            colors = batch.column("color").to_numpy(zero_copy_only=False)
            for a, b in _slices(offsets):
                row, words, flags = occurrences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                if not len(row):
                    continue
                own = colors[a:b][row]
                for color in np.unique(own):
                    mine = np.flatnonzero(own == color)
                    keys = [w[mine] for w in words]
                    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
                    keys = [x[order] for x in keys]
                    new = np.zeros(len(order), bool)
                    new[0] = True
                    for x in keys:
                        new[1:] |= x[1:] != x[:-1]
                    first = np.flatnonzero(new)
                    count = np.diff(np.append(first, len(order)))
                    edges = np.bitwise_or.reduceat(flags[mine[order]], first)
                    yield pa.RecordBatch.from_arrays([*[pa.array(x[first]) for x in keys], pa.array(np.full(len(first), color, np.int32)), pa.array(count), pa.array(edges.astype(np.int32))], names=[*names(k), "color", "coverage", "edges"])

    return run


def text(k: int) -> Column:
    """The string of the words ``w0, w1, ...``."""
    from . import dna

    return F.concat(*[dna.unpack(f"w{i}", n) for i, (_, n) in enumerate(words_of(k))])
