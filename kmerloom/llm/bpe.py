"""Byte-pair encoding with a priority queue over a linked symbol list, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal

#: Distinct words whose ids a worker remembers (in each of two generations).
REMEMBERED_WORDS = 125_000

# White space of the tokenizer's regular expressions.
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class HeapBPE:
    """Encoder and decoder of one vocabulary file.

    The file must hold a BPE model whose words end in a suffix, the normalisers NFC, white space
    to a blank and lower case, and a splitting pattern whose matches are the words.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [(n["type"], (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if steps != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]:
            raise ValueError(f"{path} has other normalisers than NFC, white space to a blank and lower case")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.added.items()]}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[self.vocab[left] << 32 | self.vocab[right]] = (rank, self.vocab[left + right])
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.words = regex.compile(split)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges in order of rank, the leftmost first among equals."""
        n = len(symbols)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        merges = self.merges
        queue = []
        for i in range(n - 1):
            if (m := merges.get(symbols[i] << 32 | symbols[i + 1])) is not None:
                queue.append(m[0] << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            if symbols[i] < 0 or (j := after[i]) < 0:
                continue
            m = merges.get(symbols[i] << 32 | symbols[j])
            if m is None or m[0] != entry >> 32:
                continue  # stale: a symbol has changed since the entry was queued
            symbols[i] = m[1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := merges.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(queue, m[0] << 32 | i)
            if (h := before[i]) >= 0 and (m := merges.get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(queue, m[0] << 32 | h)
        return [s for s in symbols if s >= 0]

    def word_ids(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        found = self.older.get(word)
        if found is None:
            raw = word.encode()
            symbols = [self.inner[b] for b in raw[:-1]]
            symbols.append(self.final[raw[-1]])
            found = np.array(self.merge(symbols), dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    @staticmethod
    def normalize(text: str) -> str:
        if text.isascii():
            return text.lower()
        # one character at a time, a capital sigma has no other form at the end of a word
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        out = []
        for part in parts:
            if (token := self.added.get(part)) is not None:
                out.append(token.to_bytes(4, "little"))
                continue
            for word in self.words.findall(self.normalize(part)):
                ids = self.known.get(word)
                out.append(self.word_ids(word) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings of the ids, special ones too, with blanks between."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> HeapBPE:
    return HeapBPE(path)


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each row with ``n_tokens``, ``ids`` and ``decoded`` (what the ids decode to).

    Null text counts as empty: no ids and an empty decoded text. Each document is encoded by
    itself, so ties, repeats and order do not matter; other columns are left out.
    """
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                raw = [bpe.encode(t.as_py() or "") for t in part.column("_text")]
                where = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(where), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                decoded = pa.array([bpe.decode(r) for r in raw], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(np.diff(where).astype(np.int64)), ids, decoded], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).mapInArrow(frugal(run), schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; the ids stay in the task."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column("text"):
                raw = bpe.encode(text.as_py() or "")
                counts.append(len(raw) // 4)
                first.append(hashlib.sha256(raw).hexdigest())
                second.append(hashlib.sha256(bpe.decode(raw).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=schema.names)

    return docs.mapInArrow(frugal(run), schema)
