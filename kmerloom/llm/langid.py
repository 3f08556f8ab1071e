"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, crc_fold, frugal, release, slices, text_slice, utf8

#: The sample that is learned from: labelled texts in order of a hash, of a longer one a slice of
#: about so many bytes at a place by its hash, until a language has so many bytes.
SAMPLE_TEXT_BYTES = 4000
SAMPLE_BYTES = 24_000
#: Symbols of the pieces of texts that are parsed side by side.
PIECE = 256
#: Bytes of texts that are parsed at a time, over all languages.
UNIT_BYTES = 1 << 21

_CLASS = np.zeros(256, np.int64)
for _i in range(26):
    _CLASS[ord("a") + _i] = _CLASS[ord("A") + _i] = 1 + _i
_CLASS[128:] = np.arange(27, 155)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters as classes 1 on, each run of other bytes as one 0; and the offsets of the rows.

    Bytes from 128 on are classes of their own; Latin-1 capitals count as small letters.
    """
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        if capital.any():
            data = data.copy()
            data[1:][capital] += 0x20
    classes = _CLASS[data]
    kept = np.ones(len(data), bool)
    kept[1:] = (classes[1:] != 0) | (classes[:-1] != 0)
    inner = offsets[:-1][offsets[:-1] < len(data)]
    kept[inner] = True
    return classes[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the least automaton of all substrings; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
        last = new
    return moves


class CrossParser:
    """Suffix automata of several languages in one table of moves.

    A phrase is the longest match in a language's sample from where the last one ended; a symbol
    that the sample lacks is a phrase of its own. The fewer phrases, the lower the cross entropy.
    """

    def __init__(self, samples: dict[str, list[np.ndarray]]):
        self.languages = sorted(samples)
        seen = sorted({int(c) for texts in samples.values() for t in texts for c in t})
        self.width = len(seen) + 1
        self.code = np.full(155, self.width - 1, np.int64)
        self.code[seen] = np.arange(len(seen))
        tables, self.roots, base = [np.zeros(self.width, np.int64)], [], 1
        for language in self.languages:
            joined = [int(c) for t in samples[language] for c in [*self.code[t], self.code[0]]]
            moves = suffix_automaton(joined)
            table = np.zeros((len(moves), self.width), np.int64)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    table[state, c] = (base + to) * self.width
            table[:, self.width - 1] = 0
            tables.append(table.ravel())
            self.roots.append(base * self.width)
            base += len(moves)
        self.table = np.concatenate(tables).astype(np.int32)
        self.roots = np.array(self.roots, np.int64)[:, None]
        first = self.table[self.roots + np.arange(self.width)] if len(self.languages) else np.zeros((0, self.width), np.int64)
        self.first = np.where(first == 0, self.roots, first).astype(np.int64)

    def phrases(self, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each row, each row parsed greedily from its start to its end.

        Pieces of PIECE symbols are parsed side by side as if a phrase began with each. Where the
        piece before ends amid a phrase, that phrase is carried on into the piece until both
        parses are in the same state, from where they agree; a piece that they leave in different
        states hands its own end on to the next.
        """
        coded, n = self.code[classes], np.diff(offsets)
        pieces = -(-n // PIECE)
        row = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
        start = offsets[:-1][row] + nth * PIECE
        size = np.minimum(PIECE, offsets[1:][row] - start)
        # by step and piece, the longest pieces first, so that a step reads and writes one run of memory
        order = np.argsort(-size, kind="stable")
        row, nth, start, size = row[order], nth[order], start[order], size[order]
        after = np.full(len(row) + 1, -1)
        after[order] = np.arange(len(row))
        after = after[order + 1]
        after[after >= 0] = np.where(nth[after[after >= 0]] > 0, after[after >= 0], -1)
        steps, languages = int(size.max(initial=0)), len(self.languages)
        running = np.searchsorted(-size, -np.arange(steps), side="left")
        symbol = np.zeros((steps, len(row)), np.int32)
        states = np.zeros((steps, languages, len(row)), np.int32)
        begins = np.zeros((steps, languages, len(row)), bool)
        state = np.repeat(self.roots, len(row), axis=1)
        for i, k in enumerate(running):
            c = symbol[i, :k] = coded[start[:k] + i]
            now = state[:, :k]
            to = self.table.take(now + c, mode="clip")
            failed = to == 0
            begins[i, :, :k] = failed | (now == self.roots)
            state[:, :k] = np.where(failed, self.first[:, c], to)
            states[i, :, :k] = state[:, :k]
        piece = np.flatnonzero(after >= 0)
        language, piece = np.repeat(np.arange(languages), len(piece)), np.tile(piece, languages)
        while len(piece):
            now = states[size[piece] - 1, language, piece].astype(np.int64)
            language, piece = self._carry_on(symbol, size, states, begins, language, after[piece], now)
            more = after[piece] >= 0
            language, piece = language[more], piece[more]
        each = begins.sum(axis=0)
        return np.stack([np.bincount(row, x, len(n)).astype(np.int64) for x in each]) if languages else np.zeros((0, len(n)), np.int64)

    def _carry_on(self, symbol, size, states, begins, language, piece, now) -> tuple[np.ndarray, np.ndarray]:
        """Parse the pieces from the states before them; returns those whose own end has changed."""
        changed = []
        for i in range(len(symbol)):
            over = size[piece] <= i
            if over.any():
                changed.append((language[over], piece[over]))
                language, piece, now = language[~over], piece[~over], now[~over]
            if not len(piece):
                break
            c = symbol[i, piece]
            to = self.table.take(now + c, mode="clip")
            failed = to == 0
            begins[i, language, piece] = failed | (now == self.roots[language, 0])
            now = np.where(failed, self.first[language, c], to)
            apart = states[i, language, piece] != now
            states[i, language, piece] = now
            language, piece, now = language[apart], piece[apart], now[apart]
        changed.append((language, piece))
        return tuple(np.concatenate([x[k] for x in changed]) for k in (0, 1))


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2) -> CrossParser:
    """A parser of the labelled rows outside the held-out fold.

    The sample's bound is SAMPLE_BYTES a language, whatever the number of rows with one id: of
    equal slices only one is taken, and levels of a hash choose which rows are collected.
    """
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "text", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 1).alias("h"))
    # half of the texts have level 0, a quarter 1, ...: the levels from the top down that fill the budget
    level = F.floor(63 - F.log2(F.col("h").cast("double") + 1)).cast("int")
    taken = F.least(F.octet_length("text"), F.lit(SAMPLE_TEXT_BYTES)).cast("long")
    # rows with one id and text have one hash, so that counting a hash once counts the text once
    sizes = usable.groupBy("lang", "h").agg(F.max(taken).alias("size")).groupBy("lang", level.alias("level")).agg(F.sum("size").alias("size"))
    least: dict[str, int] = {}
    filled: dict[str, int] = {}
    for r in sorted(sizes.collect(), key=lambda r: -r.level):
        if filled.get(r.lang, 0) < SAMPLE_BYTES:
            least[r.lang] = r.level
            filled[r.lang] = filled.get(r.lang, 0) + r.size
    if not least:
        return CrossParser({})
    levels = docs.sparkSession.createDataFrame(list(least.items()), "lang string, least int")
    piece = text_slice(F.col("text"), F.col("h"), SAMPLE_TEXT_BYTES)
    rows = usable.join(F.broadcast(levels), "lang").where(level >= F.col("least")).select("lang", "h", piece.alias("text")).distinct().collect()
    samples: dict[str, list[np.ndarray]] = {}
    sizes_of: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.text)):
        left = SAMPLE_BYTES - sizes_of.setdefault(r.lang, 0)
        raw = np.frombuffer(r.text.encode()[:left].decode(errors="ignore").encode(), np.uint8)
        if len(raw):
            samples.setdefault(r.lang, []).append(symbols(raw, np.array([0, len(raw)]))[0])
            sizes_of[r.lang] += len(raw)
    return CrossParser(samples)


def judge(parser: CrossParser, column: pa.Array):
    """(first row, row after the last, names, scores) for runs of rows of a text column."""
    data, offsets = utf8(column)
    for a, b in slices(offsets, UNIT_BYTES // max(1, len(parser.languages))):
        names, scores = [], np.zeros(b - a)
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        classes, where = symbols(part, at)
        ascii_letters = np.concatenate([[0], np.cumsum((classes > 0) & (classes < 27))])[where]
        rates = parser.phrases(classes, where) if parser.languages else np.zeros((0, b - a))
        for i in range(b - a):
            lettered = ascii_letters[i + 1] > ascii_letters[i] or any(map(str.isalpha, part[at[i] : at[i + 1]].tobytes().decode()))
            if not lettered or not parser.languages:
                names.append("und")
                continue
            best = int(rates[:, i].argmin())
            others = np.delete(rates[:, i], best)
            names.append(parser.languages[best])
            scores[i] = (others.min() - rates[best, i]) / others.min() if len(others) else 1.0
        yield a, b, names, scores


def identify(docs: DataFrame, parser: CrossParser, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row.

    The prediction is ``und`` with score 0 where text is null or has no letter, or nothing was
    learned. Ties go to the language whose name is first. The score is how much fewer phrases
    the winner needs than the next, as a share (1 if there is but one language). Only the text
    of a row is used; rows with equal ids are predicted each by itself.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(parser)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for a, b, names, scores in judge(shipped.value, batch.column("text")):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    fold = (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out")
    return docs.select("doc_id", fold, "text").mapInArrow(frugal(run), schema)


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for which :func:`identify` names a language, unchanged.

    Rejected: ``und`` (no letter, null). A tie between learned languages is no reason to reject:
    short texts need few phrases in any of them. Where nothing can be learned (no labelled row),
    every text with a letter is accepted. Only texts go to Python and only names come back.
    """
    text = F.col(f"`{text_col}`")
    parser = learn(docs)
    if not parser.languages:
        return docs.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    shipped = docs.sparkSession.sparkContext.broadcast(parser)

    @F.arrow_udf("string")
    def name(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            found = []
            for at in range(0, len(column), BATCH_ROWS):
                found += [n for *_, names, _ in judge(shipped.value, column.slice(at, BATCH_ROWS)) for n in names]
            yield pa.array(found, pa.string())
        release()

    return docs.where(name(text) != "und")


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; see :func:`identify`."""
    docs = docs.select("doc_id", "text", "lang")
    return identify(docs, learn(docs))
