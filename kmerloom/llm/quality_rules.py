"""Quality rules: base counts, and content or boilerplate lines from a linear-chain random field."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, mix64, one_of_each_id, rows_of, slices, text_slice, utf8, word_hashes, word_spans

#: A text with fewer words, or with a larger percentage of repeated words, fails whatever its lines are.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Percentage of words in content lines from which a text is kept.
LEAST_CONTENT = 50
#: The field is trained on so many labelled texts of at most so many bytes each.
SAMPLE_DOCS, SAMPLE_TEXT_BYTES = 2500, 20_000
STEPS, RATE, DECAY = 120, 0.1, 1e-3
CONTENT, BOILERPLATE = 1, 0

_SYMBOL, _UPPER, _DIGIT, _SHOUT, _MARK, _INNER, _STOP = (np.zeros(256, bool) for _ in range(7))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SHOUT[list(b"!?")] = True
_MARK[list(b"\"'()+,-./:;=@[\\]^_`{}~")] = True
_INNER[0x80:0xC0] = True
_STOP[list(b".!?:;\"')")] = True
_THREE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass
class Texts:
    """Counts of the rows of a batch and features of their lines, one line after another."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: np.ndarray  # number of lines of each row
    line_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)


def _later(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which members equal an earlier member of their group (groups rise)."""
    order = np.lexsort((np.arange(len(keys)), keys, group))
    same = np.zeros(len(keys), bool)
    if len(keys):
        k, g = keys[order], group[order]
        same[order[1:]] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    return same


def _twice(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which members equal another member of their group."""
    order = np.argsort(mix64(keys ^ (group.astype(np.uint64) * _THREE[0])), kind="stable")
    k, g = keys[order], group[order]
    equal = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= equal
    out[order[:-1]] |= equal
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> Texts:
    n = len(offsets) - 1
    starts, ends, before = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=False)
    n_words = np.diff(before)
    row = rows_of(n_words)
    sums = {}
    for name, table in (("symbol", _SYMBOL), ("upper", _UPPER), ("digit", _DIGIT), ("shout", _SHOUT), ("mark", _MARK), ("inner", _INNER)):
        sums[name] = np.concatenate([[0], np.cumsum(table[data])])
    sizes = np.bincount(row, (ends - starts) - (sums["inner"][ends] - sums["inner"][starts]), n).astype(np.int64)
    symbols = sums["symbol"][offsets[1:]] - sums["symbol"][offsets[:-1]]
    # three words in a row
    inside = np.flatnonzero(np.arange(len(words)) + 2 < before[1:][row]) if len(words) else np.zeros(0, np.int64)
    covered = np.zeros(len(words) + 3, bool)
    if len(inside):
        three = mix64(words[inside] * _THREE[0] + words[inside + 1] * _THREE[1] + words[inside + 2] * _THREE[2])
        found = inside[_twice(three, row[inside])]
        for k in range(3):
            covered[found + k] = True
    repeated = np.bincount(row, covered[: len(words)], n).astype(np.int64)
    # lines
    cut = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    cut_row = np.searchsorted(offsets, cut, side="right") - 1
    lines = 1 + np.bincount(cut_row, minlength=n).astype(np.int64)
    line_row = rows_of(lines)
    # a text that ends in a line break and the next text start at one place: the order of rows decides
    first = np.cumsum(lines) - lines
    line_start = np.zeros(len(line_row), np.int64)
    line_start[first] = offsets[:-1]
    rest = np.ones(len(line_row), bool)
    rest[first] = False
    line_start[rest] = cut + 1
    last = np.zeros(len(line_row), bool)
    last[np.cumsum(lines) - 1] = True
    line_end = np.empty(len(line_row), np.int64)
    line_end[last] = offsets[1:]
    line_end[~last] = cut
    word_line = np.searchsorted(line_start, starts, side="right") - 1
    line_words = np.bincount(word_line, minlength=len(line_row)).astype(np.int64)
    line_hash = word_hashes(data, line_start, line_end, lower=False)
    with_word = np.flatnonzero(line_words)
    duplicate = np.zeros(len(line_row), bool)
    duplicate[with_word] = _later(line_hash[with_word], line_row[with_word])
    again = _later(words, word_line)
    size = np.maximum(line_end - line_start, 1)
    share = lambda name: (sums[name][line_end] - sums[name][line_start]) / size
    stop = np.zeros(len(line_row))
    full = line_end > line_start
    stop[full] = _STOP[data[line_end[full] - 1]]
    per_word = np.maximum(line_words, 1)
    features = np.stack([
        np.ones(len(line_row)), 5 * share("symbol"), 2 * share("upper"), 2 * share("digit"), 5 * share("shout"), 3 * share("mark"),
        np.log1p(line_words) / 3, duplicate, np.bincount(word_line, again, len(line_row)) / per_word, stop,
        np.minimum(size / per_word, 40) / 10, line_words == 0, np.bincount(word_line, covered[: len(words)], len(line_row)) / per_word,
    ], axis=1).astype(np.float64)
    dup_lines = np.bincount(line_row, duplicate, n).astype(np.int64)
    return Texts(n_words, sizes, symbols, dup_lines, repeated, lines, line_words, features)


class Chains:
    """Sequences side by side: position t of all sequences that have one is a slice of lanes."""

    def __init__(self, lines: np.ndarray):
        self.order = np.argsort(-lines, kind="stable")
        self.sizes = lines[self.order]
        self.first = (np.cumsum(lines) - lines)[self.order]
        self.steps = int(self.sizes[0]) if len(lines) else 0
        self.running = np.searchsorted(-self.sizes, -np.arange(self.steps), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.running[t]] + t


@dataclass
class LineField:
    """A linear-chain conditional random field of two labels."""

    emission: np.ndarray  # features x labels
    transition: np.ndarray  # from x to

    def viterbi(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The likeliest labels; ties go to boilerplate."""
        scores, chains = features @ self.emission, Chains(lines)
        labels = np.zeros(len(features), np.int8)
        if not chains.steps:
            return labels
        best = scores[chains.at(0)].copy()
        back = np.zeros((len(features), 2), np.int8)
        for t in range(1, chains.steps):
            at = chains.at(t)
            via = best[: len(at), :, None] + self.transition[None]
            back[at] = via.argmax(axis=1)
            best[: len(at)] = via.max(axis=1) + scores[at]
        state = best.argmax(axis=1).astype(np.int8)
        for t in range(chains.steps - 1, -1, -1):
            at = chains.at(t)
            labels[at] = state[: len(at)]
            if t:
                state[: len(at)] = back[at, state[: len(at)]]
        return labels

    def gradient(self, features: np.ndarray, lines: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the weighted log-likelihood: observed less expected counts, by forward and backward sums."""
        scores, chains = features @ self.emission, Chains(lines)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        add = lambda x, axis: np.logaddexp(*np.moveaxis(x, axis, 0))
        forward[chains.at(0)] = scores[chains.at(0)]
        for t in range(1, chains.steps):
            at = chains.at(t)
            forward[at] = add(forward[at - 1][:, :, None] + self.transition[None], 1) + scores[at]
        total = np.zeros(len(features))
        ends = np.cumsum(lines) - 1
        z = add(forward[ends], 1)
        total[:] = z[rows_of(lines)]
        expected = np.zeros((2, 2))
        observed = np.zeros((2, 2))
        w = weight[rows_of(lines)]
        for t in range(chains.steps - 1, 0, -1):
            at = chains.at(t)
            to = scores[at] + backward[at]
            pair = np.exp(forward[at - 1][:, :, None] + self.transition[None] + to[:, None, :] - total[at][:, None, None])
            expected += (pair * w[at][:, None, None]).sum(axis=0)
            np.add.at(observed, (labels[at - 1], labels[at]), w[at])
            backward[at - 1] = add(self.transition[None] + to[:, None, :], 2)
        marginal = np.exp(forward + backward - total[:, None])
        truth = np.zeros_like(marginal)
        truth[np.arange(len(labels)), labels] = 1
        return features.T @ ((truth - marginal) * w[:, None]), observed - expected


def fit_field(features: np.ndarray, lines: np.ndarray, quality: np.ndarray) -> LineField:
    """Train on texts of known quality: lines of good texts are content, of bad ones boilerplate.

    The second half of the steps lets the field relabel lines of bad texts, so that ordinary
    lines in them do not count as boilerplate. Both kinds of texts weigh the same in all.
    """
    field = LineField(np.zeros((features.shape[1], 2)), np.zeros((2, 2)))
    if not len(lines) or len(set(quality.tolist())) < 2:
        field.emission[0] = [-1.0, 1.0]
        return field
    row = rows_of(lines)
    labels = quality[row].astype(np.int8)
    weight = np.where(quality == 1, 1 / max(1, (quality == 1).sum()), 1 / max(1, (quality == 0).sum()))
    moments = [np.zeros_like(field.emission), np.zeros_like(field.transition)]
    squares = [np.zeros_like(field.emission), np.zeros_like(field.transition)]
    for step in range(1, STEPS + 1):
        if step == STEPS // 2:
            labels = np.where(quality[row] == 1, CONTENT, field.viterbi(features, lines)).astype(np.int8)
        for k, (value, g) in enumerate(zip((field.emission, field.transition), field.gradient(features, lines, labels, weight), strict=True)):
            g = g - DECAY * value
            moments[k] = 0.9 * moments[k] + 0.1 * g
            squares[k] = 0.99 * squares[k] + 0.01 * g * g
            value += RATE * (moments[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
    return field


def learn(docs: DataFrame, labels: DataFrame) -> LineField:
    """A field of at most SAMPLE_DOCS labelled texts, in the order of a hash of their ids, one row an id.

    Of a text of more than SAMPLE_TEXT_BYTES a part of about that size at a hashed place is learned from.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("lines"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.where("quality = 1").orderBy(order).limit(SAMPLE_DOCS // 2).unionByName(known.where("quality = 0").orderBy(order).limit(SAMPLE_DOCS // 2))
    texts = one_of_each_id(docs.where("text IS NOT NULL").join(F.broadcast(some), "doc_id"), "quality", "text")
    rows = texts.select("quality", "h", text_slice(F.col("text"), F.col("h"), SAMPLE_TEXT_BYTES).alias("text")).orderBy("h").collect()
    raw = [r.text.encode() for r in rows]
    t = measure(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    return fit_field(t.features, t.lines, np.array([1 if r.quality else 0 for r in rows], np.int64))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, field: LineField) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``content_words`` of every row.

    Null and empty texts have no words and fail. A text is kept if it does not fail and at least
    LEAST_CONTENT percent of its words are in lines marked as content. Rows with equal ids are
    judged each by itself.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_words", T.LongType())])

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                t = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                marked = shipped.value.viterbi(t.features, t.lines)
                content = np.bincount(rows_of(t.lines), t.line_words * (marked == CONTENT), b - a).astype(np.int64)
                kept = ~t.base_failed & (100 * content >= LEAST_CONTENT * t.n_words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(getattr(t, c).astype(np.int64)) for c in _COUNTS], pa.array(t.base_failed), pa.array(kept), pa.array(content)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_rules(docs, learn(docs.select("doc_id", "text"), labels))
