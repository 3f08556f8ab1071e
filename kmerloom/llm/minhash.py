"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_name, frugal, mix64, rows_of, slices, utf8, word_hashes, word_spans, written
from .components import components

WORDS = 5
#: A link: SHARE[1] * common >= SHARE[0] * united shingles.
SHARE = (75, 100)
BANDS, ROWS = 40, 5
#: Probability with which one look at the signatures may drop a pair at the threshold.
MISS = 1e-6
#: The same for the first look, at one bit of each minimum, while a bucket is joined.
MISS_IN_BUCKET = 1e-5
#: Minima compared before each look at the posterior.
BATCH = 40
#: Longs that hold one bit of each minimum in the rows of buckets.
PLANE = -(-BANDS * ROWS // 64)
#: Members of a bucket that are compared with its pivots in one part.
PART = 256
#: Comparisons of sketches for each row of buckets that the last wave may take.
EFFORT = 100
#: Least number that stands for a text in place of an id.
HANDLES = 1 << 61
#: Bits that hold the parity of the number of shingles hashed to each of them.
PARITY = 1024

_RNG = np.random.default_rng(75)
_PLACE = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0x5851F42D4C957F2D)
_FLIP = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle names of each row, one row after another, and their counts."""
    starts, ends, before = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(before)
    total = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        total += words[k : k + len(total)] * _PLACE[k]
    names = mix64(total)
    sets, counts = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n):
        a, b = before[i], before[i + 1]
        if n[i] < WORDS:
            own = mix64((words[a:b] * _PLACE[: n[i]]).sum(dtype=np.uint64, keepdims=True) ^ (_SHORT * n[i : i + 1].astype(np.uint64)))
        else:
            own = np.sort(names[a : b - WORDS + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sets.append(own)
        counts[i] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), counts


def signatures(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of each row's set; rows without shingles get zeros."""
    out = np.zeros((len(counts), BANDS * ROWS), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        short = (names >> np.uint64(32)).astype(np.uint32)
        minima = np.empty((BANDS * ROWS, len(full)), np.uint32)
        for k in range(BANDS * ROWS):
            minima[k] = np.minimum.reduceat((short ^ _FLIP[k]) * _TIMES[k], at)
        out[full] = minima.T
    return out


def parities(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """PARITY bits of each row: whether an odd number of its shingles has that hash.

    Where two rows differ in a bit, at least one shingle is in one of them only, so the number of
    unequal bits never exceeds the number of shingles that they do not share.
    """
    place = rows_of(counts) * PARITY + (mix64(names + np.uint64(5)) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=len(counts) * PARITY) & 1).astype(np.uint8).reshape(-1, PARITY), axis=1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, signature, parity``: h1 and h2 name the whole set."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                names, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(counts)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(names ^ np.uint64(salt)))]) for salt in (11, 12)]
                h1, h2 = (s[ends] - s[ends - counts] for s in sums)
                minima, odd = signatures(names, counts), parities(names, counts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), _long(h1), _long(h2), pa.array([m.tobytes() for m in minima], pa.binary()), pa.array([o.tobytes() for o in odd], pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "signature", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, n_shingles long, h1 long, h2 long, signature binary, parity binary")


def _minima(column: pa.Array) -> np.ndarray:
    data, _ = utf8(column)
    return data.view("<u4").reshape(-1, BANDS * ROWS)


def band_keys(described: DataFrame) -> DataFrame:
    """``key, id``: one row for each band."""

    def run(batches):
        for batch in batches:
            wide = _minima(batch.column("signature")).astype(np.uint64).reshape(-1, BANDS, ROWS)
            keys = np.broadcast_to(_BAND[:, ROWS], wide.shape[:2]).copy()
            for k in range(ROWS):
                keys = mix64(keys ^ (wide[:, :, k] * _BAND[:, k]))
            yield pa.RecordBatch.from_arrays([_long(keys.ravel()), batch.column("id").take(pa.array(rows_of(np.full(len(wide), BANDS))))], names=["key", "id"])

    return described.select("id", "signature").mapInArrow(frugal(run), "key long, id long")


def one_bits(minima: np.ndarray) -> np.ndarray:
    """One bit of each minimum, of a hash of the minimum and its index.

    No bit of the minimum itself: the lowest is a bit of the shingle (xor a constant), so with few
    shingles the bits of all minima would be unequal together.
    """
    index = np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32)
    return (mix64(minima.astype(np.uint64) ^ index) & np.uint64(1)).astype(np.uint8)


def sketches(described: DataFrame) -> DataFrame:
    """``id, n, fame, s0, ..., o0, ...``: one bit of all minima, and the parity bits."""
    names = [*[f"s{i}" for i in range(PLANE)], *[f"o{i}" for i in range(PARITY // 64)]]

    def run(batches):
        for batch in batches:
            minima = _minima(batch.column("signature"))
            bits = np.zeros((len(minima), 64 * PLANE), np.uint8)
            bits[:, : BANDS * ROWS] = one_bits(minima)
            odd, _ = utf8(batch.column("parity"))
            both = np.concatenate([np.packbits(bits, axis=1).view(np.uint64), odd.reshape(len(minima), -1).view(np.uint64)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("fame"), *[_long(both[:, i]) for i in range(len(names))]], names=["id", "n", "fame", *names])

    return described.select("id", "n", "fame", "signature", "parity").mapInArrow(frugal(run), "id long, n long, fame double, " + ", ".join(f"{n} long" for n in names))


@lru_cache(maxsize=64)
def least_matches(seen: int, share: float = SHARE[0] / SHARE[1], miss: float = MISS) -> int:
    """Fewest equal minima of ``seen`` at which P(similarity >= share | matches) is at least ``miss``.

    With a uniform prior this posterior is P(Binomial(seen + 1, share) <= matches).
    """
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * share**m * (1 - share) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen


def most_unequal() -> int:
    """The same bound for one-bit minima, which agree with probability (1 + similarity) / 2."""
    return BANDS * ROWS - least_matches(BANDS * ROWS, (1 + SHARE[0] / SHARE[1]) / 2, MISS_IN_BUCKET)


def plausible(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs whose posterior never falls below MISS while batch after batch is compared."""
    alive = np.arange(len(first))
    matches = np.zeros(len(first), np.int64)
    for at in range(0, BANDS * ROWS, BATCH):
        matches[alive] += (first[alive, at : at + BATCH] == second[alive, at : at + BATCH]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(min(at + BATCH, BANDS * ROWS))]
    return alive


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array([zstandard.decompress(z) for z in column.to_pylist()], pa.large_binary()))


def confirmed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``a, b`` of the rows whose full shingle sets reach the share."""
    names_a, counts_a = shingle_sets(*_texts(batch.column("za")))
    _, first, back = np.unique(batch.column("b").to_numpy(), return_index=True, return_inverse=True)
    names_b, counts_b = shingle_sets(*_texts(batch.column("zb").take(pa.array(first))))
    ea, eb = np.cumsum(counts_a), np.cumsum(counts_b)
    keep = []
    for i in range(len(batch)):
        x, j = names_a[ea[i] - counts_a[i] : ea[i]], back[i]
        y = names_b[eb[j] - counts_b[j] : eb[j]]
        if len(x) > len(y):
            x, y = y, x
        if not len(x):
            continue
        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        if SHARE[1] * common >= SHARE[0] * (len(x) + len(y) - common):
            keep.append(i)
    return batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def verify(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that the sequential test leaves and whose full sets reach the share.

    A pivot of a large group is in many pairs; both sides of the joins are plain exchanges, which
    adaptive execution splits where they are skewed.
    """

    def run(batches):
        for batch in batches:
            alive = plausible(_minima(batch.column("sa")), _minima(batch.column("sb")))
            for at in range(0, len(alive), 256):
                yield confirmed(batch.select(["a", "b", "za", "zb"]).take(pa.array(alive[at : at + 256])))

    side = lambda x: store.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"), F.col("z").alias(f"z{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "za", "zb")
    # a skewed join may be split into many small tasks; workers and files need no more than there are partitions
    parts = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.coalesce(parts).mapInArrow(frugal(run), "a long, b long")


def packed_texts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            z = pa.array([zstandard.compress((t.as_py() or "").encode(), 1) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), z], names=["id", "z"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL").mapInArrow(frugal(run), "id long, z binary")


def represented(described: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """``described`` with the columns of ``reps`` of its set; rows without shingles or id have nulls.

    A set with more than ``most`` copies joins by broadcast, so that its copies stay where they
    are: there are at most rows / most of them.
    """
    named = described.withColumn("h1", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("h1")))
    hot = reps.where(F.col("copies") > most).drop("copies")
    hot = hot.withColumnsRenamed({c: f"hot_{c}" for c in hot.columns})
    named = named.join(F.broadcast(hot), (F.col("h1") == F.col("hot_h1")) & (F.col("h2") == F.col("hot_h2")), "left")
    columns = [c for c in reps.columns if c not in ("h1", "h2", "copies")]
    known = named.where("hot_h1 IS NOT NULL OR h1 IS NULL").select(*described.columns, *[F.col(f"hot_{c}").alias(c) for c in columns])
    others = named.where("hot_h1 IS NULL AND h1 IS NOT NULL").select(*described.columns).join(reps.where(F.col("copies") <= most).drop("copies"), ["h1", "h2"], "left")
    return known.unionByName(others.select(*described.columns, *columns))


def with_handles(docs: DataFrame, described: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``docs`` with a number of their own for texts whose doc_id has several, and ``handle, own_id`` of these.

    Numbers are a hash of id and text beyond HANDLES, so that the least of a component is an id.
    None if no id has several texts with words, which is the rule.
    """
    full = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = full.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")
    if several.isEmpty():
        return None
    handle = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 3) + F.lit(HANDLES)
    marked = docs.join(several.withColumn("several", F.lit(True)), "doc_id", "left").select(F.when(F.col("several"), handle).otherwise(F.col("doc_id")).alias("handle"), "doc_id", "text")
    marked = written(marked, "minhash-handles")
    return marked.select(F.col("handle").alias("doc_id"), "text"), marked.where("handle <> doc_id").select("handle", F.col("doc_id").alias("own_id")).distinct()


def candidates(left: DataFrame, pivots: DataFrame, once: bool) -> DataFrame:
    """Pairs ``a, b`` of a member and a pivot of one bucket and of different components.

    The first look at a pair is part of the join: parity bits, which never reject a link, and one
    bit of each minimum. Members of a bucket are dealt out over one part for each PART of them
    and its pivots go to every part. ``once``: all pairs of pivots are here in both orders.
    """
    parts = F.ceil(F.col("size") / PART).cast("int")
    m = left.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).alias("m")
    p = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("p")
    sizes = F.least("p.n", "m.n") * SHARE[1] >= F.greatest("p.n", "m.n") * SHARE[0]
    unequal = lambda kind, longs: sum((F.bit_count(F.col(f"p.{kind}{i}").bitwiseXOR(F.col(f"m.{kind}{i}"))) for i in range(longs)), F.lit(0))
    # at the share, the shingles not in common are at most (b - a) / (b + a) of the sum of both sizes
    apart = unequal("o", PARITY // 64) * (SHARE[1] + SHARE[0]) <= (F.col("p.n") + F.col("m.n")) * (SHARE[1] - SHARE[0])
    match = (F.col("p.key") == F.col("m.key")) & (F.col("p.part") == F.col("m.part")) & (F.col("p.component") != F.col("m.component")) & sizes & (unequal("s", PLANE) <= most_unequal()) & apart
    if once:
        match = match & ((F.col("m.component") == F.col("m.main")) | (F.col("p.id") < F.col("m.id")))
    # one member has few pivots; dealt out by member for the join that follows
    return m.join(p, match).select(F.col("m.id").alias("a"), F.col("p.id").alias("b")).repartition("a").dropDuplicates(["a", "b"])


def links(docs: DataFrame, described: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components over representatives of equal sets (``id, component``), and the representatives.

    First every bucket's most popular member is compared with all others, which joins nearly all
    of a group of copies in as many comparisons as it has members. Then only buckets whose
    members are still of several components count, and in each only pairs of different
    components: its main component need not be compared with itself, so every member outside it
    is compared with all. Where these would be too many pairs (EFFORT a row), more pivots (16,
    256, ... from outside the main component) go first. So each pair of a bucket is compared or
    connected in the end. ``aliases``: see :func:`with_handles`; the texts of one id are linked.
    """
    rows = described.count()
    most = max(1000, rows // 1000)
    classes = described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "signature", "parity")).alias("r"), F.count("*").alias("copies"))
    reps = written(classes.select("h1", "h2", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), F.col("r.signature").alias("signature"), F.col("r.parity").alias("parity"), "copies"), "minhash-reps")
    bands = band_keys(reps)
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # at most BANDS * rows / most buckets are hot
    hot = shared.where(F.col("size") > most).select("key", F.col("size").alias("many"))
    dealt = bands.join(F.broadcast(hot), "key", "left")
    members = dealt.where("many IS NULL").select("key", "id").join(shared.where(F.col("size") <= most), "key").unionByName(dealt.where("many IS NOT NULL").select("key", "id", F.col("many").alias("size")))
    members = written(members.distinct(), "minhash-members")
    fame = members.groupBy("id").agg(F.sum(F.log2("size")).alias("fame"))
    # repeated rows: one of each id
    store = reps.drop("h1", "h2", "copies").join(fame, "id").join(packed_texts(docs), "id").dropDuplicates(["id"])
    store = written(store, "minhash-store")
    left = written(members.join(sketches(store), "id").withColumn("component", F.col("id")).withColumn("main", F.lit(None).cast("long")), "minhash-left")
    total = left.count()
    found, pivots, last = None, 1, False
    if aliases is not None:
        own = described.join(aliases, F.col("doc_id") == F.col("handle")).drop("handle", "signature", "parity")
        found = written(represented(own, reps.select("h1", "h2", "id", "copies"), most).select(F.col("id").alias("a"), F.col("own_id").alias("b")).distinct(), "minhash-links")
    tables = [members, store, left]
    while True:
        if last:
            tops = left.where("component <> main")
        else:
            order = [F.col("fame").desc(), "id"] if pivots == 1 else [F.xxhash64("id", F.lit(pivots))]
            outside = left if pivots == 1 else left.where("component <> main")
            tops = outside.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("place") <= pivots).drop("place")
        fresh = written(verify(candidates(left, tops, last), store), "minhash-links")
        found = fresh if found is None else found.unionByName(fresh)
        labels = components(found)
        tables.append(fresh)
        if last:
            break
        labelled = left.drop("component", "main").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        labelled = written(labelled, "minhash-left")
        mixed = labelled.groupBy("key").agg(F.max_by("component", "fame").alias("main"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key", "main")
        left = written(labelled.join(mixed, "key"), "minhash-left")
        tables += [labelled, left]
        effort = left.where("component <> main").agg(F.sum("size").alias("pairs")).first().pairs
        if effort is None:
            break
        pivots *= 16
        last = effort <= EFFORT * total or pivots * pivots > total
        tables.append(labels)
    discard(*tables)
    return labels, reps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words and sets are those of whole texts, A-Z lower-cased; fewer than five words make one
    shingle. Null and empty texts have no shingles and no links: their component is themselves.
    Rows with equal ids count as one document. A row without an id is linked with nothing,
    has a null component and is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described, aliases = written(describe(docs), "minhash-signatures"), None
    if (handled := with_handles(docs, described)) is not None:
        docs, aliases = handled
        discard(described)
        described = written(describe(docs), "minhash-signatures")
    labels, reps = links(docs, described, aliases)
    named = reps.select("h1", "h2", "id", "copies").join(labels, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"), "copies")
    rows = represented(described.select("doc_id", "n_shingles", "h1", "h2"), written(named, "minhash-reps"), max(1000, described.count() // 1000))
    if aliases is not None:
        rows = rows.join(aliases, F.col("doc_id") == F.col("handle"), "left").withColumn("doc_id", F.coalesce("own_id", "doc_id"))
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group of near duplicates, that with the smallest id.

    Same columns. Rows with equal ids are one document: each of its texts stays, once, with the
    values of the row whose hash is least. Rows without an id all stay.
    """
    kept = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept")).where("kept").select("doc_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text, place = fresh_name(docs, "text"), fresh_name(docs, "place")
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").withColumn(text, F.xxhash64("text"))
    once = Window.partitionBy("doc_id", text).orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    named = named.withColumn(place, F.row_number().over(once)).where(F.col(place) == 1)
    return named.select(*columns).unionByName(docs.where("doc_id IS NULL").select(*columns))


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS low FROM n UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.low) AS component_id, n.doc_id = min(r.low) AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""
