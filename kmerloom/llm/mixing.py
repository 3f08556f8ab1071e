"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, word_count, written

#: Source tables up to this many rows are broadcast; larger ones are joined with salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of sources: ``source, source_size, target, rate``.

    ``sizes`` has ``source`` and ``source_size`` once per source. Sources by code point, null
    last, get the weights in turn. A source's target is level * weight, but at most ``most``
    times its size, with the one level at which all targets add up to the sum of all sizes;
    this is where resharing the excess by weight ends. An empty source has target and rate 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(int(w)) for w in weights])
    sizes = sizes.withColumn("w", F.element_at(turns, (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    sizes = sizes.withColumn("cap", F.col("source_size") * most).withColumn("fill", F.col("cap") / F.col("w"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    sizes = sizes.withColumn("level", left / F.sum("w").over(onwards))
    open_level = F.max(F.when(F.col("fill") > F.col("level"), F.col("level"))).over(everything)
    target = F.when(F.col("fill") <= F.col("level"), F.col("cap").cast("double")).otherwise(open_level * F.col("w"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sizes.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def hash_unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the key and the seed; null keys count as empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source size, target and number of copies in columns of new names.

    The names come back in a dictionary. Copies: floor(rate), and one more where the unit hash
    of the id is below the fraction of the rate. Reruns agree; rows with the same id are drawn
    alike. Null or empty text has size 0; null is a source of its own. An empty table stays empty.
    """
    docs = docs.select("*")
    names = {}
    for stem in ("size", "source_size", "target", "rate", "copies", "key", "salt"):
        names[stem] = fresh_name(docs, stem)
    totals = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    rates = written(totals, "mix-sizes")
    few = len(rates.limit(BROADCAST_SOURCES + 1).select(F.lit(1)).collect()) <= BROADCAST_SOURCES
    rates = source_targets(rates, weights, most).select(F.col("source").alias(names["key"]), *[F.col(c).alias(names[c]) for c in ("source_size", "target", "rate")])
    sized = docs.withColumn(names["size"], word_count(F.col(text_col)))
    on = F.col(source_col).eqNullSafe(F.col(names["key"]))
    if few:
        joined = sized.join(F.broadcast(rates), on)
    else:
        salted = rates.withColumn(names["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = sized.withColumn(names["salt"] + "_l", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, on & (F.col(names["salt"] + "_l") == F.col(names["salt"]))).drop(names["salt"], names["salt"] + "_l")
    whole = F.floor(F.col(names["rate"]))
    copies = whole + (hash_unit(F.col(id_col), seed) < F.col(names["rate"]) - whole).cast("long")
    return joined.withColumn(names["copies"], copies.cast("long")).drop(names["key"]), names


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`with_copies` says, same columns."""
    counted, names = with_copies(docs, **options)
    counted = counted.where(F.col(names["copies"]) > 0)
    copy = F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int"))).alias(names["key"])
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], copy).drop(names["key"])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken, copies`` (taken: words, repeats counted)."""
    counted, n = with_copies(docs.select("doc_id", "text", "source"), **options)
    col = F.col
    return counted.select("doc_id", col(n["size"]).alias("size"), col(n["source_size"]).alias("source_size"), col(n["target"]).alias("target"), (col(n["size"]) * col(n["copies"])).alias("taken"), col(n["copies"]).alias("copies"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s),
f AS (SELECT *, cap::DOUBLE / w AS fill FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN fill <= level THEN cap::DOUBLE ELSE (max(CASE WHEN fill > level THEN level END) OVER ()) * w END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, floor(rate)::BIGINT + CASE WHEN
  ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
