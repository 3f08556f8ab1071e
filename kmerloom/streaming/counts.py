"""Coverage and edges of a stream of reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.graph import coded, summed
from ..plans.persist import shared_root


def stream_nodes(reads: DataFrame, k: int) -> DataFrame:
    """The running graph of a stream of ``color, seq``; use output mode update or complete.

    The state has a row for each k-mer and color and never expires: reads carry no time.
    """
    return summed(coded(reads, k), k)


def count_stream(reads: DataFrame, k: int, folder: str, checkpoint: str):
    """A running query that puts the counts of each batch into a folder of its own.

    Counts of batches only need adding, so nothing is kept between them: no state, no driver. A
    batch that is tried again replaces its own folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*[c for c in batch.columns if c not in ("coverage", "edges")]).agg({"coverage": "sum", "edges": "bit_or"}).withColumnsRenamed({"sum(coverage)": "coverage", "bit_or(edges)": "edges"}).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return coded(reads, k).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """The graph of all batches in the folder so far."""
    return summed(spark.read.parquet(folder).drop("batch"), k)


def count_folder(spark: SparkSession, source: str, schema: str, k: int) -> DataFrame:
    """Drain a folder of Parquet files of ``color, seq`` through the stream into the shared folder."""
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    query = count_stream(spark.readStream.schema(schema).parquet(source), k, f"{root}/counts", f"{root}/progress")
    query.awaitTermination()
    return counted(spark, f"{root}/counts", k)
