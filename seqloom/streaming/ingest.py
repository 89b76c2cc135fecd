"""Reads that arrive as FASTA files in a folder: parsed as a stream, counted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import kmer_counts


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream (name, seq) of the FASTA records in a folder's files."""
    parts = spark.readStream.option("lineSep", "\n>").text(folder).filter(F.trim("value") != "")
    lines = F.split(F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), "\r", ""), "\n")
    return parts.select(F.split(lines[0], r"\s")[0].alias("name"), F.array_join(F.slice(lines, 2, 1 << 30), "").alias("seq"))


def ingest(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None], k: int = 18) -> StreamingQuery:
    """Runs over what has arrived: sink(reads, counts of their k-mers, number of the batch) for each batch.

    A batch that is run again after a failure has the same number, by which a sink can replace it.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            sink(batch, kmer_counts(batch, k, []), number)
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
