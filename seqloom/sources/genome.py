"""A collection of contigs as a folder: contigs, holes, k-mer index, and a JSON description."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequence import n_runs, normalise
from ..operators.kmers import kmers
from .fasta import read_fasta

TYPE, VERSION = "contig collection", 1


def from_records(records: DataFrame) -> DataFrame:
    """(contig_id, name, length, start, seq) of records (name, seq), in order of their names."""
    order = W.orderBy("name")
    rows = records.select(F.row_number().over(order).cast("long").alias("n"), "name", normalise(F.col("seq")).alias("seq"))
    rows = rows.withColumn("contig_id", F.col("n") - 1).withColumn("length", F.length("seq").cast("long"))
    return rows.select("contig_id", "name", "length", (F.sum("length").over(W.orderBy("contig_id")) - F.col("length")).alias("start"), "seq")


def store(contigs: DataFrame, path: str, name: str, k: int = 15) -> None:
    """Writes the folder; the index is sorted by k-mer, so that lookups read few row groups."""
    contigs.write.mode("overwrite").parquet(f"{path}/contigs")
    back = contigs.sparkSession.read.parquet(f"{path}/contigs")
    runs = back.select("contig_id", F.explode(n_runs(F.col("seq"))).alias("r")).select("contig_id", "r.start", "r.length")
    runs.write.mode("overwrite").parquet(f"{path}/holes")
    kmers(back.select("contig_id", "seq"), k).sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/index")
    description = json.dumps({"type": TYPE, "version": VERSION, "name": name, "k": k})
    back.sparkSession.createDataFrame([(description,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """(description, contigs, holes, index); another type or version is an error."""
    found = json.loads(spark.read.text(f"{path}/description").first()[0])
    if found.get("type") != TYPE or found.get("version") != VERSION:
        raise ValueError(f"{path} holds {found.get('type')!r} in version {found.get('version')!r}, not {TYPE!r} in version {VERSION}")
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    return found, read("contigs"), read("holes"), read("index")


def make(spark: SparkSession, fasta: str, path: str, name: str, k: int = 15) -> None:
    """From a FASTA file to the stored folder."""
    store(from_records(read_fasta(spark, fasta)), path, name, k)
