"""Functions of a collection of contigs laid end to end on a forward strand [0, F) and a reverse strand [F, 2F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import n_runs, reverse_complement


def total_length(contigs: DataFrame) -> int:
    """F. One number from the small contig table."""
    return contigs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def to_reverse(pos: Column, forward: int) -> Column:
    return F.lit(2 * forward - 1) - pos


def is_reverse(pos: Column, forward: int) -> Column:
    return pos >= forward


def absolute(pos: Column, forward: int) -> Column:
    """The forward-strand position of a position on either strand."""
    return F.when(is_reverse(pos, forward), to_reverse(pos, forward)).otherwise(pos)


def locate(rows: DataFrame, contigs: DataFrame, forward: int, pos: str = "pos", cell: int = 1024) -> DataFrame:
    """rows with contig_id, offset and strand_id (2 * contig, plus 1 on the reverse strand) of a position.

    Contigs are listed in the cells they touch, so that the lookup is an equi-join; positions outside get nulls.
    """
    first, last = F.col("start"), F.col("start") + F.col("length") - 1
    spans = contigs.filter("length > 0").select(
        F.col("contig_id").alias("__contig"), first.alias("__first"), last.alias("__last"), F.explode(F.sequence(F.floor(first / cell), F.floor(last / cell))).alias("__span")
    )
    placed = rows.withColumn("__at", absolute(F.col(pos), forward))
    on = (F.floor(F.col("__at") / cell) == F.col("__span")) & F.col("__at").between(F.col("__first"), F.col("__last"))
    return placed.join(spans, on, "left").select(
        *rows.columns,
        F.col("__contig").alias("contig_id"),
        (F.col("__at") - F.col("__first")).alias("offset"),
        (F.col("__contig") * 2 + F.when(is_reverse(F.col(pos), forward), 1).otherwise(0)).alias("strand_id"),
    )


def holes(contigs: DataFrame) -> DataFrame:
    """(contig_id, start, length) of the runs of N, in positions of the contig."""
    return contigs.select("contig_id", F.explode(n_runs(F.col("seq"))).alias("r")).select("contig_id", F.col("r.start").cast("long").alias("start"), F.col("r.length").cast("long").alias("length"))


def extract(rows: DataFrame, contigs: DataFrame, forward: int, start: str = "start_pos", length: str = "len") -> DataFrame:
    """rows with `part`: the text of [start, start + len) on its strand; null if it leaves the contig or the strand."""
    located = locate(rows, contigs, forward, start)
    texts = contigs.select(F.col("contig_id").alias("__id"), F.col("seq").alias("__seq"), F.col("length").alias("__n"))
    both = located.join(texts, F.col("contig_id") == F.col("__id"), "left")
    n = F.col(length)
    rev = is_reverse(F.col(start), forward)
    first = F.when(rev, F.col("offset") - n + 1).otherwise(F.col("offset"))
    inside = (first >= 0) & (first + n <= F.col("__n"))
    part = F.substr(F.col("__seq"), (first + 1).cast("int"), n.cast("int"))
    return both.withColumn("part", F.when(inside, F.when(rev, reverse_complement(part)).otherwise(part))).drop("__id", "__seq", "__n")
