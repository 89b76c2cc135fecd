"""Coverage by bins and sizes that follow from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_coverage(ranges: DataFrame, by: list[str], read: str, first: str, last: Column, size: int) -> DataFrame:
    """(by..., bin_id, bin_coverage): reads with a range that touches the bin, each read once."""
    bins = F.explode(F.sequence(F.floor(F.col(first) / size), F.floor(last / size))).alias("bin_id")
    once = ranges.select(*by, read, bins).distinct()
    return once.groupBy(*by, "bin_id").agg(F.count(F.lit(1)).alias("bin_coverage"))


def zero_filled(coverage: DataFrame, n: int) -> DataFrame:
    """(bin_id, bin_coverage) for the bins 0 to n - 1."""
    every = coverage.sparkSession.range(n).select(F.col("id").alias("bin_id"))
    found = coverage.select("bin_id", "bin_coverage")
    return every.join(found, "bin_id", "left").select("bin_id", F.coalesce("bin_coverage", F.lit(0)).alias("bin_coverage"))


def kmer_size_for_rectangle(w: Column, h: Column, t: float) -> Column:
    """The smallest k >= 2 for which random texts of these lengths share no k-mer with probability 1 - t, else min + 1."""
    least = F.least(w, h)
    chance = lambda k: F.pow(1 - F.pow(F.lit(0.25), k), (w - k + 1) * (h - k + 1))
    fits = F.when(least >= 2, F.filter(F.sequence(F.lit(2).cast("long"), least), lambda k: chance(k) >= 1 - t))
    return F.coalesce(F.array_min(fits), least + 1)
