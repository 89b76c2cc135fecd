"""Seeds: exact matches (read_id, contig_id, fwd, q, len, r) between reads and contigs, and filters over them.

A forward seed covers [r, r + len) of the contig, a reverse one points left and covers [r - len + 1, r]. Matches that lie
one after the other on a diagonal (r - q forward, r + q reverse) are one seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequence import reverse_complement
from .kmers import kmers, spread

KEY = ["read_id", "contig_id", "fwd"]


def kmer_hits(reads: DataFrame, contigs: DataFrame, k: int, max_occ: int | None = None) -> DataFrame:
    """All k-mer matches (read_id, contig_id, fwd, q, r) on both strands, k-mers of more than max_occ contig places left out."""
    places = kmers(contigs.select("contig_id", "seq"), k)
    both = places.select("contig_id", F.lit(True).alias("fwd"), F.col("pos").alias("r"), "kmer").unionByName(
        places.select("contig_id", F.lit(False).alias("fwd"), (F.col("pos") + k - 1).alias("r"), reverse_complement(F.col("kmer")).alias("kmer"))
    )
    if max_occ is not None:
        both = both.join(both.groupBy("kmer").agg(F.count(F.lit(1)).alias("occ")).filter(F.col("occ") <= max_occ).select("kmer"), "kmer", "left_semi")
    probe = kmers(spread(reads.select("read_id", "seq")), k).withColumnRenamed("pos", "q")
    return probe.join(both, "kmer").select("read_id", "contig_id", "fwd", "q", "r")


def diagonal(r: str = "r", q: str = "q") -> Column:
    return F.when(F.col("fwd"), F.col(r) - F.col(q)).otherwise(F.col(r) + F.col(q))


def lump(seeds: DataFrame) -> DataFrame:
    """Overlapping or adjacent seeds of one diagonal as one seed (gaps and islands)."""
    rows = seeds.withColumn("diag", diagonal()).withColumn("end", F.col("q") + F.col("len"))
    order = W.partitionBy(*KEY, "diag").orderBy("q", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("q") > before), 1).otherwise(0)
    island = rows.withColumn("new", starts).withColumn("island", F.sum("new").over(order))
    return island.groupBy(*KEY, "diag", "island").agg(F.min("q").alias("q"), (F.max("end") - F.min("q")).alias("len"), F.min("r").alias("r0"), F.max("r").alias("r1")).select(
        *KEY, "q", "len", F.when(F.col("fwd"), F.col("r0")).otherwise(F.col("r1")).alias("r")
    )


def max_extended(reads: DataFrame, contigs: DataFrame, k: int, max_occ: int | None = None) -> DataFrame:
    """Maximal exact matches of at least k letters."""
    return lump(kmer_hits(reads, contigs, k, max_occ).withColumn("len", F.lit(k).cast("long")))


def smems(seeds: DataFrame) -> DataFrame:
    """Seeds whose query interval no other seed of the read encloses; equal intervals stay together."""
    end = F.col("q") + F.col("len")
    earlier = F.max(end).over(W.partitionBy("read_id").orderBy("q").rangeBetween(W.unboundedPreceding, -1))
    here = F.max(end).over(W.partitionBy("read_id", "q"))
    rows = seeds.withColumn("__earlier", earlier).withColumn("__here", here)
    return rows.filter((end == F.col("__here")) & (F.col("__earlier").isNull() | (end > F.col("__earlier")))).select(*seeds.columns)


def unique_positions(seeds: DataFrame) -> DataFrame:
    """Seeds whose query interval has no other place."""
    places = F.count(F.lit(1)).over(W.partitionBy("read_id", "q", "len"))
    return seeds.withColumn("__n", places).filter("__n = 1").select(*seeds.columns)


def dedupe(seeds: DataFrame) -> DataFrame:
    """One seed for each (r, q, len), forward before reverse; the strand is not compared."""
    keys = ["read_id", "contig_id", "r", "q", "len"]
    return seeds.groupBy(*keys).agg(F.max("fwd").alias("fwd")).select(*seeds.columns)


def span(seeds: DataFrame) -> DataFrame:
    """Adds the closed interval [lo, hi] that a seed covers on its contig."""
    return seeds.withColumn("lo", F.when(F.col("fwd"), F.col("r")).otherwise(F.col("r") - F.col("len") + 1)).withColumn(
        "hi", F.when(F.col("fwd"), F.col("r") + F.col("len") - 1).otherwise(F.col("r"))
    )


def away_from_borders(seeds: DataFrame, contigs: DataFrame, margin: int) -> DataFrame:
    """Seeds at least `margin` letters from both ends of their contig."""
    sizes = contigs.select("contig_id", F.col("length").alias("__n"))
    return span(seeds).join(sizes, "contig_id").filter((F.col("lo") > margin) & (F.col("hi") + margin < F.col("__n"))).select(*seeds.columns)


def by_area(seeds: DataFrame, start: int, size: int) -> DataFrame:
    return span(seeds).filter((F.col("lo") <= start + size) & (F.col("hi") >= start)).select(*seeds.columns)


def isolated_groups(seeds: DataFrame, axis: str, gap: int, least: int) -> DataFrame:
    """Seeds of groups, cut at gaps of more than `gap` on an axis (q or lo), that have `least` letters or more."""
    placed = span(seeds).withColumn("__s", F.col(axis)).withColumn("__e", F.col(axis) + F.col("len"))
    keys = ["read_id"] if axis == "q" else ["read_id", "contig_id"]
    order = W.partitionBy(*keys).orderBy("__s", "__e", "contig_id", "r", "fwd", "q")
    before = F.max("__e").over(order.rowsBetween(W.unboundedPreceding, -1))
    groups = placed.withColumn("__new", F.when(before.isNull() | (F.col("__s") > before + gap), 1).otherwise(0)).withColumn("__g", F.sum("__new").over(order))
    weight = F.sum("len").over(W.partitionBy(*keys, "__g"))
    return groups.withColumn("__nt", weight).filter(F.col("__nt") >= least).select(*seeds.columns)


def without_palindromes(seeds: DataFrame) -> DataFrame:
    """Without seeds that cross a longer seed of the other strand (equal lengths: the forward one stays).

    Two seeds cross if their intervals overlap on the query and on the contig.
    """
    s = span(seeds).withColumn("end", F.col("q") + F.col("len") - 1)
    cell = 256
    spread_ = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("q") / cell), F.floor(F.col("end") / cell))))
    a = spread_.select([F.col(c).alias("a_" + c) for c in spread_.columns])
    b = spread_.select([F.col(c).alias("b_" + c) for c in spread_.columns])
    on = (F.col("a_read_id") == F.col("b_read_id")) & (F.col("a_contig_id") == F.col("b_contig_id")) & (F.col("a_cell") == F.col("b_cell")) & (F.col("a_fwd") != F.col("b_fwd"))
    cross = (F.col("a_q") <= F.col("b_end")) & (F.col("b_q") <= F.col("a_end")) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    loses = (F.col("a_len") < F.col("b_len")) | ((F.col("a_len") == F.col("b_len")) & ~F.col("a_fwd"))
    lost = a.join(b, on).filter(cross & loses).select([F.col("a_" + c).alias(c) for c in seeds.columns]).distinct()
    return seeds.join(lost, seeds.columns, "left_anti")


def kmer_count_filter(seeds: DataFrame, reads: DataFrame, counts: DataFrame, k: int, most: int) -> DataFrame:
    """Seeds none of whose k-mers occurs more than `most` times; seeds with N or shorter than k stay only if they have none."""
    texts = seeds.join(reads.select("read_id", "seq"), "read_id").withColumn("seed_seq", F.substr("seq", (F.col("q") + 1).cast("int"), F.col("len").cast("int"))).drop("seq")
    over = counts.filter(F.col("n") > most).select("kmer")
    bad = kmers(texts, k, "seed_seq").join(over, "kmer", "left_semi").select(*seeds.columns).distinct()
    clean = texts.filter(~F.col("seed_seq").contains("N")).select(*seeds.columns)
    return clean.join(bad, seeds.columns, "left_anti")


def delta(seeds: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds the diagonal by which strips are formed: r + (len(Q) - q) + (len(Q) + 1) * contig, mirrored for the reverse strand."""
    sizes = reads.select("read_id", F.length("seq").cast("long").alias("q_len"))
    at = F.when(F.col("fwd"), F.col("r") + F.col("q_len") - F.col("q")).otherwise(F.col("r") + F.col("q"))
    return seeds.join(sizes, "read_id").withColumn("delta", at + (F.col("q_len") + 1) * F.col("contig_id"))


def strip_scores(seeds: DataFrame, width: Column, strands: bool = False) -> DataFrame:
    """Adds the score of the strip that begins at each seed: the letters of all seeds of its contig with a delta at most
    `width` above its own, and how many seeds these are."""
    keys = ["read_id", "contig_id"] + (["fwd"] if strands else [])
    # a range frame needs a constant width, so the strips are sums of a running total up to the strip's end
    marks = seeds.select(*keys, "delta", F.col("len").alias("nt"), F.lit(1).alias("one"), F.lit(0).alias("kind"))
    ends = seeds.withColumn("__w", width).select(*keys, (F.col("delta") + F.col("__w")).alias("delta"), F.lit(0).cast("long").alias("nt"), F.lit(0).alias("one"), F.lit(1).alias("kind"), F.col("delta").alias("start"))
    both = marks.withColumn("start", F.lit(None).cast("long")).unionByName(ends)
    order = W.partitionBy(*keys).orderBy("delta", "kind").rowsBetween(W.unboundedPreceding, 0)
    totals = both.withColumn("upto", F.sum("nt").over(order)).withColumn("n_upto", F.sum("one").over(order))
    at_end = totals.filter("kind = 1").groupBy(*keys, "start").agg(F.max("upto").alias("upto"), F.max("n_upto").alias("n_upto"))
    firsts = seeds.groupBy(*keys, "delta").agg(F.sum("len").alias("own"), F.count(F.lit(1)).alias("n_own"))
    below = W.partitionBy(*keys).orderBy("delta").rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.withColumn("under", F.coalesce(F.sum("own").over(below), F.lit(0))).withColumn("n_under", F.coalesce(F.sum("n_own").over(below), F.lit(0)))
    joined = firsts.join(at_end.withColumnRenamed("start", "delta"), [*keys, "delta"])
    return joined.select(*keys, "delta", (F.col("upto") - F.col("under")).alias("score"), (F.col("n_upto") - F.col("n_under")).alias("n_seeds"))
