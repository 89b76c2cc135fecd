"""Breakpoint edges (jumps) between seeds: derived attributes, uncertainty rectangles, filters.

A jump has from_pos and to_pos (null: unknown), query_from <= query_to, strands from_fwd and to_fwd, and nt, the letters that
support it. Fixed values of the uncertainty: at most H = 25 letters, growing by M = 0.25 a letter beyond S = 400 letters of
distance; at full uncertainty seeds reach DIRECTION = 3 letters further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

H, S, M, DIRECTION = 25, 400, 0.25, 3


def known(end: str) -> Column:
    return F.col(end).isNotNull()


def canonical(jumps: DataFrame) -> DataFrame:
    """Jumps in their canonical direction: mirrored ones have their ends swapped and their strands swapped and negated."""
    f, t = F.col("from_pos"), F.col("to_pos")
    mirrored = F.coalesce((t < f) | ((t == f) & ~F.col("from_fwd") & F.col("to_fwd")), F.lit(False))
    pick = lambda a, b: F.when(F.col("mirrored"), b).otherwise(a)
    rest = [c for c in jumps.columns if c not in ("from_pos", "to_pos", "from_fwd", "to_fwd")]
    return jumps.withColumn("mirrored", mirrored).select(
        *rest, pick(f, t).alias("from_pos"), pick(t, f).alias("to_pos"), pick(F.col("from_fwd"), ~F.col("to_fwd")).alias("from_fwd"), pick(F.col("to_fwd"), ~F.col("from_fwd")).alias("to_fwd"), "mirrored",
    )


def query_distance() -> Column:
    return F.col("query_to") - F.col("query_from")


def ref_distance() -> Column:
    return F.abs(F.col("to_pos") - F.col("from_pos"))


def size() -> Column:
    """The larger of both distances; of a one-sided jump that on the query."""
    return F.greatest(query_distance(), F.coalesce(ref_distance(), F.lit(0)))


def fuzziness() -> Column:
    """Letters by which either end may be off."""
    return F.floor(F.least(F.lit(float(H)), F.greatest(F.lit(0.0), F.greatest(ref_distance(), query_distance()) - S) * M))


def rectangle(jumps: DataFrame) -> DataFrame:
    """Adds fuzz, x, y, w, h: the rectangle in which the jump's ends may lie, and section, its strands as a number.

    Sections: 0 forward-forward, 1 forward-reverse, 2 reverse-forward, 3 reverse-reverse, 4 one end unknown.
    """
    both = known("from_pos") & known("to_pos")
    rows = jumps.withColumn("fuzz", F.when(both, fuzziness()))
    reach = F.when(F.when(both, F.col("fuzz")).otherwise(query_distance()) >= H, DIRECTION).otherwise(0)
    rows = rows.withColumn("__d", reach)
    d, q, fz = F.col("__d"), query_distance(), F.col("fuzz")
    zero = lambda c: F.greatest(F.lit(0), c)
    left = zero(F.col("to_pos") - q + d)
    x = F.when(~known("from_pos"), left).when(~known("to_pos"), zero(F.col("from_pos") - d)).when(F.col("from_fwd"), zero(F.col("from_pos") - d)).otherwise(zero(F.col("from_pos") - fz))
    y = F.when(~known("from_pos"), left + 1).when(~known("to_pos"), zero(F.col("from_pos") - d) + 1).when(F.col("to_fwd"), zero(F.col("to_pos") - fz)).otherwise(zero(F.col("to_pos") - d))
    section = F.when(~both, 4).otherwise(F.when(F.col("from_fwd"), 0).otherwise(2) + F.when(F.col("to_fwd"), 0).otherwise(1))
    return rows.withColumns({
        "x": x, "y": y, "w": F.when(both, fz + d).otherwise(q + d), "h": F.when(both, fz + d).otherwise(F.lit(0)), "section": section,
    }).drop("__d")


def kind() -> Column:
    """Classes by which jumps are drawn."""
    return (
        F.when(~known("to_pos"), "unknown to").when(~known("from_pos"), "unknown from")
        .when(F.col("from_fwd") & F.col("to_fwd"), "forward").when(F.col("from_fwd"), "forward to reverse").when(F.col("to_fwd"), "reverse to forward").otherwise("reverse")
    )


def from_seeds(seeds: DataFrame, reads: DataFrame, min_dummy: int = 50, max_dummy: int = 60, min_size: int = 0, max_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges between neighbouring seeds, one-sided edges at the ends of reads), not yet canonical.

    seeds have absolute positions r. The neighbour of a seed is the next one in order of the query.
    """
    order = W.partitionBy("read_id").orderBy("q", "len", "r", "fwd")
    back = W.partitionBy("read_id").orderBy(F.desc("q"), F.desc("len"), F.desc("r"), F.desc("fwd"))
    rows = seeds.withColumns({f"n_{c}": F.lead(c).over(order) for c in ("q", "len", "r", "fwd")}).withColumn("first", F.row_number().over(order)).withColumn("last", F.row_number().over(back))
    end = F.col("q") + F.col("len")
    edges = rows.filter("n_q is not null").select(
        "read_id",
        F.when(F.col("fwd"), F.col("r") + F.col("len") - 1).otherwise(F.col("r") - F.col("len") + 1).alias("from_pos"), F.col("n_r").alias("to_pos"),
        F.least(end, "n_q").alias("query_from"), F.col("n_q").alias("query_to"), F.col("fwd").alias("from_fwd"), F.col("n_fwd").alias("to_fwd"), F.least("len", "n_len").alias("nt"),
    )
    edges = edges.filter(size() >= min_size)
    edges = edges.filter(size() < max_size) if max_size else edges
    sized = rows.join(reads.select("read_id", F.length("seq").cast("long").alias("q_len")), "read_id")
    unknown = F.lit(None).cast("long")
    tail = F.when(F.col("fwd"), F.col("r")).otherwise(F.col("r") - F.col("len") + 1)
    head = F.when(F.col("fwd"), F.col("r") + F.col("len") - 1).otherwise(F.col("r"))
    starts = sized.filter((F.col("first") == 1) & (F.col("q") >= min_dummy)).select(
        "read_id", F.when(~F.col("fwd"), head).otherwise(unknown).alias("from_pos"), F.when(F.col("fwd"), tail).otherwise(unknown).alias("to_pos"),
        F.greatest(F.col("q") - max_dummy, F.lit(0)).alias("query_from"), F.col("q").alias("query_to"), F.col("fwd").alias("from_fwd"), F.col("fwd").alias("to_fwd"), F.col("len").alias("nt"),
    )
    ends = sized.filter((F.col("last") == 1) & (end + min_dummy < F.col("q_len"))).select(
        "read_id", F.when(F.col("fwd"), head).otherwise(unknown).alias("from_pos"), F.when(~F.col("fwd"), tail).otherwise(unknown).alias("to_pos"),
        end.alias("query_from"), F.least(end + max_dummy, "q_len").alias("query_to"), F.col("fwd").alias("from_fwd"), F.col("fwd").alias("to_fwd"), F.col("len").alias("nt"),
    )
    return edges, starts.unionByName(ends)
