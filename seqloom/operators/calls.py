"""Questions asked of stored calls: overlap between runs, suppression, curves, heat maps, and edits as new tables.

calls: (id, run, x, y, w, h, from_fwd, to_fwd, score, ...). Two calls match directly if they have the same strands and lie
within a distance; they match mirrored if this holds after x and y of one are swapped and its strands are swapped and
negated. Both cases are joined apart, so that each is an equi-join on cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import in_window, within
from .rangejoin import box_join

BOX = ["id", "run", "x", "y", "w", "h", "from_fwd", "to_fwd", "score"]


def mirrored(calls: DataFrame) -> DataFrame:
    """Calls seen from the other strand."""
    return calls.withColumns({
        "x": F.col("y"), "y": F.col("x"), "w": F.col("h"), "h": F.col("w"), "from_fwd": ~F.col("to_fwd"), "to_fwd": ~F.col("from_fwd"),
    })


def matches(a: DataFrame, b: DataFrame, distance: int, condition: Column | None = None, same_run: bool = False) -> DataFrame:
    """Pairs of matching calls with the prefixes a_ and b_; a pair that matches both ways comes once."""
    keys = ["from_fwd", "to_fwd"] + (["run"] if same_run else [])
    near = within(distance) & (F.lit(True) if condition is None else condition)
    a, b = a.select(BOX), b.select(BOX)
    direct = box_join(a, b, near, keys, distance)
    turned = box_join(mirrored(a), b, near, keys, distance)
    names = ["a_id", "a_run", "a_score", "b_id", "b_run", "b_score"]
    return direct.select(names).unionByName(turned.select(names)).distinct()


def suppressed(calls: DataFrame, distance: int) -> DataFrame:
    """Ids of calls that match another call of their run with the same or a higher score. Equal ones suppress each other."""
    better = (F.col("b_score") >= F.col("a_score")) & (F.col("a_id") != F.col("b_id"))
    return matches(calls, calls, distance, better, same_run=True).select(F.col("a_id").alias("id")).distinct()


def unsuppressed(calls: DataFrame, distance: int) -> DataFrame:
    return calls.join(suppressed(calls, distance), "id", "left_anti")


def overlapping(calls: DataFrame, others: DataFrame, distance: int, found: bool) -> DataFrame:
    """Calls, not suppressed at twice the distance, that match one of the others (found) or none (not found)."""
    own = unsuppressed(calls, 2 * distance)
    hit = matches(own, others, distance).select(F.col("a_id").alias("id")).distinct()
    return own.join(hit, "id", "left_semi" if found else "left_anti")


def count_curve(calls: DataFrame, truth: DataFrame, distance: int) -> DataFrame:
    """For each distinct score: n_calls with at least it, n_found of the true calls matched by such a call, n_truth."""
    own = unsuppressed(truth, 2 * distance)
    best = matches(own, calls, distance).groupBy(F.col("a_id").alias("id")).agg(F.max("b_score").alias("best"))
    scores = own.join(best, "id", "left").select(F.coalesce("best", F.lit(-1.0)).alias("score"))
    per = calls.groupBy("score").agg(F.count(F.lit(1)).alias("c"), F.lit(0).cast("long").alias("g")).unionByName(
        scores.groupBy("score").agg(F.lit(0).cast("long").alias("c"), F.count(F.lit(1)).alias("g"))
    ).groupBy("score").agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
    # few distinct scores: one small window over them
    down = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    out = per.withColumns({"n_calls": F.sum("c").over(down), "n_found": F.sum("g").over(down), "n_truth": F.sum("g").over(W.partitionBy())})
    return out.filter("c > 0").select("score", "n_calls", "n_found", "n_truth")


def heat_map(calls: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """(i, j, tile_x, tile_y, n): calls that touch each tile; blocks(block, start, length) are cut into tiles of at most `most`."""
    n = F.floor(F.col("length") / most) + 1
    cut = blocks.withColumn("n", n).withColumn("size", F.col("length") / F.col("n")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    tiles = cut.select("block", F.floor(F.col("k") * F.col("size") + F.col("start")).alias("at"), (F.floor("size") + 1).alias("len"))
    cell = 64

    def listed(rows: DataFrame, lo: str, size: str, name: str) -> DataFrame:
        return rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))))

    t = listed(tiles, "at", "len", "c")
    hits = []
    for axis, size, out in (("x", "w", "i"), ("y", "h", "j")):
        c = listed(calls.select("id", axis, size), axis, size, "c")
        meet = (F.col(axis) <= F.col("at") + F.col("len")) & (F.col("at") <= F.col(axis) + F.col(size))
        hits.append(c.join(t, "c").filter(meet).select("id", F.col("block").alias(out), F.col("at").alias(f"tile_{axis}")).distinct())
    return hits[0].join(hits[1], "id").groupBy("i", "j", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


def in_area(calls: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return calls.filter(in_window(x, y, w, h))


def best_in_strip(calls: DataFrame, x: int, w: int) -> DataFrame:
    """The call with the highest score whose x interval touches [x, x + w], per run."""
    touching = calls.filter((F.col("x") <= x + w) & (F.col("x") + F.col("w") >= x))
    return touching.groupBy("run").agg(F.max(F.struct("score", -F.col("id"))).alias("m")).select("run", F.col("m.score").alias("score"), (-F.col("m.col2")).alias("id"))


def copy_path(source: DataFrame, target: DataFrame, distance: int, columns: list[str]) -> DataFrame:
    """target's calls that match one of source, with source's columns; both unsuppressed; of several the smallest source id."""
    pairs = matches(unsuppressed(target, 2 * distance), unsuppressed(source, 2 * distance), distance)
    first = pairs.groupBy("a_id").agg(F.min("b_id").alias("b_id"))
    taken = source.select(F.col("id").alias("b_id"), *columns)
    return first.join(taken, "b_id").select(F.col("a_id").alias("id"), F.col("b_id").alias("from_id"), *columns)


def high_scores(calls: DataFrame, share: float) -> DataFrame:
    """Calls of each run below min + (max - min) * (1 - share): what stays when the highest scores are deleted."""
    edge = calls.groupBy("run").agg((F.min("score") + (F.max("score") - F.min("score")) * (1 - share)).alias("edge"))
    return calls.join(edge, "run").filter(F.col("score") < F.col("edge")).drop("edge")


def split_by_size(calls: DataFrame, small_run: int, size: int, large: bool = False) -> DataFrame:
    """The calls with those below (or, for large, not below) a size moved into another run."""
    extent = F.greatest(F.col("y") - F.col("x"), F.col("inserted_size"))
    moved = extent >= size if large else extent < size
    return calls.withColumn("run", F.when(moved, small_run).otherwise(F.col("run")))


def newest_unique(runs: DataFrame, n: int) -> DataFrame:
    """Runs with fewer than n runs of their name at their time or later, themselves included."""
    order = W.partitionBy("name").orderBy(F.desc("ts")).rangeBetween(W.unboundedPreceding, W.currentRow)
    return runs.withColumn("later", F.count(F.lit(1)).over(order)).filter(F.col("later") < n).drop("later")


