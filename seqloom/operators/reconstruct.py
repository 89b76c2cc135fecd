"""From ordered calls to the segments of a sequenced genome, and to its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequence import reverse_complement
from .genome import locate


def _oriented(calls: DataFrame) -> DataFrame:
    """Start and end of each call as a step of the path: mirrored ones are read from their other end."""
    m = F.col("mirrored")
    swap = lambda a, b: F.when(m, F.col(b)).otherwise(F.col(a))
    turned = calls.withColumns({
        "fx": swap("x", "y"), "fw": swap("w", "h"), "tx": swap("y", "x"), "tw": swap("h", "w"),
        "leaves_fwd": F.when(m, ~F.col("to_fwd")).otherwise(F.col("from_fwd")), "enters_fwd": F.when(m, ~F.col("from_fwd")).otherwise(F.col("to_fwd")),
    })
    return turned.withColumns({
        "leave": F.when(F.col("leaves_fwd"), F.col("fx") + F.col("fw")).otherwise(F.col("fx")),
        "enter": F.when(F.col("enters_fwd"), F.col("tx")).otherwise(F.col("tx") + F.col("tw")),
    })


def segments(calls: DataFrame, contigs: DataFrame, forward: int) -> DataFrame:
    """(ctg_order_id, step, start, len, fwd, inserted): reference pieces in path order.

    A piece leads from where the last call entered to where the next one leaves; if the strands or the contigs do not
    allow that, its length is 0. Before the first call the contig of its leaving end is read from its border, and after the
    last one the contig's rest is added if it is shorter than half the contig. calls: (id, ctg_order_id, order_id, x, y, w,
    h, from_fwd, to_fwd, mirrored, inserted).
    """
    path = W.partitionBy("ctg_order_id").orderBy("order_id", "id")
    back = W.partitionBy("ctg_order_id").orderBy(F.desc("order_id"), F.desc("id"))
    steps = _oriented(calls).withColumns({
        "step": F.row_number().over(path), "last": F.row_number().over(back), "at": F.lag("enter").over(path), "fwd": F.lag("enters_fwd").over(path),
    })
    ends = contigs.select("contig_id", "start", (F.col("start") + F.col("length")).alias("stop"), "length")
    keep = ["ctg_order_id", "step", "last", "leave", "leaves_fwd", "enter", "enters_fwd", "at", "fwd", "inserted"]
    placed = locate(steps.select(keep), contigs, forward, "leave").select(*keep, F.col("contig_id").alias("leave_contig"))
    placed = placed.join(ends.select(F.col("contig_id").alias("leave_contig"), "start", "stop"), "leave_contig", "left")
    first = F.col("step") == 1
    placed = placed.withColumns({
        "fwd": F.when(first, F.col("leaves_fwd")).otherwise(F.col("fwd")),
        "at": F.when(first, F.when(F.col("leaves_fwd"), F.col("start")).otherwise(F.col("stop") - 1)).otherwise(F.col("at")),
    })
    back_at = locate(placed.drop("start", "stop"), contigs, forward, "at").withColumnRenamed("contig_id", "at_contig")
    fits = (F.col("at_contig") == F.col("leave_contig")) & (F.col("fwd") == F.col("leaves_fwd")) & F.when(F.col("fwd"), F.col("at") <= F.col("leave")).otherwise(F.col("at") >= F.col("leave"))
    inner = back_at.select(
        "ctg_order_id", F.col("step").cast("long").alias("step"), F.col("at").alias("start"), F.when(F.coalesce(fits, F.lit(False)), F.abs(F.col("leave") - F.col("at")) + 1).otherwise(0).alias("len"), "fwd", F.coalesce("inserted", F.lit("")).alias("inserted"),
    )
    final = locate(back_at.filter("last = 1").select("ctg_order_id", "step", "enter", "enters_fwd"), contigs, forward, "enter").filter(F.col("enter") < forward).join(ends, "contig_id")
    rest = F.when(F.col("enters_fwd"), F.col("stop") - F.col("enter")).otherwise(F.col("enter") - F.col("start") + 1)
    tail = final.withColumn("rest", rest).filter(F.col("rest") < F.floor(F.col("length") / 2)).select(
        "ctg_order_id", (F.col("step") + 1).cast("long").alias("step"), F.col("enter").alias("start"), F.col("rest").alias("len"), F.col("enters_fwd").alias("fwd"), F.lit("").alias("inserted"),
    )
    return inner.unionByName(tail)


def genome(pieces: DataFrame, contigs: DataFrame, forward: int) -> DataFrame:
    """(ctg_order_id, seq): the texts of the pieces with the insertions after them, in path order."""
    placed = locate(pieces, contigs, forward, "start")
    texts = placed.join(contigs.select("contig_id", F.col("seq").alias("__seq")), "contig_id", "left")
    low = F.when(F.col("fwd"), F.col("offset")).otherwise(F.col("offset") - F.col("len") + 1)
    part = F.substr("__seq", (low + 1).cast("int"), F.col("len").cast("int"))
    text = F.when(F.col("len") > 0, F.when(F.col("fwd"), part).otherwise(reverse_complement(part))).otherwise("")
    rows = texts.select("ctg_order_id", "step", F.concat(F.coalesce(text, F.lit("")), "inserted").alias("t"))
    ordered = F.sort_array(F.collect_list(F.struct("step", "t")))
    return rows.groupBy("ctg_order_id").agg(ordered.alias("p")).select("ctg_order_id", F.array_join(F.col("p.t"), "").alias("seq"))
