"""Queries over breakpoint edges, clusters of them, and filters of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import in_window, interval_touches
from ..operators import clusters as C
from ..operators import jumps as J
from . import domain as D
from .catalog import register
from .domain import CALLS, CONTIGS, JUMPS, READS, sql
from .q_seeds import SEEDS, seeds

JUMP = """jumps AS (
  SELECT id, run, read_id, query_from, query_to, nt, m AS mirrored,
    CASE WHEN m THEN to_pos ELSE from_pos END AS from_pos, CASE WHEN m THEN from_pos ELSE to_pos END AS to_pos,
    CASE WHEN m THEN NOT to_fwd ELSE from_fwd END AS from_fwd, CASE WHEN m THEN NOT from_fwd ELSE to_fwd END AS to_fwd
  FROM (SELECT *, coalesce(to_pos < from_pos OR (to_pos = from_pos AND NOT from_fwd AND to_fwd), false) AS m FROM jumps0))"""
RECT = """fz AS (SELECT *, query_to - query_from AS qd, CASE WHEN from_pos IS NOT NULL AND to_pos IS NOT NULL THEN
    floor(least(25.0::DOUBLE, greatest(0.0, (greatest(abs(to_pos - from_pos), query_to - query_from) - 400) * 0.25)))::BIGINT END AS fuzz FROM jumps),
dir AS (SELECT *, CASE WHEN coalesce(fuzz, qd) >= 25 THEN 3 ELSE 0 END AS d, from_pos IS NOT NULL AND to_pos IS NOT NULL AS both_known FROM fz),
rects AS (SELECT id, run, read_id, nt, from_pos, to_pos, from_fwd, to_fwd, query_from, query_to, fuzz,
  CASE WHEN from_pos IS NULL THEN greatest(0, to_pos - qd + d) WHEN to_pos IS NULL OR from_fwd THEN greatest(0, from_pos - d) ELSE greatest(0, from_pos - fuzz) END AS x,
  CASE WHEN from_pos IS NULL THEN greatest(0, to_pos - qd + d) + 1 WHEN to_pos IS NULL THEN greatest(0, from_pos - d) + 1 WHEN to_fwd THEN greatest(0, to_pos - fuzz) ELSE greatest(0, to_pos - d) END AS y,
  CASE WHEN both_known THEN fuzz + d ELSE qd + d END AS w, CASE WHEN both_known THEN fuzz + d ELSE 0 END AS h,
  CASE WHEN NOT both_known THEN 4 ELSE CASE WHEN from_fwd THEN 0 ELSE 2 END + CASE WHEN to_fwd THEN 0 ELSE 1 END END AS section
  FROM dir)"""
HEAD = (JUMPS, JUMP, RECT)


def rects(spark, d):
    return J.rectangle(J.canonical(D.jumps(spark, d)))


ABS_SEEDS = """abs_seeds AS (SELECT s.read_id, fwd, q, len, s.r + c.start AS r FROM seeds s JOIN contigs c ON c.contig_id = s.contig_id),
ordered AS (SELECT *, lead(q) OVER w AS n_q, lead(len) OVER w AS n_len, lead(r) OVER w AS n_r, lead(fwd) OVER w AS n_fwd, row_number() OVER w AS first_, row_number() OVER (PARTITION BY read_id ORDER BY q DESC, len DESC, r DESC, fwd DESC) AS last_
  FROM abs_seeds WINDOW w AS (PARTITION BY read_id ORDER BY q, len, r, fwd))"""


def _edges(spark, d):
    c = D.contigs(spark, d).select("contig_id", "start")
    s = seeds(spark, d).join(c, "contig_id").select("read_id", "fwd", "q", "len", (F.col("r") + F.col("start")).alias("r"))
    return J.from_seeds(s, D.reads(spark, d), min_size=10)


@register("jumps_from_seeds", sql(READS, CONTIGS, SEEDS, ABS_SEEDS, body="""
    SELECT * FROM (SELECT read_id, CASE WHEN fwd THEN r + len - 1 ELSE r - len + 1 END AS from_pos, n_r AS to_pos, least(q + len, n_q) AS query_from, n_q AS query_to, fwd AS from_fwd, n_fwd AS to_fwd, least(len, n_len) AS nt
      FROM ordered WHERE n_q IS NOT NULL) WHERE greatest(query_to - query_from, abs(to_pos - from_pos)) >= 10"""))
def jumps_from_seeds(spark, d):
    return _edges(spark, d)[0]


@register("dummy_jumps", sql(READS, CONTIGS, SEEDS, ABS_SEEDS, body="""
    SELECT o.read_id, CASE WHEN fwd THEN NULL ELSE r END AS from_pos, CASE WHEN fwd THEN r END AS to_pos, greatest(q - 60, 0) AS query_from, q AS query_to, fwd AS from_fwd, fwd AS to_fwd, len AS nt FROM ordered o WHERE first_ = 1 AND q >= 50
    UNION ALL SELECT o.read_id, CASE WHEN fwd THEN r + len - 1 END, CASE WHEN fwd THEN NULL ELSE r - len + 1 END, q + len, least(q + len + 60, length(rd.seq)), fwd, fwd, len FROM ordered o JOIN reads rd ON rd.read_id = o.read_id WHERE last_ = 1 AND q + len + 50 < length(rd.seq)"""))
def dummy_jumps(spark, d):
    return _edges(spark, d)[1]


@register("jump_mirror", sql(JUMPS, JUMP, body="SELECT id, from_pos, to_pos, from_fwd, to_fwd, mirrored FROM jumps"))
def jump_mirror(spark, d):
    return J.canonical(D.jumps(spark, d)).select("id", "from_pos", "to_pos", "from_fwd", "to_fwd", "mirrored")


@register("jump_fuzziness", sql(*HEAD, body="SELECT id, fuzz, greatest(query_to - query_from, coalesce(abs(to_pos - from_pos), 0)) AS size FROM rects"))
def jump_fuzziness(spark, d):
    return rects(spark, d).select("id", "fuzz", J.size().alias("size"))


@register("jump_rectangle", sql(*HEAD, body="SELECT id, x, y, w, h FROM rects"))
def jump_rectangle(spark, d):
    return rects(spark, d).select("id", "x", "y", "w", "h")


@register("jump_section", sql(*HEAD, body="SELECT section, count(*) AS n, sum(nt)::BIGINT AS nt FROM rects GROUP BY section"))
def jump_section(spark, d):
    return rects(spark, d).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum("nt").alias("nt"))


@register("jump_classes", sql(JUMPS, JUMP, body="""
    SELECT CASE WHEN to_pos IS NULL THEN 'unknown to' WHEN from_pos IS NULL THEN 'unknown from' WHEN from_fwd AND to_fwd THEN 'forward' WHEN from_fwd THEN 'forward to reverse' WHEN to_fwd THEN 'reverse to forward' ELSE 'reverse' END AS kind, count(*) AS n
    FROM jumps GROUP BY 1"""))
def jump_classes(spark, d):
    return J.canonical(D.jumps(spark, d)).groupBy(J.kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("jump_attributes", sql(JUMPS, JUMP, body="SELECT id, query_to - query_from AS query_distance, abs(to_pos - from_pos) AS ref_distance, from_fwd <> to_fwd AS switches, from_pos IS NULL OR to_pos IS NULL AS one_sided FROM jumps"))
def jump_attributes(spark, d):
    j = J.canonical(D.jumps(spark, d))
    return j.select("id", J.query_distance().alias("query_distance"), J.ref_distance().alias("ref_distance"), (F.col("from_fwd") != F.col("to_fwd")).alias("switches"), (~J.known("from_pos") | ~J.known("to_pos")).alias("one_sided"))


X_IN, Y_IN = "x <= 1500 AND x + w >= 1000", "y <= 1500 AND y + h >= 1000"


@register("filter_jump_region", sql(*HEAD, body=f"SELECT id, x, y FROM rects WHERE ({X_IN}) OR ({Y_IN})"))
def filter_jump_region(spark, d):
    x, y = interval_touches(F.col("x"), F.col("x") + F.col("w"), 1000, 1500), interval_touches(F.col("y"), F.col("y") + F.col("h"), 1000, 1500)
    return rects(spark, d).filter(x | y).select("id", "x", "y")


@register("filter_jump_region_square", sql(*HEAD, body=f"SELECT id, x, y FROM rects WHERE {X_IN} AND {Y_IN}"))
def filter_jump_region_square(spark, d):
    x, y = interval_touches(F.col("x"), F.col("x") + F.col("w"), 1000, 1500), interval_touches(F.col("y"), F.col("y") + F.col("h"), 1000, 1500)
    return rects(spark, d).filter(x & y).select("id", "x", "y")


@register("filter_jump_contig_border", sql(*HEAD, CONTIGS, body="""
    SELECT id FROM rects WHERE NOT EXISTS (SELECT 1 FROM contigs c WHERE (x <= c.start + c.length AND x + w >= c.start + c.length) OR (y <= c.start + c.length AND y + h >= c.start + c.length))"""))
def filter_jump_contig_border(spark, d):
    from ..operators.rangejoin import interval_join

    r = rects(spark, d)
    ends = D.contigs(spark, d).select((F.col("start") + F.col("length")).alias("lo")).withColumn("hi", F.col("lo"))
    axis = lambda at, size: interval_join(r.select("id", F.col(at).alias("lo"), (F.col(at) + F.col(size)).alias("hi")), ends, F.lit(True)).select(F.col("a_id").alias("id"))
    return r.select("id").join(axis("x", "w").unionByName(axis("y", "h")).distinct(), "id", "left_anti")


@register("jumps_sorted_events", sql(*HEAD, body="""
    SELECT section, pos, kind, id, row_number() OVER (PARTITION BY section ORDER BY pos, kind, id) AS rank
    FROM (SELECT section, x AS pos, 0 AS kind, id FROM rects WHERE run = 1 UNION ALL SELECT section, x + w, 1, id FROM rects WHERE run = 1)"""))
def jumps_sorted_events(spark, d):
    from pyspark.sql import Window as W

    r = rects(spark, d).filter("run = 1")
    events = r.select("section", F.col("x").alias("pos"), F.lit(0).alias("kind"), "id").unionByName(r.select("section", (F.col("x") + F.col("w")).alias("pos"), F.lit(1).alias("kind"), "id"))
    return events.withColumn("rank", F.row_number().over(W.partitionBy("section").orderBy("pos", "kind", "id")))


@register("jumps_in_window", sql(*HEAD, body="SELECT id, x, y, w, h FROM rects WHERE run = 2 AND x <= 2500 AND x + w >= 500 AND y <= 3500 AND y + h >= 1500"))
def jumps_in_window(spark, d):
    return rects(spark, d).filter((F.col("run") == 2) & in_window(500, 1500, 2000, 2000)).select("id", "x", "y", "w", "h")


@register("count_jumps_in_area", sql(*HEAD, body="SELECT least(count(*), 100) AS n FROM rects WHERE run = 2 AND x <= 2500 AND x + w >= 500 AND y <= 3500 AND y + h >= 1500"))
def count_jumps_in_area(spark, d):
    """Counting ends at 100: the limit is the feature."""
    return rects(spark, d).filter((F.col("run") == 2) & in_window(500, 1500, 2000, 2000)).select("id").limit(100).agg(F.count(F.lit(1)).alias("n"))


# --- clusters -------------------------------------------------------------------------------------------------------


@register("cluster_1d_islands", sql(*HEAD, """cut AS (SELECT *, max(x + w) OVER (PARTITION BY run, section ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM rects),
    grouped AS (SELECT *, sum(CASE WHEN before_ IS NULL OR x > before_ THEN 1 ELSE 0 END) OVER (PARTITION BY run, section ORDER BY x, id) AS island FROM cut)""",
    body="SELECT run, section, min(x) AS x, max(x + w) AS x_end, count(*) AS n, count(DISTINCT read_id) AS n_reads, sum(nt)::BIGINT AS nt FROM grouped GROUP BY run, section, island"))
def cluster_1d_islands(spark, d):
    g = C.islands(rects(spark, d), ["run", "section"], "x", F.col("x") + F.col("w"), ["id"])
    return g.groupBy("run", "section", "island").agg(
        F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x_end"), F.count(F.lit(1)).alias("n"), F.countDistinct("read_id").alias("n_reads"), F.sum("nt").alias("nt")
    ).drop("island")


TOUCH = "a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"
EDGES = f"edges AS (SELECT a.id AS a, b.id AS b FROM calls a JOIN calls b ON a.run = b.run AND a.from_fwd = b.from_fwd AND a.to_fwd = b.to_fwd AND a.id < b.id AND {TOUCH})"
KEYS = ["run", "from_fwd", "to_fwd"]


@register("cluster_overlap_edges", sql(CALLS, EDGES, body="SELECT a, b FROM edges"))
def cluster_overlap_edges(spark, d):
    return C.overlap_edges(D.calls(spark, d), KEYS)


@register("cluster_components", "WITH RECURSIVE " + sql(CALLS, EDGES, "both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)", "reach(id, c) AS (SELECT a, a FROM both_ UNION SELECT both_.b, reach.c FROM reach JOIN both_ ON both_.a = reach.id)", body="SELECT id, min(c) AS component FROM reach GROUP BY id").removeprefix("WITH "))
def cluster_components(spark, d):
    return C.components(C.overlap_edges(D.calls(spark, d), KEYS))


#: Cells of 50 letters as clusters of jumps.
CELLS = "cells AS (SELECT *, section * 1000000 + (x // 50) * 1000 + y // 50 AS cluster FROM rects WHERE from_pos IS NOT NULL AND to_pos IS NOT NULL)"


def _cells(spark, d):
    return rects(spark, d).filter("from_pos is not null and to_pos is not null").withColumn("cluster", F.col("section") * 1000000 + F.floor(F.col("x") / 50) * 1000 + F.floor(F.col("y") / 50))


@register("cluster_support_dedupe", sql(*HEAD, CELLS, body="SELECT cluster, read_id, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster, read_id ORDER BY query_to - query_from, id) AS n FROM cells) WHERE n = 1"))
def cluster_support_dedupe(spark, d):
    return C.one_per_read(_cells(spark, d), ["cluster"], [J.query_distance(), F.col("id")]).select("cluster", "read_id", "id")


@register("cluster_position_estimate", sql(*HEAD, CELLS, body="""
    SELECT cluster, CASE WHEN bool_and(from_fwd) THEN list_sort(list(from_pos))[floor(count(*) * 0.95)::INT + 1] ELSE list_sort(list(from_pos))[floor(count(*) * 0.05)::INT + 1] END AS x,
      CASE WHEN bool_and(to_fwd) THEN list_sort(list(to_pos))[floor(count(*) * 0.05)::INT + 1] ELSE list_sort(list(to_pos))[floor(count(*) * 0.95)::INT + 1] END AS y, count(*) AS n
    FROM cells GROUP BY cluster"""))
def cluster_position_estimate(spark, d):
    g = _cells(spark, d).groupBy("cluster").agg(
        F.bool_and("from_fwd").alias("f"), F.bool_and("to_fwd").alias("t"), C.order_statistic("from_pos", 0.95).alias("fh"), C.order_statistic("from_pos", 0.05).alias("fl"),
        C.order_statistic("to_pos", 0.95).alias("th"), C.order_statistic("to_pos", 0.05).alias("tl"), F.count(F.lit(1)).alias("n"),
    )
    return g.select("cluster", F.when(F.col("f"), F.col("fh")).otherwise(F.col("fl")).alias("x"), F.when(F.col("t"), F.col("tl")).otherwise(F.col("th")).alias("y"), "n")


@register("bipartite_sweep")
def bipartite_sweep(spark, d):
    return C.sweep(rects(spark, d).filter("run = 1"))


DUMMY = "dummies AS (SELECT id, run, coalesce(from_pos, to_pos) AS pos, from_pos IS NOT NULL AS from_known, from_fwd, to_fwd FROM jumps WHERE from_pos IS NULL OR to_pos IS NULL)"


@register("merge_dummy_calls", sql(JUMPS, JUMP, DUMMY, CALLS, body="""
    SELECT dummy_id, call_id, score, x, y FROM (SELECT *, row_number() OVER (PARTITION BY dummy_id ORDER BY score DESC, call_id) AS n FROM (
      SELECT d.id AS dummy_id, c.id AS call_id, score, (pos + x) // 2 AS x, y FROM dummies d JOIN calls c ON from_known AND c.run = d.run AND c.from_fwd = d.from_fwd AND abs(pos - x) <= 20 AND score > 5
      UNION ALL SELECT d.id, c.id, score, x, (pos + y) // 2 FROM dummies d JOIN calls c ON NOT from_known AND c.run = d.run AND c.to_fwd = d.to_fwd AND abs(pos - y) <= 20 AND score > 5)) WHERE n = 1"""))
def merge_dummy_calls(spark, d):
    j = J.canonical(D.jumps(spark, d)).filter("from_pos is null or to_pos is null")
    dummies = j.select("id", "run", F.coalesce("from_pos", "to_pos").alias("pos"), F.col("from_pos").isNotNull().alias("from_known"), "from_fwd", "to_fwd")
    return C.merge_one_sided(dummies, D.calls(spark, d), 20, 5.0)


# --- filters of calls --------------------------------------------------------------------------------------------------

SIZE = "greatest(abs(y - x), inserted_size)"


@register("filter_low_support_short", sql(CALLS, body=f"SELECT id FROM calls WHERE score > 10 OR {SIZE} > 20"))
def filter_low_support_short(spark, d):
    return D.calls(spark, d).filter((F.col("score") > 10) | (F.greatest(F.abs(F.col("y") - F.col("x")), "inserted_size") > 20)).select("id")


@register("filter_fuzzy", sql(CALLS, body="SELECT id FROM calls WHERE w <= 30 AND h <= 5"))
def filter_fuzzy(spark, d):
    return D.calls(spark, d).filter("w <= 30 and h <= 5").select("id")


@register("filter_low_score", sql(CALLS, body="SELECT id, score FROM calls WHERE score > 2"))
def filter_low_score(spark, d):
    return D.calls(spark, d).filter("score > 2").select("id", "score")


#: Spread of the jumps of a cluster across and along the diagonal, around the median (integer).
SPREAD = """spread AS (SELECT cluster, list(to_pos - from_pos) AS a, list(to_pos + from_pos) AS b, count(*) AS n FROM cells GROUP BY cluster),
vars AS (SELECT cluster, n, list_sum(list_transform(a, lambda v: (v - list_sort(a)[n // 2 + 1]) * (v - list_sort(a)[n // 2 + 1]))) / n AS va,
  list_sum(list_transform(b, lambda v: (v - list_sort(b)[n // 2 + 1]) * (v - list_sort(b)[n // 2 + 1]))) / n AS vb FROM spread)"""


@register("filter_diagonal", sql(*HEAD, CELLS, SPREAD, body="SELECT cluster, n FROM vars WHERE vb < 10 OR vb < 300 * va"))
def filter_diagonal(spark, d):
    g = _cells(spark, d).groupBy("cluster").agg(F.collect_list(F.col("to_pos") - F.col("from_pos")).alias("a"), F.collect_list(F.col("to_pos") + F.col("from_pos")).alias("b"), F.count(F.lit(1)).alias("n"))
    g = g.withColumns({f"m{c}": F.element_at(F.sort_array(c), F.floor(F.col("n") / 2).cast("int") + 1) for c in "ab"})
    var = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + (v - F.col(f"m{c}")) * (v - F.col(f"m{c}"))) / F.col("n")
    g = g.withColumn("va", var("a")).withColumn("vb", var("b"))
    return g.filter((F.col("vb") < 10) | (F.col("vb") < 300 * F.col("va"))).select("cluster", "n")


BINS = "bins AS (SELECT bin_id, count(*) AS c FROM (SELECT DISTINCT read_id, unnest(range(x // 100, (x + w) // 100 + 1)) AS bin_id FROM rects) GROUP BY bin_id)"


@register("call_ambiguity", sql(*HEAD, CALLS, BINS, body="""
    SELECT id, ambiguity + coalesce(a.c, 0) + coalesce(b.c, 0) AS ambiguity FROM calls LEFT JOIN bins a ON a.bin_id = x // 100 LEFT JOIN bins b ON b.bin_id = y // 100"""))
def call_ambiguity(spark, d):
    from ..operators.counting import bin_coverage

    bins = bin_coverage(rects(spark, d), [], "read_id", "x", F.col("x") + F.col("w"), 100)
    calls = D.calls(spark, d).withColumn("bx", F.floor(F.col("x") / 100)).withColumn("by", F.floor(F.col("y") / 100))
    one = bins.select(F.col("bin_id").alias("bx"), F.col("bin_coverage").alias("c1"))
    two = bins.select(F.col("bin_id").alias("by"), F.col("bin_coverage").alias("c2"))
    return calls.join(one, "bx", "left").join(two, "by", "left").select("id", (F.col("ambiguity") + F.coalesce("c1", F.lit(0)) + F.coalesce("c2", F.lit(0))).alias("ambiguity"))


@register("genome_sections", sql(*HEAD, body="SELECT section, x // 1000 AS part, count(*) AS n FROM rects GROUP BY ALL"))
def genome_sections(spark, d):
    return rects(spark, d).groupBy("section", F.floor(F.col("x") / 1000).alias("part")).agg(F.count(F.lit(1)).alias("n"))


