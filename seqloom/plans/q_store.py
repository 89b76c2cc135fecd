"""Queries of the store: reads, runs, calls, evaluation, edits and reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import calls as C
from ..operators import jumps as J
from . import domain as D
from .catalog import register
from .domain import CALLS, CONTIGS, JUMPS, RANGES, READS, RUNS, sql
from .q_seeds import SEEDS, seeds
from .q_sv import JUMP

CALLED, TRUTH, DIST = 1, 2, 10


# --- reads ------------------------------------------------------------------------------------------------------------


@register("read_by_name", sql(READS, body="SELECT n.name, coalesce(max(r.read_id), -1) AS read_id, count(r.read_id) AS n FROM (VALUES ('r7', 'src7'), ('r12', 'src12'), ('nobody', 'src1')) n(name, sequencer) LEFT JOIN reads r USING (name, sequencer) GROUP BY 1"))
def read_by_name(spark, d):
    wanted = spark.createDataFrame([("r7", "src7"), ("r12", "src12"), ("nobody", "src1")], "name string, sequencer string")
    r = D.reads(spark, d).select("name", "sequencer", "read_id")
    return F.broadcast(wanted).join(r, ["name", "sequencer"], "left").groupBy("name").agg(F.coalesce(F.max("read_id"), F.lit(-1)).alias("read_id"), F.count("read_id").alias("n"))


@register("reads_per_sequencer", sql(READS, body="SELECT sequencer, count(*) AS n, sum(length(seq))::BIGINT AS nt FROM reads GROUP BY 1"))
def reads_per_sequencer(spark, d):
    return D.reads(spark, d).groupBy("sequencer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("nt"))


@register("used_reads", sql(READS, JUMPS, body="SELECT read_id, name FROM reads WHERE read_id IN (SELECT read_id FROM jumps0 WHERE run = 1)"))
def used_reads(spark, d):
    return D.reads(spark, d).select("read_id", "name").join(D.jumps(spark, d).filter("run = 1").select("read_id"), "read_id", "left_semi")


PAIRS = "pairs AS (SELECT conv_id AS first_read, conv_id * 3 + 1 AS second_read FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0)"


def _paired_ids(spark, d):
    c = D.table(spark, d, "conversations").filter("turn = 0 and conv_id % 3 <> 0")
    return c.select(F.col("conv_id").alias("read_id")).unionByName(c.select((F.col("conv_id") * 3 + 1).alias("read_id"))).distinct()


@register("unpaired_reads", sql(READS, PAIRS, body="SELECT read_id, sequencer FROM reads WHERE read_id NOT IN (SELECT first_read FROM pairs UNION SELECT second_read FROM pairs)"))
def unpaired_reads(spark, d):
    return D.reads(spark, d).select("read_id", "sequencer").join(_paired_ids(spark, d), "read_id", "left_anti")


@register("paired_reads", sql(READS, PAIRS, body="SELECT read_id, sequencer FROM reads WHERE read_id IN (SELECT first_read FROM pairs UNION SELECT second_read FROM pairs)"))
def paired_reads(spark, d):
    return D.reads(spark, d).select("read_id", "sequencer").join(_paired_ids(spark, d), "read_id", "left_semi")


@register("reads_partition", sql(READS, body="SELECT read_id FROM reads WHERE read_id % 4 = 3 AND read_id >= 10 AND sequencer = 'src3'"))
def reads_partition(spark, d):
    return D.reads(spark, d).filter("read_id % 4 = 3 and read_id >= 10 and sequencer = 'src3'").select("read_id")


@register("mates_zip", "SELECT a.conv_id, length(a.text) AS n1, length(b.text) AS n2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1")
def mates_zip(spark, d):
    c = D.table(spark, d, "conversations")
    one = c.filter("turn = 0").select("conv_id", F.length("text").alias("n1"))
    return one.join(c.filter("turn = 1").select("conv_id", F.length("text").alias("n2")), "conv_id")


WINDOWS = [(100, 400), (20_000, 20_001), (50_000, 50_600), (99_000, 99_000)]
WINDOW_ROWS = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in WINDOWS) + ") q(f, t)"


def _covering(spark, d, condition):
    q = spark.createDataFrame(WINDOWS, "f long, t long")
    inside = (F.col("f") == F.col("t")) | ((F.col("r_start") <= F.col("f")) & (F.col("t") <= F.col("r_end")))
    r = D.ranges(spark, d).filter(condition).filter("r_end >= r_start")
    hits = r.join(F.broadcast(q), inside)  # a fixed list of four windows
    return F.broadcast(q).join(hits.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n")), ["f", "t"], "left").select("f", "t", F.coalesce("n", F.lit(0)).alias("n"))


def _covering_sql(condition: str) -> str:
    return sql(RANGES, body=f"SELECT f, t, count(r.id) AS n FROM {WINDOW_ROWS} LEFT JOIN ranges r ON (f = t OR (r_start <= f AND t <= r_end)) AND {condition} GROUP BY f, t")


@register("range_coverage", _covering_sql("sequencer = 'view' AND mapq >= 0.01"))
def range_coverage(spark, d):
    return _covering(spark, d, "sequencer = 'view' and mapq >= 0.01")


@register("range_coverage_primary", _covering_sql("sequencer = 'click' AND mapq >= 0.01 AND is_primary"))
def range_coverage_primary(spark, d):
    return _covering(spark, d, "sequencer = 'click' and mapq >= 0.01 and is_primary")


@register("range_coverage_flag", _covering_sql("sequencer = 'view' AND NOT is_primary"))
def range_coverage_flag(spark, d):
    return _covering(spark, d, "sequencer = 'view' and not is_primary")


# --- runs ---------------------------------------------------------------------------------------------------------------


@register("newest_unique_runs", sql(RUNS, body="SELECT id, name, ts FROM runs r WHERE (SELECT count(*) FROM runs i WHERE i.name = r.name AND i.ts >= r.ts) < 12"))
def newest_unique_runs(spark, d):
    return C.newest_unique(D.runs(spark, d), 12).select("id", "name", "ts")


@register("run_by_name", sql(RUNS, body="SELECT name, arg_max(id, (ts, id)) AS newest, arg_min(id, (ts, id)) AS oldest, count(*) AS n FROM runs GROUP BY name"))
def run_by_name(spark, d):
    key = F.struct("ts", "id")
    return D.runs(spark, d).groupBy("name").agg(F.max_by("id", key).alias("newest"), F.min_by("id", key).alias("oldest"), F.count(F.lit(1)).alias("n"))


@register("run_info", sql(RUNS, body="SELECT id, name, descr, CASE WHEN jump_run_id IS NULL THEN -1 ELSE jump_run_id END AS jump_run_id FROM runs"))
def run_info(spark, d):
    return D.runs(spark, d).select("id", "name", "descr", F.coalesce("jump_run_id", F.lit(-1)).alias("jump_run_id"))


# --- calls --------------------------------------------------------------------------------------------------------------


@register("num_calls", sql(CALLS, body="SELECT run, count(*) AS n, count(*) FILTER (score >= 5) AS n_good FROM calls GROUP BY run"))
def num_calls(spark, d):
    return D.calls(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("score") >= 5, 1)).alias("n_good"))


@register("call_area", sql(CALLS, body="SELECT run, sum(w * h)::BIGINT AS area FROM calls GROUP BY run"))
def call_area(spark, d):
    return D.calls(spark, d).groupBy("run").agg(F.sum(F.col("w") * F.col("h")).alias("area"))


@register("score_extremes", sql(CALLS, body="SELECT run, max(score) AS max_score, min(score) AS min_score, max(avg_nt) AS max_avg_nt FROM calls GROUP BY run"))
def score_extremes(spark, d):
    return D.calls(spark, d).groupBy("run").agg(F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.max("avg_nt").alias("max_avg_nt"))


BASE = "id, x, y, w, h, from_fwd, to_fwd, inserted_size, reads, nt, ambiguity"
COLS = BASE.split(", ")
AREA = "x <= 2000 AND x + w >= 500 AND y <= 3000 AND y + h >= 1000"


@register("calls_in_area", sql(CALLS, body=f"SELECT {BASE} FROM calls WHERE run = 1 AND {AREA}"))
def calls_in_area(spark, d):
    return C.in_area(D.calls(spark, d).filter("run = 1"), 500, 1000, 1500, 2000).select(COLS)


@register("calls_in_area_score", sql(CALLS, body=f"SELECT {BASE} FROM calls WHERE run = 1 AND {AREA} AND score >= 4 AND score < 12"))
def calls_in_area_score(spark, d):
    return C.in_area(D.calls(spark, d).filter("run = 1 and score >= 4 and score < 12"), 500, 1000, 1500, 2000).select(COLS)


@register("count_calls_in_area", sql(CALLS, body=f"SELECT least(count(*), 500) AS n FROM calls WHERE run = 1 AND {AREA} AND score >= 4"))
def count_calls_in_area(spark, d):
    """Counting ends at 500: the limit is the feature."""
    return C.in_area(D.calls(spark, d).filter("run = 1 and score >= 4"), 500, 1000, 1500, 2000).select("id").limit(500).agg(F.count(F.lit(1)).alias("n"))


@register("calls_by_support", sql(CALLS, body="SELECT id, avg_nt FROM calls WHERE run = 3 AND avg_nt >= 20 AND avg_nt < 25 AND id % 10 <> 3"))
def calls_by_support(spark, d):
    return D.calls(spark, d).filter("run = 3 and avg_nt >= 20 and avg_nt < 25 and id % 10 <> 3").select("id", "avg_nt")


def near(a: str, b: str, dist: int) -> str:
    gap = lambda p, s: f"greatest(0, {b}.{p} - ({a}.{p} + {a}.{s}), {a}.{p} - ({b}.{p} + {b}.{s}))"
    return f"(pow({gap('x', 'w')}, 2) + pow({gap('y', 'h')}, 2) <= {dist * dist})"


def both_ways(a: str, b: str, dist: int) -> tuple[str, str]:
    """The direct and the mirrored match of a (with its mirror image m_x...) and b."""
    direct = f"{a}.from_fwd = {b}.from_fwd AND {a}.to_fwd = {b}.to_fwd AND {near(a, b, dist)}"
    gap = lambda ap, as_, bp, bs: f"greatest(0, {b}.{bp} - ({a}.{ap} + {a}.{as_}), {a}.{ap} - ({b}.{bp} + {b}.{bs}))"
    turned = f"{b}.from_fwd <> {a}.to_fwd AND {b}.to_fwd <> {a}.from_fwd AND (pow({gap('y', 'h', 'x', 'w')}, 2) + pow({gap('x', 'w', 'y', 'h')}, 2) <= {dist * dist})"
    return direct, turned


def exists_any(a: str, source: str, dist: int, extra: str) -> str:
    return "(" + " OR ".join(f"EXISTS (SELECT 1 FROM {source} b WHERE {extra} AND {m})" for m in both_ways(a, "b", dist)) + ")"


#: One run is asked; all its calls are read.
OWN = f"""own AS (SELECT * FROM calls WHERE run = {CALLED}), truth AS (SELECT * FROM calls WHERE run = {TRUTH}),
free AS (SELECT a.* FROM own a WHERE NOT {exists_any('a', 'own', 2 * DIST, 'b.id <> a.id AND b.score >= a.score')}),
free_truth AS (SELECT a.* FROM truth a WHERE NOT {exists_any('a', 'truth', 2 * DIST, 'b.id <> a.id AND b.score >= a.score')})"""


def _runs(spark, d):
    c = D.calls(spark, d)
    return c.filter(F.col("run") == CALLED), c.filter(F.col("run") == TRUTH)


@register("self_suppressed", sql(CALLS, OWN, body="SELECT id, score FROM free"))
def self_suppressed(spark, d):
    return C.unsuppressed(_runs(spark, d)[0], 2 * DIST).select("id", "score")


@register("calls_true_positive", sql(CALLS, OWN, body=f"SELECT id, score FROM free a WHERE {exists_any('a', 'truth', DIST, 'true')}"))
def calls_true_positive(spark, d):
    own, truth = _runs(spark, d)
    return C.overlapping(own, truth, DIST, True).select("id", "score")


@register("calls_false_positive", sql(CALLS, OWN, body=f"SELECT id, score FROM free a WHERE score >= 1 AND score < 20 AND NOT {exists_any('a', 'truth', DIST, 'true')}"))
def calls_false_positive(spark, d):
    own, truth = _runs(spark, d)
    return C.overlapping(own, truth, DIST, False).filter("score >= 1 and score < 20").select("id", "score")


@register("calls_gt_found", sql(CALLS, OWN, body=f"SELECT id, score FROM free a WHERE {exists_any('a', 'free_truth', DIST, 'b.avg_nt >= 5 AND b.avg_nt < 60')}"))
def calls_gt_found(spark, d):
    own, truth = _runs(spark, d)
    return C.overlapping(own, C.unsuppressed(truth, 2 * DIST).filter("avg_nt >= 5 and avg_nt < 60"), DIST, True).select("id", "score")


BEST = "best AS (SELECT g.id, (SELECT max(b.score) FROM own b WHERE " + " OR ".join(f"({m})" for m in both_ways("g", "b", DIST)) + ") AS best FROM free_truth g)"
CURVE = """SELECT score, (SELECT count(*) FROM own WHERE own.score >= s.score) AS n_calls, (SELECT count(*) FROM best WHERE coalesce(best, -1) >= s.score) AS n_found, (SELECT count(*) FROM best) AS n_truth
  FROM (SELECT DISTINCT score FROM own) s"""


@register("count_curve", sql(CALLS, OWN, BEST, body=CURVE))
def count_curve(spark, d):
    return C.count_curve(*_runs(spark, d), DIST)


@register("recall_accuracy", sql(CALLS, OWN, BEST, f"curve AS ({CURVE})", body="SELECT score, round(n_found / n_truth::DOUBLE, 9) AS recall, round(n_found / n_calls::DOUBLE, 9) AS accuracy FROM curve WHERE n_calls > 0"))
def recall_accuracy(spark, d):
    c = C.count_curve(*_runs(spark, d), DIST).filter("n_calls > 0")
    return c.select("score", F.round(F.col("n_found") / F.col("n_truth"), 9).alias("recall"), F.round(F.col("n_found") / F.col("n_calls"), 9).alias("accuracy"))


BLOCKS = [(i, 500 * i, 500) for i in range(8)]
TILES = """blocks AS (SELECT unnest(range(0, 8)) AS block),
tiles AS (SELECT block, floor(k * (500 / 6.0::DOUBLE) + 500 * block)::BIGINT AS at FROM blocks, range(0, 6) t(k))"""


@register("call_heatmap", sql(CALLS, TILES, body="""
    SELECT tx.block AS i, ty.block AS j, tx.at AS tile_x, ty.at AS tile_y, count(*) AS n FROM (SELECT * FROM calls WHERE run = 1 AND score >= 4) c
    JOIN tiles tx ON c.x <= tx.at + 84 AND tx.at <= c.x + c.w JOIN tiles ty ON c.y <= ty.at + 84 AND ty.at <= c.y + c.h GROUP BY ALL"""))
def call_heatmap(spark, d):
    blocks = spark.createDataFrame(BLOCKS, "block long, start long, length long")
    return C.heat_map(D.calls(spark, d).filter("run = 1 and score >= 4"), blocks, 100)


@register("heatmap_colours", sql(CALLS, body="SELECT tile_x, tile_y, round(n / max(n) OVER ()::DOUBLE, 9) AS share FROM (SELECT x // 200 AS tile_x, y // 200 AS tile_y, count(*) AS n FROM calls GROUP BY ALL)"))
def heatmap_colours(spark, d):
    g = D.calls(spark, d).groupBy(F.floor(F.col("x") / 200).alias("tile_x"), F.floor(F.col("y") / 200).alias("tile_y")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("tile_x", "tile_y", F.round(F.col("n") / F.max("n").over(W.partitionBy()), 9).alias("share"))


@register("best_call_in_strip", sql(CALLS, body="SELECT run, score, id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, id) AS n FROM calls WHERE x <= 1200 AND x + w >= 1000) WHERE n = 1"))
def best_call_in_strip(spark, d):
    return C.best_in_strip(D.calls(spark, d), 1000, 200)


SUPPORT = "support AS (SELECT c.id AS call_id, j.id AS jump_id, j.query_to - j.query_from AS qd, j.from_pos IS NULL OR j.to_pos IS NULL AS one_sided FROM calls c JOIN jumps j ON j.run = c.run AND j.id % 1000 = c.x % 1000)"


def _support(spark, d):
    j = J.canonical(D.jumps(spark, d)).select("run", F.col("id").alias("jump_id"), J.query_distance().alias("qd"), (~J.known("from_pos") | ~J.known("to_pos")).alias("one_sided"), (F.col("id") % 1000).alias("k"))
    return D.calls(spark, d).select(F.col("id").alias("call_id"), "run", (F.col("x") % 1000).alias("k")).join(j, ["run", "k"]).select("call_id", "jump_id", "qd", "one_sided")


@register("call_support", sql(CALLS, JUMPS, JUMP, SUPPORT, body="SELECT call_id, count(*) AS n, round(avg(qd), 6) AS mean_qd, min(jump_id) AS first_jump FROM support GROUP BY call_id"))
def call_support(spark, d):
    return _support(spark, d).groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qd"), 6).alias("mean_qd"), F.min("jump_id").alias("first_jump"))


@register("dummy_calls", sql(CALLS, JUMPS, JUMP, SUPPORT, body="SELECT id FROM calls WHERE EXISTS (SELECT 1 FROM support s WHERE s.call_id = id AND one_sided)"))
def dummy_calls(spark, d):
    return D.calls(spark, d).select("id").join(_support(spark, d).filter("one_sided").select(F.col("call_id").alias("id")), "id", "left_semi")


@register("call_descriptions", sql(CALLS, "descs AS (SELECT l_orderkey % 400 AS k, max_by('d' || l_partkey, l_partkey) AS d FROM lineitem WHERE l_suppkey % 7 = 0 GROUP BY 1)", body="SELECT id, coalesce(d, '') AS descr FROM calls LEFT JOIN descs ON order_id = k"))
def call_descriptions(spark, d):
    t = D.table(spark, d, "lineitem").filter("l_suppkey % 7 = 0")
    desc = t.groupBy((F.col("l_orderkey") % 400).alias("order_id")).agg(F.max_by(F.concat(F.lit("d"), F.col("l_partkey")), "l_partkey").alias("d"))
    return D.calls(spark, d).join(desc, "order_id", "left").select("id", F.coalesce("d", F.lit("")).alias("descr"))


# --- edits --------------------------------------------------------------------------------------------------------------

EXTENT = "greatest(y - x, inserted_size)"


@register("extract_small_calls", sql(CALLS, body=f"SELECT id, CASE WHEN {EXTENT} < 25 THEN 100 ELSE run END AS run FROM calls"))
def extract_small_calls(spark, d):
    return C.split_by_size(D.calls(spark, d), 100, 25).select("id", "run")


@register("extract_large_calls", sql(CALLS, body=f"SELECT id, CASE WHEN {EXTENT} >= 2000 THEN 101 ELSE run END AS run FROM calls"))
def extract_large_calls(spark, d):
    return C.split_by_size(D.calls(spark, d), 101, 2000, large=True).select("id", "run")


@register("filter_high_score", sql(CALLS, body="SELECT id, score FROM (SELECT *, min(score) OVER (PARTITION BY run) + (max(score) OVER (PARTITION BY run) - min(score) OVER (PARTITION BY run)) * (1 - 0.25::DOUBLE) AS edge FROM calls) WHERE score < edge"))
def filter_high_score(spark, d):
    return C.high_scores(D.calls(spark, d), 0.25).select("id", "score")


@register("copy_path", sql(CALLS, OWN, body="SELECT a.id, min(b.id) AS from_id, arg_min(b.order_id, b.id) AS order_id, arg_min(b.mirrored, b.id) AS mirrored FROM free_truth a JOIN free b ON " + " OR ".join(f"({m})" for m in both_ways("a", "b", DIST)) + " GROUP BY a.id"))
def copy_path(spark, d):
    own, truth = _runs(spark, d)
    return C.copy_path(own, truth, DIST, ["order_id", "mirrored"])


@register("redirect_support", sql(CALLS, JUMPS, JUMP, SUPPORT, body="SELECT CASE WHEN call_id % 9 = 0 THEN -1 ELSE call_id END AS call_id, count(*) AS n FROM support GROUP BY 1"))
def redirect_support(spark, d):
    return _support(spark, d).groupBy(F.when(F.col("call_id") % 9 == 0, -1).otherwise(F.col("call_id")).alias("call_id")).agg(F.count(F.lit(1)).alias("n"))


@register("delete_run", sql(CALLS, body="SELECT run, count(*) AS n FROM calls WHERE run <> 3 GROUP BY run"))
def delete_run(spark, d):
    return D.calls(spark, d).filter("run <> 3").groupBy("run").agg(F.count(F.lit(1)).alias("n"))


# --- reconstruction -----------------------------------------------------------------------------------------------------


@register("next_call", sql(CALLS, body="SELECT id, lead(id) OVER (PARTITION BY run ORDER BY order_id, id) AS next_id, lead(order_id) OVER (PARTITION BY run ORDER BY order_id, id) AS next_order FROM calls"))
def next_call(spark, d):
    order = W.partitionBy("run").orderBy("order_id", "id")
    return D.calls(spark, d).select("id", F.lead("id").over(order).alias("next_id"), F.lead("order_id").over(order).alias("next_order"))


@register("call_in_between", sql(CALLS, """probes AS (SELECT id, x AS lo, x + w AS hi FROM calls WHERE run = 1), points AS (SELECT x AS p FROM calls WHERE run = 2 AND from_fwd UNION ALL SELECT y FROM calls WHERE run = 2 AND NOT to_fwd)""", body="SELECT id, count(p) AS n FROM probes LEFT JOIN points ON p > lo AND p < hi GROUP BY id"))
def call_in_between(spark, d):
    from ..operators.rangejoin import interval_join

    c = D.calls(spark, d)
    probes = c.filter("run = 1").select("id", F.col("x").alias("lo"), (F.col("x") + F.col("w")).alias("hi"))
    other = c.filter("run = 2")
    points = other.filter("from_fwd").select(F.col("x").alias("lo")).unionByName(other.filter("not to_fwd").select(F.col("y").alias("lo")))
    points = points.groupBy("lo").agg(F.count(F.lit(1)).alias("c")).withColumn("hi", F.col("lo"))
    inside = (F.col("b_lo") > F.col("a_lo")) & (F.col("b_lo") < F.col("a_hi"))
    n = interval_join(probes, points, inside, cell=64).groupBy(F.col("a_id").alias("id")).agg(F.sum("b_c").alias("n"))
    return probes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


PATH = """oriented AS (SELECT id, run AS ctg, order_id, CASE WHEN mirrored THEN NOT to_fwd ELSE from_fwd END AS lf, CASE WHEN mirrored THEN NOT from_fwd ELSE to_fwd END AS ef,
    CASE WHEN mirrored THEN y ELSE x END AS fx, CASE WHEN mirrored THEN h ELSE w END AS fw, CASE WHEN mirrored THEN x ELSE y END AS tx, CASE WHEN mirrored THEN w ELSE h END AS tw FROM calls),
steps AS (SELECT *, CASE WHEN lf THEN fx + fw ELSE fx END AS leave, CASE WHEN ef THEN tx ELSE tx + tw END AS enter FROM oriented),
path AS (SELECT *, row_number() OVER w AS step, row_number() OVER (PARTITION BY ctg ORDER BY order_id DESC, id DESC) AS last_, lag(enter) OVER w AS at0, lag(ef) OVER w AS fwd0 FROM steps WINDOW w AS (PARTITION BY ctg ORDER BY order_id, id)),
placed AS (SELECT p.*, c.contig_id AS lc, CASE WHEN step = 1 THEN lf ELSE fwd0 END AS fwd, CASE WHEN step = 1 THEN CASE WHEN lf THEN c.start ELSE c.start + c.length - 1 END ELSE at0 END AS pos FROM path p JOIN contigs c ON leave >= c.start AND leave < c.start + c.length),
pieces AS (SELECT ctg AS ctg_order_id, step, pos AS start, CASE WHEN coalesce(c.contig_id = lc AND fwd = lf AND CASE WHEN fwd THEN pos <= leave ELSE pos >= leave END, false) THEN abs(leave - pos) + 1 ELSE 0 END AS len, fwd
    FROM placed p LEFT JOIN contigs c ON pos >= c.start AND pos < c.start + c.length
  UNION ALL SELECT ctg, step + 1, enter, CASE WHEN ef THEN c.start + c.length - enter ELSE enter - c.start + 1 END, ef
    FROM path p JOIN contigs c ON enter >= c.start AND enter < c.start + c.length WHERE last_ = 1 AND CASE WHEN ef THEN c.start + c.length - enter ELSE enter - c.start + 1 END < c.length // 2)"""


def _pieces(spark, d):
    from ..operators.genome import total_length
    from ..operators.reconstruct import segments

    c = D.contigs(spark, d)
    calls = D.calls(spark, d).withColumn("ctg_order_id", F.col("run")).withColumn("inserted", F.lit(""))
    return segments(calls, c, total_length(c)), c


@register("calls_to_seeds", sql(CALLS, CONTIGS, PATH, body="SELECT ctg_order_id, step, start, len, fwd FROM pieces"))
def calls_to_seeds(spark, d):
    return _pieces(spark, d)[0].drop("inserted")


@register("reconstruct_genome")
def reconstruct_genome(spark, d):
    from ..operators.genome import total_length
    from ..operators.reconstruct import genome

    pieces, c = _pieces(spark, d)
    return genome(pieces, c, total_length(c)).select("ctg_order_id", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


# --- evaluation ---------------------------------------------------------------------------------------------------------

#: Seeds of 14 letters as the truth, those of 12 as the data.
COMP = """diag AS (SELECT *, CASE WHEN fwd THEN r - q ELSE r + q END AS g FROM seeds), truth AS (SELECT * FROM diag WHERE len >= 14),
hit AS (SELECT t.read_id, t.contig_id, t.fwd, t.q, least(t.q + t.len, s.q + s.len) - greatest(t.q, s.q) AS nt, t.len FROM truth t JOIN diag s ON s.read_id = t.read_id AND s.contig_id = t.contig_id AND s.fwd = t.fwd AND s.g = t.g AND s.q < t.q + t.len AND t.q < s.q + s.len),
per AS (SELECT read_id, sum(nt)::BIGINT AS nt, count(*) AS n_overlaps, count(*) FILTER (nt * 10 >= len * 9) AS n90 FROM hit GROUP BY read_id)"""


def _compared(spark, d):
    from ..operators.seeds import diagonal

    s = seeds(spark, d).withColumn("g", diagonal())
    keys = ["read_id", "contig_id", "fwd", "g"]
    t = s.filter("len >= 14").select(*keys, F.col("q").alias("tq"), F.col("len").alias("tl"))
    hit = t.join(s, keys).filter("q < tq + tl and tq < q + len").withColumn("nt", F.least(F.col("tq") + F.col("tl"), F.col("q") + F.col("len")) - F.greatest("tq", "q"))
    return hit.groupBy("read_id").agg(F.sum("nt").alias("nt"), F.count(F.lit(1)).alias("n_overlaps"), F.count(F.when(F.col("nt") * 10 >= F.col("tl") * 9, 1)).alias("n90"))


@register("compare_seed_sets", sql(READS, CONTIGS, SEEDS, COMP, body="SELECT read_id, nt, n_overlaps, n90 FROM per"))
def compare_seed_sets(spark, d):
    return _compared(spark, d)


@register("seed_set_histogram", sql(READS, CONTIGS, SEEDS, COMP, body="SELECT n90, count(*) AS n FROM per GROUP BY n90"))
def seed_set_histogram(spark, d):
    return _compared(spark, d).groupBy("n90").agg(F.count(F.lit(1)).alias("n"))


@register("seed_columns")
def seed_columns(spark, d):
    from ..operators.evaluate import pack_columns

    return pack_columns(seeds(spark, d))
