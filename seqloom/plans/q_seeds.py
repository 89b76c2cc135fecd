"""Queries over seeds: matching, lumping, filters, strips."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import kmers as K
from ..operators import seed_kernels as KERN
from ..operators import seeds as S
from . import domain as D
from .catalog import register
from .domain import CONTIGS, READS, sql
from .q_sequence import RC, kmers_sql, minimizer_sql

K_ENTRY, K_SEED = 18, 12


def hits_cte(k: int, max_occ: int | None = None) -> str:
    rare = f"WHERE kmer IN (SELECT kmer FROM places GROUP BY kmer HAVING count(*) <= {max_occ})" if max_occ else ""
    return f"""places AS (
  SELECT contig_id, true AS fwd, pos AS r, kmer FROM {kmers_sql(k, "contigs", "contig_id")}
  UNION ALL SELECT contig_id, false, pos + {k - 1}, {RC("kmer")} FROM {kmers_sql(k, "contigs", "contig_id")}),
hits AS (SELECT a.read_id, p.contig_id, p.fwd, a.pos AS q, p.r FROM {kmers_sql(k, by="read_id")} a JOIN (SELECT * FROM places {rare}) p USING (kmer))"""


def seeds_cte(k: int, max_occ: int | None = None) -> str:
    return f"""{hits_cte(k, max_occ)},
cut_hits AS (SELECT *, CASE WHEN fwd THEN r - q ELSE r + q END AS diag FROM hits),
islands AS (SELECT *, sum(fresh) OVER w AS g FROM (SELECT *, CASE WHEN q - lag(q) OVER w <= {k} THEN 0 ELSE 1 END AS fresh FROM cut_hits WINDOW w AS (PARTITION BY read_id, contig_id, fwd, diag ORDER BY q)) WINDOW w AS (PARTITION BY read_id, contig_id, fwd, diag ORDER BY q)),
seeds AS (SELECT read_id, contig_id, fwd, min(q) AS q, max(q) - min(q) + {k} AS len, CASE WHEN fwd THEN min(r) ELSE max(r) END AS r FROM islands GROUP BY read_id, contig_id, fwd, diag, g)"""


SEEDS = seeds_cte(K_SEED)
COLS = "read_id, contig_id, fwd, q, len, r"
LO, HI = "CASE WHEN fwd THEN r ELSE r - len + 1 END", "CASE WHEN fwd THEN r + len - 1 ELSE r END"


def seeds(spark, d, k: int = K_SEED, max_occ: int | None = None):
    return S.max_extended(D.reads(spark, d), D.contigs(spark, d), k, max_occ)


@register("max_extended_seeds", sql(READS, CONTIGS, seeds_cte(K_ENTRY), body="SELECT read_id, contig_id, max(len) AS longest, count(*) AS n_seeds FROM seeds GROUP BY ALL"))
def max_extended_seeds(spark, d):
    return seeds(spark, d, K_ENTRY).groupBy("read_id", "contig_id").agg(F.max("len").alias("longest"), F.count(F.lit(1)).alias("n_seeds"))


@register("kmer_seeds", sql(READS, CONTIGS, hits_cte(K_SEED), body="SELECT read_id, contig_id, fwd, q, r FROM hits"))
def kmer_seeds(spark, d):
    return S.kmer_hits(D.reads(spark, d), D.contigs(spark, d), K_SEED)


@register("lump_seeds", sql(READS, CONTIGS, SEEDS, body=f"SELECT {COLS} FROM seeds"))
def lump_seeds(spark, d):
    return seeds(spark, d)


@register("seed_ambiguity", sql(READS, CONTIGS, hits_cte(K_SEED), body="SELECT read_id, q, count(*) AS ambiguity FROM hits GROUP BY ALL"))
def seed_ambiguity(spark, d):
    return S.kmer_hits(D.reads(spark, d), D.contigs(spark, d), K_SEED).groupBy("read_id", "q").agg(F.count(F.lit(1)).alias("ambiguity"))


@register("ambiguous_seed_filter", sql(READS, CONTIGS, seeds_cte(K_SEED, 1), body=f"SELECT {COLS} FROM seeds"))
def ambiguous_seed_filter(spark, d):
    return seeds(spark, d, max_occ=1)


@register("window_seeds_16", sql(READS, CONTIGS, hits_cte(16), body="SELECT read_id, contig_id, fwd, q, r FROM hits"))
def window_seeds_16(spark, d):
    return S.kmer_hits(D.reads(spark, d), D.contigs(spark, d), 16)


MM = f"""mm AS (SELECT r.read_id, c.contig_id, r.pos AS q, c.pos AS r, r.kmer FROM {minimizer_sql(15, 10, "reads", "read_id")} r
  JOIN {minimizer_sql(15, 10, "contigs", "contig_id")} c USING (kmer))"""


def _minimizer_seeds(spark, d):
    r = K.minimizers(K.spread(D.reads(spark, d).select("read_id", "seq")), 15, 10, ["read_id"]).withColumnRenamed("pos", "q")
    c = K.minimizers(D.contigs(spark, d).select("contig_id", "seq"), 15, 10, ["contig_id"]).withColumnRenamed("pos", "r")
    return r.join(c, "kmer").select("read_id", "contig_id", "q", "r", "kmer")


@register("minimizer_seeds", sql(READS, CONTIGS, MM, body="SELECT read_id, contig_id, q, r FROM mm"))
def minimizer_seeds(spark, d):
    return _minimizer_seeds(spark, d).drop("kmer")


@register("mm_filtered_seeds", sql(READS, CONTIGS, MM, body=f"""
    SELECT read_id, contig_id, q, r FROM mm LEFT JOIN (SELECT kmer, count(*) AS n FROM {minimizer_sql(15, 10, "reads", "read_id")} GROUP BY kmer HAVING count(*) > 2) f USING (kmer)
    WHERE coalesce(n, 0) <= 4"""))
def mm_filtered_seeds(spark, d):
    counts = K.minimizers(K.spread(D.reads(spark, d).select("read_id", "seq")), 15, 10, ["read_id"]).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    return _minimizer_seeds(spark, d).join(counts, "kmer", "left").filter(F.coalesce("n", F.lit(0)) <= 4).select("read_id", "contig_id", "q", "r")


@register("seeds_by_area", sql(READS, CONTIGS, SEEDS, body=f"SELECT {COLS} FROM seeds WHERE {LO} <= 60 AND {HI} >= 20"))
def seeds_by_area(spark, d):
    return S.by_area(seeds(spark, d), 20, 40)


@register("num_seeds_larger", sql(READS, CONTIGS, SEEDS, body="SELECT read_id, sum(len // 14)::BIGINT AS n, count(*) AS n_seeds, sum(len)::BIGINT AS nt FROM seeds GROUP BY read_id"))
def num_seeds_larger(spark, d):
    return seeds(spark, d).groupBy("read_id").agg(F.sum(F.floor(F.col("len") / 14)).alias("n"), F.count(F.lit(1)).alias("n_seeds"), F.sum("len").alias("nt"))


@register("seed_strands", sql(READS, CONTIGS, SEEDS, body="SELECT read_id, count(*) FILTER (fwd) AS n_fwd, count(*) FILTER (NOT fwd) AS n_rev, coalesce(sum(len) FILTER (fwd), 0) >= coalesce(sum(len) FILTER (NOT fwd), 0) AS main_fwd FROM seeds GROUP BY read_id"))
def seed_strands(spark, d):
    nt = lambda side: F.sum(F.when(side, F.col("len")).otherwise(0))
    f = F.col("fwd")
    return seeds(spark, d).groupBy("read_id").agg(F.count(F.when(f, 1)).alias("n_fwd"), F.count(F.when(~f, 1)).alias("n_rev"), (nt(f) >= nt(~f)).alias("main_fwd"))


@register("seed_mirror", sql(READS, CONTIGS, SEEDS, body="SELECT s.read_id, s.contig_id, NOT fwd AS fwd, length(r.seq) - (q + len) AS q, len, CASE WHEN fwd THEN s.r + len - 1 ELSE s.r - len + 1 END AS r FROM seeds s JOIN reads r USING (read_id)"))
def seed_mirror(spark, d):
    sizes = D.reads(spark, d).select("read_id", F.length("seq").cast("long").alias("n"))
    fwd = F.col("fwd")
    return seeds(spark, d).join(sizes, "read_id").select(
        "read_id", "contig_id", (~fwd).alias("fwd"), (F.col("n") - F.col("q") - F.col("len")).alias("q"), "len",
        F.when(fwd, F.col("r") + F.col("len") - 1).otherwise(F.col("r") - F.col("len") + 1).alias("r"),
    )


@register("confirm_seeds", sql(READS, CONTIGS, SEEDS, body=f"""
    SELECT s.contig_id, count(*) AS n, count(*) FILTER (substr(r.seq, (q + 1)::BIGINT, len::BIGINT) =
      CASE WHEN fwd THEN substr(c.seq, (s.r + 1)::BIGINT, len::BIGINT) ELSE {RC("substr(c.seq, (s.r - len + 2)::BIGINT, len::BIGINT)")} END) AS n_right
    FROM seeds s JOIN reads r USING (read_id) JOIN contigs c ON c.contig_id = s.contig_id GROUP BY 1"""))
def confirm_seeds(spark, d):
    from ..functions.sequence import reverse_complement

    s = S.span(seeds(spark, d)).join(D.reads(spark, d).select("read_id", F.col("seq").alias("qs")), "read_id").join(D.contigs(spark, d).select("contig_id", F.col("seq").alias("cs")), "contig_id")
    n = F.col("len").cast("int")
    ref = F.substr("cs", (F.col("lo") + 1).cast("int"), n)
    right = F.substr("qs", (F.col("q") + 1).cast("int"), n) == F.when(F.col("fwd"), ref).otherwise(reverse_complement(ref))
    return s.groupBy("contig_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(right, 1)).alias("n_right"))


# --- filters --------------------------------------------------------------------------------------------------------


@register("dedupe_seeds", sql(READS, CONTIGS, SEEDS, body="SELECT read_id, contig_id, bool_or(fwd) AS fwd, q, len, r FROM seeds GROUP BY read_id, contig_id, r, q, len"))
def dedupe_seeds(spark, d):
    return S.dedupe(seeds(spark, d))


@register("min_length", sql(READS, CONTIGS, SEEDS, body=f"SELECT {COLS} FROM seeds WHERE len >= 14"))
def min_length(spark, d):
    return seeds(spark, d).filter("len >= 14")


SMEM = """smems AS (SELECT s.* FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.read_id = s.read_id AND t.q <= s.q AND t.q + t.len >= s.q + s.len AND t.len > s.len))"""


@register("smem_filter", sql(READS, CONTIGS, SEEDS, SMEM, body=f"SELECT {COLS} FROM smems"))
def smem_filter(spark, d):
    return S.smems(seeds(spark, d))


@register("contig_border_filter", sql(READS, CONTIGS, SEEDS, body="SELECT s.read_id, s.contig_id, fwd, q, len, r FROM (SELECT *, " + LO + " AS lo, " + HI + " AS hi FROM seeds) s JOIN contigs c USING (contig_id) WHERE lo > 15 AND hi + 15 < c.length"))
def contig_border_filter(spark, d):
    return S.away_from_borders(seeds(spark, d), D.contigs(spark, d), 15)


@register("kmer_count_filter", sql(READS, CONTIGS, SEEDS, f"""over_ AS (SELECT kmer FROM {kmers_sql(10)} GROUP BY kmer HAVING count(*) > 40)""", body=f"""
    SELECT {COLS} FROM seeds WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT s2.read_id, s2.contig_id, s2.fwd, s2.q, s2.len, s2.r, substr(seq, (s2.q + i + 1)::BIGINT, 10) AS kmer
        FROM (SELECT s.*, unnest(range(0, len - 9)) AS i FROM seeds s) s2 JOIN reads USING (read_id)) k JOIN over_ USING (kmer)
      WHERE k.read_id = seeds.read_id AND k.contig_id = seeds.contig_id AND k.fwd = seeds.fwd AND k.q = seeds.q AND k.len = seeds.len AND k.r = seeds.r)"""))
def kmer_count_filter(spark, d):
    reads = D.reads(spark, d)
    return S.kmer_count_filter(seeds(spark, d), reads, K.kmer_counts(K.spread(reads), 10, []), 10, 40)


def islands_sql(axis: str, keys: str, gap: int, least: int) -> str:
    """Groups are cut where a seed begins more than `gap` after everything before it."""
    return f"""placed AS (SELECT *, {axis} AS s_, {axis} + len AS e_ FROM seeds),
cut AS (SELECT *, max(e_) OVER (PARTITION BY {keys} ORDER BY s_, e_, contig_id, r, fwd, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM placed),
grouped AS (SELECT *, sum(CASE WHEN before_ IS NULL OR s_ > before_ + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s_, e_, contig_id, r, fwd, q) AS g FROM cut)
SELECT {COLS} FROM (SELECT *, sum(len) OVER (PARTITION BY {keys}, g) AS nt FROM grouped) WHERE nt >= {least}"""


@register("isolated_group_filter", "WITH " + ",\n".join([READS, CONTIGS, SEEDS]) + ", " + islands_sql("q", "read_id", 100, 25))
def isolated_group_filter(spark, d):
    return S.isolated_groups(seeds(spark, d), "q", 100, 25)


@register("isolated_group_filter_reference", "WITH " + ",\n".join([READS, CONTIGS, SEEDS]) + ", " + islands_sql(LO, "read_id, contig_id", 30, 20))
def isolated_group_filter_reference(spark, d):
    return S.isolated_groups(seeds(spark, d), "lo", 30, 20)


@register("palindrome_filter", sql(READS, CONTIGS, SEEDS, f"s AS (SELECT *, {LO} AS lo, {HI} AS hi FROM seeds)", body=f"""
    SELECT {COLS} FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.read_id = a.read_id AND b.contig_id = a.contig_id AND b.fwd <> a.fwd
      AND a.q <= b.q + b.len - 1 AND b.q <= a.q + a.len - 1 AND a.lo <= b.hi AND b.lo <= a.hi AND (a.len < b.len OR (a.len = b.len AND NOT a.fwd)))"""))
def palindrome_filter(spark, d):
    return S.without_palindromes(seeds(spark, d))


@register("unique_position_filter", sql(READS, CONTIGS, SEEDS, body=f"SELECT {COLS} FROM (SELECT *, count(*) OVER (PARTITION BY read_id, q, len) AS c FROM seeds) WHERE c = 1"))
def unique_position_filter(spark, d):
    return S.unique_positions(seeds(spark, d))


# --- strips ---------------------------------------------------------------------------------------------------------

DELTA = "placed AS (SELECT s.*, length(rd.seq) AS q_len, CASE WHEN fwd THEN s.r + length(rd.seq) - q ELSE s.r + q END + (length(rd.seq) + 1) * s.contig_id AS delta FROM seeds s JOIN reads rd USING (read_id))"
#: A strip is (match * len(Q) - gap) / extend wide, here on a scale that suits short contigs.
STRIPS = """strips AS (
  SELECT a.read_id, a.contig_id, a.delta, sum(b.len)::BIGINT AS score, count(*) AS n_seeds
  FROM (SELECT DISTINCT read_id, contig_id, delta, q_len FROM placed) a
  JOIN placed b ON b.read_id = a.read_id AND b.contig_id = a.contig_id AND b.delta BETWEEN a.delta AND a.delta + (2 * a.q_len - 4) // 200
  GROUP BY ALL)"""


def _strips(spark, d):
    s = S.delta(seeds(spark, d), D.reads(spark, d))
    return s, S.strip_scores(s, F.floor((2 * F.col("q_len") - 4) / 200))


@register("seed_delta", sql(READS, CONTIGS, SEEDS, DELTA, body="SELECT read_id, contig_id, fwd, q, r, delta FROM placed"))
def seed_delta(spark, d):
    return _strips(spark, d)[0].select("read_id", "contig_id", "fwd", "q", "r", "delta")


@register("soc_score_window", sql(READS, CONTIGS, SEEDS, DELTA, STRIPS, body="SELECT read_id, contig_id, delta, score, n_seeds FROM strips"))
def soc_score_window(spark, d):
    return _strips(spark, d)[1]


@register("soc_best_per_read", sql(READS, CONTIGS, SEEDS, DELTA, STRIPS, body="""
    SELECT read_id, contig_id, delta, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, n_seeds, delta) AS rank FROM strips) WHERE rank <= 3"""))
def soc_best_per_read(spark, d):
    order = W.partitionBy("read_id").orderBy(F.desc("score"), "n_seeds", "delta")
    return _strips(spark, d)[1].withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("read_id", "contig_id", "delta", "score", "rank")


@register("feasible_socs", sql(READS, CONTIGS, SEEDS, DELTA, STRIPS, body="""
    SELECT s.read_id, s.contig_id, s.delta, s.score FROM strips s JOIN (SELECT DISTINCT read_id, q_len FROM placed) p USING (read_id) WHERE s.score >= least(150, 0.02 * q_len) AND s.n_seeds > 1"""))
def feasible_socs(spark, d):
    s, strips = _strips(spark, d)
    sizes = s.select("read_id", "q_len").distinct()
    return strips.join(sizes, "read_id").filter((F.col("score") >= F.least(F.lit(150), 0.02 * F.col("q_len"))) & (F.col("n_seeds") > 1)).select("read_id", "contig_id", "delta", "score")


# --- kernels: greedy or iterative rules without a SQL form; tests compare them with brute force -------------------------


@register("max_spanning")
def max_spanning(spark, d):
    return KERN.per_read(seeds(spark, d), KERN.max_spanning)


@register("filter_overlapping_seeds")
def filter_overlapping_seeds(spark, d):
    return KERN.per_read(seeds(spark, d), KERN.cut_overlaps)


@register("filter_overlapping_socs")
def filter_overlapping_socs(spark, d):
    return KERN.per_read(seeds(spark, d), KERN.resolve_overlaps)


@register("soc_stack")
def soc_stack(spark, d):
    return KERN.soc_stack(S.delta(seeds(spark, d), D.reads(spark, d)))


@register("harmonize")
def harmonize(spark, d):
    return KERN.per_read(seeds(spark, d), KERN.harmonize)


@register("reseed")
def reseed(spark, d):
    return KERN.reseed(seeds(spark, d, K_ENTRY), D.reads(spark, d), D.contigs(spark, d))


@register("seed_extension")
def seed_extension(spark, d):
    return KERN.extend(seeds(spark, d), D.reads(spark, d), D.contigs(spark, d))
