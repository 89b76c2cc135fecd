"""Queries over sequences, the contig collection, and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import genome as G
from ..operators import kmers as K
from . import domain as D
from .catalog import register
from .domain import BASES_N, CONTIGS, CONTIGS_N, READS, READS_N, sql

RC = "reverse(translate({0}, 'ACGT', 'TGCA'))".format


def _scalar(name: str, expr, sql_expr: str, column: str, noisy: bool = False) -> None:
    """A query (read_id, column) that applies one function to all reads, its length and digest standing for long texts."""
    head = READS_N if noisy else READS

    @register(name, sql(head, body=f"SELECT read_id, {sql_expr} AS {column} FROM reads"))
    def query(spark, d):
        return D.reads(spark, d, BASES_N if noisy else D.BASES).select("read_id", expr(F.col("seq")).alias(column))


_scalar("seq_encode", lambda s: F.md5(F.translate(s, "ACGTN", "01234")), "md5(translate(seq, 'ACGTN', '01234'))", "digest", True)
_scalar("seq_length", F.length, "length(seq)", "n")
_scalar("seq_reverse", lambda s: F.md5(F.reverse(s)), "md5(reverse(seq))", "digest")
_scalar("seq_complement", lambda s: F.md5(S.complement(s)), "md5(translate(seq, 'ACGT', 'TGCA'))", "digest", True)
_scalar("seq_revcomp", lambda s: F.md5(S.reverse_complement(s)), f"md5({RC('seq')})", "digest", True)
_scalar("seq_substring", lambda s: S.from_to(s, 10, 60), "substr(seq, 11, 50)", "part")
_scalar("seq_revcomp_substring", lambda s: S.from_to_complement(s, 5, 45), f"substr({RC('seq')}, 6, 40)", "part")
_scalar("seq_char_at", lambda s: S.char_at(s, 7), "substr(seq, 8, 1)", "base")
_scalar("seq_validate", S.is_valid, "regexp_full_match(seq, '[ACGTN]*')", "valid", True)
_scalar("seq_codes", lambda s: F.slice(S.codes(s), 1, 20).cast("string"), "'[' || array_to_string(string_split(translate(substr(seq, 1, 20), 'ACGTN', '01234'), ''), ', ') || ']'", "codes", True)
_scalar("seq_concat", lambda s: F.length(F.concat(s, S.reverse_complement(s))), "2 * length(seq)", "n")
_scalar("seq_normalise", lambda s: F.md5(S.normalise(F.lower(s))), "md5(regexp_replace(upper(lower(seq)), '[^ACGT]', 'N', 'g'))", "digest", True)


@register("seq_equal_pairs", sql(READS, body="SELECT a.read_id AS a_id, b.read_id AS b_id FROM reads a JOIN reads b ON a.seq = b.seq AND a.read_id < b.read_id WHERE length(a.seq) BETWEEN 1 AND 400"))
def seq_equal_pairs(spark, d):
    r = D.reads(spark, d).filter(F.length("seq").between(1, 400))
    a, b = r.select(F.col("read_id").alias("a_id"), "seq"), r.select(F.col("read_id").alias("b_id"), "seq")
    return a.join(b, "seq").filter("a_id < b_id").select("a_id", "b_id")


@register("seq_strip_tail", "SELECT doc_id AS read_id, length(regexp_replace(text, '[^ACGTNURYKMSWBDHVacgtnurykmswbdhv]+$', '')) AS n FROM documents")
def seq_strip_tail(spark, d):
    return D.table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.length(S.strip_tail(F.col("text"))).alias("n"))


@register("contig_table", sql(CONTIGS, body="SELECT contig_id, name, length, start FROM contigs"))
def contig_table(spark, d):
    return D.contigs(spark, d).select("contig_id", "name", "length", "start")


FWD = "(SELECT sum(length) FROM contigs)"
#: Positions on both strands, from the reads' ids and lengths.
POINTS = f"points AS (SELECT read_id, (read_id * 7919 + length(seq)) % (2 * {FWD}) AS pos FROM reads)"


def _points(spark, d):
    c = D.contigs(spark, d)
    f = G.total_length(c)
    return D.reads(spark, d).select("read_id", ((F.col("read_id") * 7919 + F.length("seq")) % (2 * f)).alias("pos")), c, f


ABS = f"CASE WHEN pos >= {FWD} THEN 2 * {FWD} - 1 - pos ELSE pos END"


@register("contig_for_position", sql(READS, CONTIGS, POINTS, body=f"""
    SELECT p.read_id, p.pos, c.contig_id, {ABS} - c.start AS "offset", 2 * c.contig_id + (pos >= {FWD})::INT AS strand_id
    FROM points p LEFT JOIN contigs c ON {ABS} >= c.start AND {ABS} < c.start + c.length"""))
def contig_for_position(spark, d):
    p, c, f = _points(spark, d)
    return G.locate(p, c, f)


@register("pos_to_reverse", sql(READS, CONTIGS, POINTS, body=f"SELECT read_id, pos, 2 * {FWD} - 1 - pos AS rev, pos >= {FWD} AS on_reverse, {ABS} AS forward_pos FROM points"))
def pos_to_reverse(spark, d):
    p, _, f = _points(spark, d)
    pos = F.col("pos")
    return p.select("read_id", "pos", G.to_reverse(pos, f).alias("rev"), G.is_reverse(pos, f).alias("on_reverse"), G.absolute(pos, f).alias("forward_pos"))


@register("contig_by_name", sql(READS, CONTIGS, body="SELECT r.read_id, coalesce(c.start, 0) AS start, coalesce(c.length, 0) AS length, coalesce(c.contig_id, -1) AS contig_id FROM reads r LEFT JOIN contigs c ON c.name = 'c' || (r.read_id % 60)"))
def contig_by_name(spark, d):
    r = D.reads(spark, d).select("read_id", F.concat(F.lit("c"), F.col("read_id") % 60).alias("name"))
    found = r.join(D.contigs(spark, d).drop("seq"), "name", "left")
    return found.select("read_id", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("contig_id", F.lit(-1)).alias("contig_id"))


#: Forward intervals [pos, pos + 60) and the contigs of both ends.
SPANS = f"""spans AS (
  SELECT p.read_id, p.pos, p.pos + 59 AS last, a.contig_id AS c1, b.contig_id AS c2, a.start + a.length AS end1, b.start AS start2
  FROM (SELECT read_id, pos % ({FWD} - 60) AS pos FROM points) p
  JOIN contigs a ON p.pos >= a.start AND p.pos < a.start + a.length
  JOIN contigs b ON p.pos + 59 >= b.start AND p.pos + 59 < b.start + b.length)"""


def _spans(spark, d):
    p, c, f = _points(spark, d)
    p = p.select("read_id", (F.col("pos") % (f - 60)).alias("pos")).withColumn("last", F.col("pos") + 59)
    one = G.locate(p, c, f).select("read_id", "pos", "last", F.col("contig_id").alias("c1"), (F.col("pos") - F.col("offset")).alias("start1"))
    two = G.locate(one, c, f, "last").select("read_id", "pos", "last", "c1", "start1", F.col("contig_id").alias("c2"), (F.col("last") - F.col("offset")).alias("start2"))
    sizes = c.select(F.col("contig_id").alias("c1"), "length")
    return two.join(F.broadcast(sizes) if c.count() <= 100_000 else sizes, "c1").withColumn("end1", F.col("start1") + F.col("length"))


@register("is_bridging", sql(READS, CONTIGS, POINTS, SPANS, body="SELECT read_id, pos, c1 <> c2 AS bridging FROM spans"))
def is_bridging(spark, d):
    return _spans(spark, d).select("read_id", "pos", (F.col("c1") != F.col("c2")).alias("bridging"))


@register("unbridge", sql(READS, CONTIGS, POINTS, SPANS, body="""
    SELECT read_id, CASE WHEN c1 = c2 OR end1 - pos >= last + 1 - start2 THEN pos ELSE start2 END AS start_pos,
      CASE WHEN c1 = c2 THEN 60 WHEN end1 - pos >= last + 1 - start2 THEN end1 - pos ELSE last + 1 - start2 END AS len FROM spans"""))
def unbridge(spark, d):
    left, right = F.col("end1") - F.col("pos"), F.col("last") + 1 - F.col("start2")
    same = F.col("c1") == F.col("c2")
    return _spans(spark, d).select(
        "read_id", F.when(same | (left >= right), F.col("pos")).otherwise(F.col("start2")).alias("start_pos"), F.when(same, 60).when(left >= right, left).otherwise(right).alias("len")
    )


_EXTRACT = f"""
    SELECT p.read_id, p.pos AS start_pos, 25 AS len, CASE WHEN pos < {FWD} THEN
        CASE WHEN pos - c.start + 25 <= c.length THEN substr(c.seq, (pos - c.start + 1)::BIGINT, 25) END
      ELSE CASE WHEN {ABS} - c.start - 24 >= 0 THEN {RC(f"substr(c.seq, ({ABS} - c.start - 23)::BIGINT, 25)")} END END AS part
    FROM points p JOIN contigs c ON {ABS} >= c.start AND {ABS} < c.start + c.length"""


def _extract(spark, d, noisy):
    p, _, _ = _points(spark, d)
    c = D.contigs(spark, d, BASES_N) if noisy else D.contigs(spark, d)
    rows = p.select("read_id", F.col("pos").alias("start_pos"), F.lit(25).alias("len"))
    return G.extract(rows, c, G.total_length(c)).select("read_id", "start_pos", "len", "part")


@register("extract_interval", sql(READS, CONTIGS, POINTS, body=_EXTRACT))
def extract_interval(spark, d):
    return _extract(spark, d, False)


@register("extract_with_holes", sql(READS, CONTIGS_N, POINTS, body=_EXTRACT))
def extract_with_holes(spark, d):
    return _extract(spark, d, True)


@register("extract_contig_ends", sql(CONTIGS, body=f"SELECT contig_id, substr(seq, 1, 20) AS head, substr(seq, greatest(length - 19, 1), 20) AS tail, {RC('seq')} AS reverse_strand FROM contigs"))
def extract_contig_ends(spark, d):
    s, n = F.col("seq"), F.col("length").cast("int")
    return D.contigs(spark, d).select("contig_id", F.substr(s, F.lit(1), F.lit(20)).alias("head"), F.substr(s, F.greatest(n - 19, F.lit(1)), F.lit(20)).alias("tail"), S.reverse_complement(s).alias("reverse_strand"))


#: Runs of N: a position that follows another symbol starts one.
HOLES = """holes AS (
  SELECT contig_id, min(i) AS start, count(*) AS length
  FROM (SELECT contig_id, i, i - row_number() OVER (PARTITION BY contig_id ORDER BY i) AS g
        FROM (SELECT contig_id, seq, unnest(range(0, length)) AS i FROM contigs) WHERE substr(seq, i + 1, 1) = 'N')
  GROUP BY contig_id, g)"""


@register("hole_runs", sql(CONTIGS_N, HOLES, body="SELECT contig_id, start, length FROM holes"))
def hole_runs(spark, d):
    return G.holes(D.contigs(spark, d, BASES_N))


@register("hole_fraction", sql(CONTIGS_N, HOLES, body="SELECT c.contig_id, sum(CASE WHEN h.start IS NULL THEN 0 ELSE greatest(0, least(h.start + h.length, 120) - greatest(h.start, 20)) END) / 100.0 AS fraction FROM contigs c LEFT JOIN holes h USING (contig_id) GROUP BY 1"))
def hole_fraction(spark, d):
    c = D.contigs(spark, d, BASES_N)
    h = G.holes(c)
    part = F.greatest(F.lit(0), F.least(F.col("start") + F.col("length"), F.lit(120)) - F.greatest(F.col("start"), F.lit(20)))
    per = h.groupBy("contig_id").agg(F.sum(part).alias("n"))
    return c.select("contig_id").join(per, "contig_id", "left").select("contig_id", (F.coalesce("n", F.lit(0)) / 100.0).alias("fraction"))


@register("genome_concat", sql(CONTIGS_N, body="SELECT md5(string_agg(seq, '' ORDER BY contig_id)) AS forward, md5(string_agg(" + RC("seq") + ", '' ORDER BY contig_id DESC)) AS reverse, sum(length)::BIGINT AS n FROM contigs"))
def genome_concat(spark, d):
    c = D.contigs(spark, d, BASES_N)
    parts = F.sort_array(F.collect_list(F.struct("contig_id", "seq")))
    whole = c.agg(parts.alias("p"), F.sum("length").alias("n")).select(F.array_join(F.col("p.seq"), "").alias("s"), "n")
    return whole.select(F.md5("s").alias("forward"), F.md5(S.reverse_complement(F.col("s"))).alias("reverse"), "n")


@register("clip_to_contig", sql(READS, CONTIGS, POINTS, body=f"""
    SELECT p.read_id, greatest({ABS} - 50, c.start) AS lo, least({ABS} + 50, c.start + c.length) AS hi
    FROM points p JOIN contigs c ON {ABS} >= c.start AND {ABS} < c.start + c.length"""))
def clip_to_contig(spark, d):
    p, c, f = _points(spark, d)
    at = G.absolute(F.col("pos"), f)
    found = G.locate(p, c, f).withColumn("c_start", at - F.col("offset")).join(c.select("contig_id", "length"), "contig_id")
    return found.select("read_id", F.greatest(at - 50, F.col("c_start")).alias("lo"), F.least(at + 50, F.col("c_start") + F.col("length")).alias("hi"))


# --- counting -------------------------------------------------------------------------------------------------------


def kmers_sql(k: int, source: str = "reads", by: str = "read_id, sequencer", stride: int = 1) -> str:
    return f"(SELECT {by}, i AS pos, substr(seq, i + 1, {k}) AS kmer FROM (SELECT {by}, seq, unnest(range(0, length(seq) - {k - 1}, {stride})) AS i FROM {source}))"


@register("kmer_count", sql(READS_N, body=f"SELECT sequencer, kmer, count(*) AS n FROM {kmers_sql(6)} WHERE kmer NOT LIKE '%N%' GROUP BY ALL"))
def kmer_count(spark, d):
    return K.kmer_counts(K.spread(D.reads(spark, d, BASES_N)), 6, ["sequencer"])


@register("kmer_count_both_strands", sql(READS_N, body=f"""
    SELECT kmer, count(*) AS n FROM (SELECT kmer FROM {kmers_sql(6)} UNION ALL SELECT {RC('kmer')} FROM {kmers_sql(6)}) WHERE kmer NOT LIKE '%N%' GROUP BY ALL"""))
def kmer_count_both_strands(spark, d):
    return K.kmer_counts(K.spread(D.reads(spark, d, BASES_N)), 6, [], both_strands=True)


@register("kmer_count_stride", sql(READS, body=f"SELECT kmer, count(*) AS n FROM {kmers_sql(18, stride=5)} GROUP BY ALL HAVING count(*) > 3"))
def kmer_count_stride(spark, d):
    return K.kmer_counts(K.spread(D.reads(spark, d)), 18, [], stride=5).filter("n > 3")


@register("kmer_filter_table", sql(READS, body=f"SELECT sequencer, kmer, count(*) AS num_occ FROM {kmers_sql(18)} GROUP BY ALL HAVING count(*) > 10"))
def kmer_filter_table(spark, d):
    return K.kmer_counts(K.spread(D.reads(spark, d)), 18, ["sequencer"]).filter("n > 10").withColumnRenamed("n", "num_occ")


@register("kmer_unique_reads", sql(READS, body=f"""
    SELECT read_id, count(*) AS n, count(*) FILTER (c <= 1) AS n_unique FROM (SELECT read_id, count(*) OVER (PARTITION BY kmer) AS c FROM {kmers_sql(18)}) GROUP BY read_id"""))
def kmer_unique_reads(spark, d):
    return K.unique_kmers(D.reads(spark, d).select("read_id", "seq"), 18)


def minimizer_sql(k: int, w: int, source: str, by: str) -> str:
    return f"""(SELECT DISTINCT {by}, m.pos AS pos, m.kmer AS kmer FROM (
      SELECT {by}, pos, min({{'kmer': kmer, 'pos': pos}}) OVER g AS m, count(*) OVER g AS room FROM {kmers_sql(k, source, by)}
      WINDOW g AS (PARTITION BY {by} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)) WHERE room = {w} OR pos = 0)"""


@register("minimizer_count_sql", sql(READS, body=f"SELECT kmer, count(*) AS n, count(DISTINCT read_id) AS n_reads FROM {minimizer_sql(15, 10, 'reads', 'read_id')} GROUP BY kmer HAVING count(*) > 1"))
def minimizer_count_sql(spark, d):
    m = K.minimizers(K.spread(D.reads(spark, d).select("read_id", "seq")), 15, 10, ["read_id"])
    per = m.groupBy("kmer", "read_id").agg(F.count(F.lit(1)).alias("c")).groupBy("kmer").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_reads"))
    return per.filter("n > 1")


@register("mm_filter_lookup", sql(READS, CONTIGS, body=f"""
    SELECT c.contig_id, c.pos, c.kmer, coalesce(n, 0) AS num_occ FROM {minimizer_sql(15, 10, 'contigs', 'contig_id')} c
    LEFT JOIN (SELECT kmer, count(*) AS n FROM {minimizer_sql(15, 10, 'reads', 'read_id')} GROUP BY kmer) r USING (kmer)"""))
def mm_filter_lookup(spark, d):
    c = K.minimizers(D.contigs(spark, d).select("contig_id", "seq"), 15, 10, ["contig_id"])
    r = K.minimizers(K.spread(D.reads(spark, d).select("read_id", "seq")), 15, 10, ["read_id"]).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return c.join(r, "kmer", "left").select("contig_id", "pos", "kmer", F.coalesce("n", F.lit(0)).alias("num_occ"))


@register("minimizer_sketch")
def minimizer_sketch(spark, d):
    return K.exact_sketch(K.spread(D.reads(spark, d)), 15, 10)


#: Each read counts once for every bin of 100 positions that one of its ranges touches.
COVER = "(SELECT DISTINCT sequencer, read_id, unnest(range(r_start // 100, (greatest(r_end - 1, r_start)) // 100 + 1)) AS bin_id FROM ranges)"


def _coverage(spark, d):
    from ..operators.counting import bin_coverage

    return bin_coverage(D.ranges(spark, d), ["sequencer"], "read_id", "r_start", F.greatest(F.col("r_end") - 1, F.col("r_start")), 100)


@register("coverage_bins", sql(D.RANGES, body=f"SELECT sequencer, bin_id, count(*) AS bin_coverage FROM {COVER} GROUP BY ALL"))
def coverage_bins(spark, d):
    return _coverage(spark, d)


@register("coverage_zero_filled", sql(D.RANGES, body=f"""
    SELECT b.bin_id, coalesce(n, 0) AS bin_coverage FROM (SELECT unnest(range(0, 1100)) AS bin_id) b
    LEFT JOIN (SELECT bin_id, count(*) AS n FROM {COVER} WHERE sequencer = 'purchase' GROUP BY bin_id) USING (bin_id)"""))
def coverage_zero_filled(spark, d):
    from ..operators.counting import zero_filled

    return zero_filled(_coverage(spark, d).filter("sequencer = 'purchase'"), 1100)


@register("kmer_size_for_rectangle", sql(D.CALLS, body="""
    SELECT id, coalesce(list_min(list_filter(range(2, least(w, h) + 1), lambda k: pow(1 - pow(0.25, k), (w - k + 1) * (h - k + 1)) >= 0.99)), least(w, h) + 1) AS k FROM calls"""))
def kmer_size_for_rectangle(spark, d):
    from ..operators.counting import kmer_size_for_rectangle as size

    return D.calls(spark, d).select("id", size(F.col("w"), F.col("h"), 0.01).alias("k"))


@register("read_length_histogram", sql(READS, body="SELECT length(seq) // 500 AS bucket, count(*) AS n, max(length(seq)) AS longest FROM reads GROUP BY 1"))
def read_length_histogram(spark, d):
    n = F.length("seq")
    return D.reads(spark, d).groupBy(F.floor(n / 500).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("longest"))


