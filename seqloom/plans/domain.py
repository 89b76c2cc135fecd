"""The driver's tables read as sequences, intervals, rectangles and graph edges; the same rules as SQL for the oracles."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LETTERS = string.ascii_uppercase
BASES = "".join("ACGT"[i % 4] for i in range(26))
#: The same with some letters read as unknown.
BASES_N = "".join("N" if ch in "KQWXZ" else b for ch, b in zip(LETTERS, BASES, strict=True))
SPACE = 4000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seq(text: str = "text", bases: str = BASES) -> Column:
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, bases)


def seq_sql(text: str = "text", bases: str = BASES) -> str:
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{bases}')"


def reads(spark: SparkSession, d: str, bases: str = BASES) -> DataFrame:
    """(read_id, sequencer, name, seq)"""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("read_id"), F.col("source").alias("sequencer"), F.concat(F.lit("r"), F.col("doc_id")).alias("name"), seq(bases=bases).alias("seq"))


def contigs(spark: SparkSession, d: str, bases: str = BASES) -> DataFrame:
    """(contig_id, name, length, start, seq): the collection of references, a small dimension table."""
    base = table(spark, d, "benchmark").select(F.col("item_id").alias("contig_id"), F.concat(F.lit("c"), F.col("item_id")).alias("name"), seq(bases=bases).alias("seq"))
    base = base.withColumn("length", F.length("seq").cast("long"))
    before = F.sum("length").over(W.orderBy("contig_id"))
    return base.select("contig_id", "name", "length", (before - F.col("length")).alias("start"), "seq")


def calls(spark: SparkSession, d: str) -> DataFrame:
    q, i = F.col("l_quantity").cast("long"), lambda c: F.col(c).cast("long")
    amb = i("l_suppkey") % 5
    nt = F.floor(F.col("l_extendedprice") / 100)
    return table(spark, d, "lineitem").select(
        ((((i("l_orderkey") * 10 + i("l_linenumber")) * 100000 + i("l_partkey")) * 10000 + i("l_suppkey")) * 100 + q).alias("id"),
        i("l_linenumber").alias("run"),
        (i("l_orderkey") * 37 % SPACE).alias("x"),
        (i("l_partkey") * 53 % SPACE).alias("y"),
        q.alias("w"),
        F.floor(F.col("l_tax") * 100 + 0.5).alias("h"),
        (F.col("l_returnflag") != "R").alias("from_fwd"),
        (F.col("l_linestatus") == "O").alias("to_fwd"),
        q.alias("reads"),
        nt.alias("nt"),
        amb.alias("ambiguity"),
        F.when(amb == 0, 0.0).otherwise(q / amb).alias("score"),
        (nt / F.greatest(q, F.lit(1))).alias("avg_nt"),
        (i("l_suppkey") % 30).alias("inserted_size"),
        (i("l_orderkey") % 500).alias("order_id"),
        (i("l_partkey") % 7 == 0).alias("mirrored"),
    )


CALLS = f"""calls AS (
  SELECT ((((l_orderkey::BIGINT * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::BIGINT) AS id,
    l_linenumber::BIGINT AS run, l_orderkey * 37 % {SPACE} AS x, l_partkey * 53 % {SPACE} AS y, l_quantity::BIGINT AS w,
    floor(l_tax * 100 + 0.5)::BIGINT AS h, l_returnflag <> 'R' AS from_fwd, l_linestatus = 'O' AS to_fwd,
    l_quantity::BIGINT AS reads, floor(l_extendedprice / 100)::BIGINT AS nt, l_suppkey % 5 AS ambiguity,
    CASE WHEN l_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE l_quantity::BIGINT::DOUBLE / (l_suppkey % 5) END AS score,
    floor(l_extendedprice / 100) / greatest(l_quantity::BIGINT, 1) AS avg_nt, l_suppkey % 30 AS inserted_size,
    l_orderkey % 500 AS order_id, l_partkey % 7 = 0 AS mirrored
  FROM lineitem)"""

READS = f"reads AS (SELECT doc_id AS read_id, source AS sequencer, 'r' || doc_id AS name, {seq_sql()} AS seq FROM documents)"
READS_N = f"reads AS (SELECT doc_id AS read_id, source AS sequencer, 'r' || doc_id AS name, {seq_sql(bases=BASES_N)} AS seq FROM documents)"


def contigs_sql(bases: str = BASES) -> str:
    return f"""contigs AS (
  SELECT contig_id, name, length(seq) AS length, sum(length(seq)) OVER (ORDER BY contig_id) - length(seq) AS start, seq
  FROM (SELECT item_id AS contig_id, 'c' || item_id AS name, {seq_sql(bases=bases)} AS seq FROM benchmark))"""


CONTIGS, CONTIGS_N = contigs_sql(), contigs_sql(BASES_N)


def jumps(spark: SparkSession, d: str) -> DataFrame:
    """Edges before they are brought to their canonical direction; an unknown end is null."""
    e, u = F.col("event_id"), F.col("user_id")
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    q = F.floor("value")
    return table(spark, d, "events").select(
        e.alias("id"), (e % 3 + 1).alias("run"), u.alias("read_id"),
        F.when(e % 19 != 1, (u * 97 + e * 13) % 5000).alias("from_pos"),
        F.when((e % 17 != 0) | (e % 19 == 1), (sec + e * 7) % 5000).alias("to_pos"),
        q.alias("query_from"), (q + e * 31 % 900).alias("query_to"),
        F.col("event_type").isin("view", "click", "signup").alias("from_fwd"), (e % 3 != 0).alias("to_fwd"), (e % 90 + 10).alias("nt"),
    )


JUMPS = """jumps0 AS (
  SELECT event_id AS id, event_id % 3 + 1 AS run, user_id AS read_id,
    CASE WHEN event_id % 19 <> 1 THEN (user_id * 97 + event_id * 13) % 5000 END AS from_pos,
    CASE WHEN event_id % 17 <> 0 OR event_id % 19 = 1 THEN (epoch_us(ts) // 60000000 + event_id * 7) % 5000 END AS to_pos,
    floor(value)::BIGINT AS query_from, floor(value)::BIGINT + event_id * 31 % 900 AS query_to,
    event_type IN ('view', 'click', 'signup') AS from_fwd, event_id % 3 <> 0 AS to_fwd, event_id % 90 + 10 AS nt
  FROM events)"""


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Alignment ranges of reads, half-open."""
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) % 100_000
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("read_id"), F.col("event_type").alias("sequencer"), sec.alias("r_start"),
        (sec + F.floor("value") * 20).alias("r_end"), (F.col("event_id") % 3 == 0).alias("is_primary"), (F.col("value") / 500).alias("mapq"),
    )


RANGES = """ranges AS (
  SELECT event_id AS id, user_id AS read_id, event_type AS sequencer, epoch_us(ts) // 1000000 % 100000 AS r_start,
    epoch_us(ts) // 1000000 % 100000 + floor(value)::BIGINT * 20 AS r_end, event_id % 3 = 0 AS is_primary, value / 500 AS mapq
  FROM events)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("run of "), F.col("o_custkey")).alias("descr"),
        F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).alias("ts"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("jump_run_id"),
    )


RUNS = """runs AS (
  SELECT o_orderkey AS id, o_orderpriority AS name, 'run of ' || o_custkey AS descr, epoch_us(o_orderdate) // 1000000 AS ts,
    CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS jump_run_id
  FROM orders)"""


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
