"""Exact deduplication with a heavy-hitter split. DataFrame functions only.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Frequent digests are
found by a Misra-Gries type summary (approx_top_k: bounded counters, merged over tasks), counted exactly, and their
winners, at most 1 / SUPPORT rows, are broadcast: rows of these groups never meet in one task. The winners of all other
digests come from an ordinary shuffle, combined before it. Of these, those of groups with a share of 1 / MANY of all rows, at
most MANY, are broadcast to their rows too; only smaller groups meet their winner in a shuffle join.

Defined cases: null text counts as empty, so null, empty and blank texts form one group. Of equal texts the one with the
most code points stays, then the smallest id; a null id loses to any other; of rows equal in both, exactly one stays.
Ids may repeat. Extra columns are ignored by ``exact_dedup`` and kept by ``drop_exact_copies``. An empty table gives an
empty result. Very long texts are digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, stage

#: A digest that makes up at least this share of all rows is handled map-side.
SUPPORT = 1 / 1000
#: Counters of each summary; any digest above SUPPORT of the rows is among them.
COUNTERS = 4096
#: Groups of tasks whose summaries are merged. A digest with SUPPORT of all rows has it in one group at least, so at most
#: MERGERS / SUPPORT candidates are verified.
MERGERS = 16
#: Groups that have at least 1 / MANY of all rows get their winner by a broadcast.
MANY = 50_000


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without white space, in UTF-8."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def _heavy(rows: DataFrame, total: int) -> DataFrame:
    """(digest, keep, group_size) of digests with at least SUPPORT of all rows, counted exactly."""
    least = max(2, -(-int(total * SUPPORT * 1e6) // 1_000_000))
    rows.createOrReplaceTempView(view := f"digests_{abs(hash(rows)) % 10**9}")
    top = rows.sparkSession.sql(f"""
        SELECT inline(top), n FROM (
            SELECT approx_top_k(digest, {int(1 / SUPPORT)}, {COUNTERS}) AS top, count(*) AS n
            FROM {view} GROUP BY pmod(shiftright(rid, 33), {MERGERS}))""")
    rows.sparkSession.catalog.dropTempView(view)
    likely = top.filter(F.col("count") >= F.col("n") * SUPPORT).select(F.col("item").alias("digest")).distinct()
    return _winners(rows.join(F.broadcast(likely), "digest", "left_semi")).filter(F.col("group_size") >= least)


def _winners(rows: DataFrame) -> DataFrame:
    order = F.struct((-F.col("n_cp")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))
    return rows.groupBy("digest").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = F.col(text_col)
    rows = stage(
        df.select(
            F.col(id_col).alias("id"),
            F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_cp"),
            text_digest(text).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "digests",
    )
    total = rows.count()
    heavy = stage(_heavy(rows, total), "heavy")
    cold = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    winners = stage(_winners(cold), "winners")
    large = F.col("group_size") >= max(2, -(-total // MANY))
    known = stage(heavy.unionByName(winners.filter(large)), "known")  # at most 1 / SUPPORT + MANY rows
    hot = rows.join(bounded(known, 96), "digest")
    cold = rows.join(bounded(known.select("digest"), 16), "digest", "left_anti")
    return (
        hot.unionByName(cold.join(winners.filter(~large), "digest"))
        .select(
            F.col("id").alias(id_col),
            F.col("keep.id").alias("keep_id"),
            "group_size",
            (F.col("rid") == F.col("keep.rid")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def drop_exact_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df that stay, with all columns, whatever their names. Only ids travel: copies are removed by an anti-join on the id.

    Where ids repeat or are null, rows are matched by id, digest and length instead, and one of each is kept.
    """
    found = stage(exact_dedup(df, text_col, id_col), "verdicts")
    n = found.agg(F.count(F.lit(1)), F.count(id_col), F.countDistinct(id_col)).first()
    if n[0] == n[1] == n[2]:
        gone = found.filter(~F.col("kept")).select(id_col)
        return df.join(bounded(gone, 64), id_col, "left_anti")
    keys = [fresh(df, x) for x in ("row_id", "row_sha", "row_cp")]
    k_id, k_sha, k_cp = (fresh(df, x) for x in ("k_id", "k_sha", "k_cp"))
    text = F.col(text_col)
    keyed = df.withColumns(dict(zip(keys, (F.col(id_col), text_digest(text), F.length(F.coalesce(text, F.lit("")))), strict=True)))
    kept = found.filter("kept").select(F.col(id_col).alias(k_id), F.col("text_sha256").alias(k_sha))
    same = F.col(keys[0]).eqNullSafe(F.col(k_id)) & (F.col(keys[1]) == F.col(k_sha))
    longest = keyed.join(kept, same, "left_semi").groupBy(*keys[:2]).agg(F.max(keys[2]).alias(k_cp))
    longest = longest.select(F.col(keys[0]).alias(k_id), F.col(keys[1]).alias(k_sha), k_cp)
    stays = keyed.join(longest, same & (F.col(keys[2]) == F.col(k_cp)), "left_semi")
    return stays.dropDuplicates(keys).drop(*keys)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER w = 1 AS kept,
  h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY cp DESC, doc_id ASC NULLS LAST)
"""
