"""Site-relative line deduplication: lines that most pages of a host share are boilerplate. DataFrame functions only.

Pages are grouped by host; for each host, the pages that contain a line are divided by the host's pages, and lines above
RATIO go, once the host has MIN_PAGES pages and the line is on MIN_HITS of them. A host's boilerplate is a short list by
construction: pages have L lines on average, so at most L / RATIO lines can be on a share of RATIO of the pages. Large hosts are
counted in parts. While the lists are small in all, they are broadcast and no text is shuffled. Beyond that, hashes of the
pages' lines meet them in a join whose keys are salted, what is found is gathered by page, and pages join that by their number,
so that neither a host nor a line gathers in one task.

Defined cases: null texts have no lines and give an empty text; null hosts form a site of their own; blank lines are
never dropped or counted. Lines are compared without white space at their ends. A line that is repeated on one page
counts once for it, and each occurrence goes. Repeated pages count as often as they occur. Extra columns are ignored.
Empty tables give empty results. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, stage

RATIO = 0.3
MIN_PAGES = 5
MIN_HITS = 3
#: Parts into which each host's lines are dealt where its list is too large to be broadcast.
SALTS = 64
BLANKS = r"[\x20\x09-\x0D]"


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user, port or a leading www."""
    raw = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(raw, r"^www\.", "")


def lines_of_html(html: Column) -> Column:
    """Visible text as lines: scripts, styles, comments and heads go, block tags end lines, other tags vanish."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|nav|header|footer|main|aside|title|blockquote|pre|hr|form|option)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def _lines(text: Column) -> Column:
    """Lines without white space at their ends, blank ones left out."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, rf"^{BLANKS}+|{BLANKS}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def drop_boilerplate(pages: DataFrame, text: Column, host: Column, id_col: str = "page_id", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_hits: int = MIN_HITS, most: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, host, n_lines, n_dropped, text (the lines that stay, one below the other).

    Lists of up to `most` bytes are broadcast.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), _lines(text).alias("lines"))
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "lines")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    hits = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= min_hits)
    common = stage(hits.join(bounded(totals, 64), "host").filter(F.col("hits") / F.col("pages") > ratio).select("host", "line"), "boilerplate")
    n, letters = common.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("host")), F.lit(0))).first()
    if 24 * n + letters <= most:
        joined = rows.join(F.broadcast(common.groupBy("host").agg(F.collect_list("line").alias("boilerplate"))), "host", "left")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = rows.select("rid", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
        each = each.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
        of_page = each.join(salted, ["host", "line", "salt"]).groupBy("rid").agg(F.collect_list("line").alias("boilerplate"))
        joined = rows.join(of_page, "rid", "left")
    stays = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boilerplate", F.xxhash64(x))))
    return joined.select(
        F.col("id").alias(id_col),
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(stays)).cast("long").alias("n_dropped"),
        F.array_join(stays, "\n").alias("text"),
    )


#: The same over the table pages, with the production parameters.
ORACLE = r"""
WITH t1 AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', chr(10), 'g') AS t FROM pages),
t2 AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|nav|header|footer|main|aside|title|blockquote|pre|hr|form|option)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM t1),
t3 AS (SELECT page_id, coalesce(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', ''), '') AS host,
  replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM t2),
rows_ AS (SELECT row_number() OVER () AS rid, page_id, host, list_filter(list_transform(regexp_split_to_array(coalesce(t, ''), '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS lines FROM t3),
totals AS (SELECT host, count(*) AS pages FROM rows_ GROUP BY host HAVING count(*) >= 5),
hits AS (SELECT host, line, count(*) AS hits FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM rows_) GROUP BY ALL HAVING count(*) >= 3),
common AS (SELECT host, list(line) AS boilerplate FROM hits JOIN totals USING (host) WHERE hits::DOUBLE / pages > 0.3 GROUP BY host),
done AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boilerplate, []), x)) AS stays FROM rows_ LEFT JOIN common USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(stays) AS n_dropped, coalesce(array_to_string(stays, chr(10)), '') AS text FROM done
"""
