"""SAM text: alignments in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED = 16, 256, 2048, 4
PAIRED, PROPER, MATE_REVERSE, FIRST, LAST = 1, 2, 32, 64, 128


def flag(reverse: Column, secondary: Column, supplementary: Column) -> Column:
    bit = lambda c, n: F.when(c, n).otherwise(0)
    return bit(reverse, REVERSE) + bit(secondary, SECONDARY) + bit(supplementary, SUPPLEMENTARY)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, rname, pos, mapq, cigar, seq, qual, reverse, secondary, supplementary, ref_len); pos is 0-based.

    Header lines and lines with fewer than eleven fields are skipped.
    """
    from ..functions.sequence import cigar_length

    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@")).filter(F.size(f) >= 11)
    out = rows.select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), (f[3].cast("long") - 1).alias("pos"), (f[4].cast("double") / 255).alias("mapq"),
        f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"),
    )
    has = lambda n: F.col("flag").bitwiseAND(n) != 0
    return out.withColumns({
        "reverse": has(REVERSE), "secondary": has(SECONDARY), "supplementary": has(SUPPLEMENTARY), "ref_len": cigar_length(F.col("cigar"), "MDN=X"),
    })


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """The ten-column variant: name in column 3, CIGAR in column 9 (0-based), the rest as text."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(f) >= 10)
    return rows.select(f[3].alias("qname"), f[9].alias("cigar"), F.array_join(F.slice(f, 1, 3), "\t").alias("place"))


def lines(rows: DataFrame) -> DataFrame:
    """(line) of alignments (qname, flag, rname, pos 0-based, mapq 0..1 or null, cigar, seq, qual)."""
    quality = F.when(F.col("mapq").isNull(), 255).otherwise(F.ceil(F.col("mapq") * 254))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    return rows.select(
        F.concat_ws(
            "\t", "qname", F.col("flag").cast("string"), text("rname"), F.coalesce((F.col("pos") + 1).cast("string"), F.lit("0")), quality.cast("string"),
            text("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), text("seq"), text("qual"),
        ).alias("line")
    )


def paired_lines(rows: DataFrame) -> DataFrame:
    """Lines of mates (pair_id, first, and the columns of ``lines``): pair flags, RNEXT, PNEXT and signed template length."""
    end = F.col("pos") + F.col("ref_len")
    keep = rows.withColumn("stop", end)
    mate = keep.select("pair_id", (~F.col("first")).alias("first"), F.col("rname").alias("m_rname"), F.col("pos").alias("m_pos"), F.col("stop").alias("m_stop"), F.col("flag").alias("m_flag"))
    both = keep.join(mate, ["pair_id", "first"], "left")
    together = F.col("rname") == F.col("m_rname")
    bits = (
        F.lit(PAIRED) + F.when(F.col("first"), FIRST).otherwise(LAST) + F.when(together, PROPER).otherwise(0)
        + F.when(F.col("m_flag").bitwiseAND(REVERSE) != 0, MATE_REVERSE).otherwise(0)
    )
    span = F.greatest("stop", "m_stop") - F.least("pos", "m_pos")
    length = F.when(together, F.when(F.col("first"), span).otherwise(-span)).otherwise(0)
    quality = F.when(F.col("mapq").isNull(), 255).otherwise(F.ceil(F.col("mapq") * 254))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    return both.select(
        F.concat_ws(
            "\t", "qname", (F.col("flag") + F.coalesce(bits, F.lit(PAIRED))).cast("string"), text("rname"), F.coalesce((F.col("pos") + 1).cast("string"), F.lit("0")), quality.cast("string"), text("cigar"),
            F.when(together, "=").otherwise(text("m_rname")), F.coalesce((F.col("m_pos") + 1).cast("string"), F.lit("0")), F.coalesce(length, F.lit(0)).cast("string"), text("seq"), text("qual"),
        ).alias("line")
    )


def write_sam(rows: DataFrame, contigs: DataFrame, path: str) -> None:
    """A folder with header and alignment lines as text, the header in the first file."""
    header = contigs.orderBy("contig_id").select(F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("line")).coalesce(1)
    header.write.mode("overwrite").text(path)
    lines(rows).write.mode("append").text(path)
