"""FASTA and FASTQ text in and out. Compressed files are read by their extension, as Spark does for any text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, seq string, qual string"


def parse(text: str) -> Iterator[tuple[str, str, str | None]]:
    """Records (name up to the first blank, sequence, quality or None) of FASTA or FASTQ text; sequences may span lines.

    A line that belongs to no record, an empty sequence, or a quality of another length is an error.
    """
    lines = iter(re.split(r"\r\n|\n|\r", text))
    line = next(lines, None)
    while line is not None:
        if not line.strip():
            line = next(lines, None)
            continue
        kind = line[0]
        if kind not in ">@":
            raise ValueError(f"not the start of a record: {line[:60]!r}")
        name, seq = line[1:].split(" ")[0].strip(), []
        line = next(lines, None)
        while line is not None and not (line[:1] in (">", "+") if kind == "@" else line[:1] in (">", "@")):
            seq.append(line.strip())
            line = next(lines, None)
        letters, quality = "".join(seq), None
        if not letters:
            raise ValueError(f"record {name!r} is empty")
        if kind == "@":
            if line is None or line[:1] != "+":
                raise ValueError(f"record {name!r} has no quality")
            quality = ""
            while len(quality) < len(letters) and (line := next(lines, None)) is not None:
                quality += line.strip("\r\n")
            if len(quality) != len(letters):
                raise ValueError(f"quality of record {name!r} has length {len(quality)}, not {len(letters)}")
            line = next(lines, None)
        yield name, letters, quality


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """Records of text at hand."""
    return spark.createDataFrame(list(parse(text)), SCHEMA)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual = null): one record a row; large files are split between records."""
    parts = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    body = F.regexp_replace("value", r"^\s*>", "")
    lines = F.split(F.regexp_replace(body, "\r", ""), "\n")
    name = F.split(lines[0], r"\s")[0]
    seq = F.array_join(F.transform(F.slice(lines, 2, 1 << 30), F.trim), "")
    checked = F.when(seq != "", seq).otherwise(F.raise_error(F.concat(F.lit("record is empty: "), name)))
    return parts.select(name.alias("name"), checked.alias("seq"), F.lit(None).cast("string").alias("qual"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual): a file is one task, since a quality line may look like the start of a record."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for text in part["value"]:
                batch = []
                for record in parse(text):
                    batch.append(record)
                    if len(batch) == 2000:
                        yield pd.DataFrame(batch, columns=["name", "seq", "qual"])
                        batch = []
                yield pd.DataFrame(batch, columns=["name", "seq", "qual"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, SCHEMA)


def paired(first: DataFrame, second: DataFrame, mate_pair: bool = True) -> DataFrame:
    """Mates by their ordinal (a column `ordinal` on both sides): the shorter side ends the pairs; the second mate is
    reverse-complemented if mate_pair."""
    from ..functions.sequence import reverse_complement

    a = first.select("ordinal", F.col("name").alias("name_1"), F.col("seq").alias("seq_1"), F.col("qual").alias("qual_1"))
    seq, qual = (reverse_complement(F.col("seq")), F.reverse("qual")) if mate_pair else (F.col("seq"), F.col("qual"))
    b = second.select("ordinal", F.col("name").alias("name_2"), seq.alias("seq_2"), qual.alias("qual_2"))
    return a.join(b, "ordinal")


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    text = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.coalesce("qual", F.expr("repeat('I', length(seq))")))
    df.select(text.alias("value")).write.mode("overwrite").text(path)
