"""Column functions over nucleotide texts (upper-case A, C, G, T, N)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
#: Length of the pieces in which long texts are exploded: cutting a piece walks the text from its start.
CHUNK = 256


def complement(s: Column) -> Column:
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def from_to(s: Column, start: Column | int, end: Column | int) -> Column:
    """The half-open 0-based part [start, end)."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substr(s, a + 1, b - a)


def from_to_complement(s: Column, start: Column | int, end: Column | int) -> Column:
    """The reverse complement of [start, end), where positions count on the reverse strand."""
    return from_to(reverse_complement(s), start, end)


def char_at(s: Column, i: Column | int) -> Column:
    at = F.lit(i) if isinstance(i, int) else i
    return F.substr(s, at + 1, F.lit(1))


def normalise(s: Column) -> Column:
    """Upper case, with N for whatever is not a nucleotide."""
    return F.regexp_replace(F.upper(s), "[^ACGT]", "N")


def codes(s: Column) -> Column:
    """Array of codes 0 to 4."""
    return F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.split(F.translate(s, "ACGTN", "01234"), ""), lambda c: c.cast("int"))
    )


def is_valid(s: Column) -> Column:
    return s.rlike("^[ACGTN]*$")


def strip_tail(s: Column) -> Column:
    """Without trailing symbols that are no nucleotide codes (line ends, blanks)."""
    return F.regexp_replace(s, "[^ACGTNURYKMSWBDHVacgtnurykmswbdhv]+$", "")


def n_runs(s: Column) -> Column:
    """Array of (start, length) of the runs of N."""
    parts = F.regexp_extract_all(s, F.lit("N+|[^N]+"), 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("runs"))
    return F.aggregate(
        parts,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(p.startswith("N"), F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("start"), F.length(p).alias("length"))))).otherwise(acc["runs"]).alias("runs"),
        ),
    )["runs"]


def cigar(ops: Column) -> Column:
    """Text of an array of (op, len)."""
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def parse_cigar(text: Column) -> Column:
    """Array of (op, len) of a CIGAR text."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "([MIDNSHP=X])", 1).alias("op"), F.regexp_extract(p, "([0-9]+)", 1).cast("long").alias("len")))


def cigar_length(text: Column, consuming: str) -> Column:
    """Sum of the lengths of the operations in `consuming` (reference: MDN=X, query: MIS=X)."""
    return F.aggregate(
        F.filter(parse_cigar(text), lambda o: F.lit(consuming).contains(o["op"])), F.lit(0).cast("long"), lambda a, o: a + o["len"]
    )
