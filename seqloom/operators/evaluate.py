"""Evaluation and drawing: packing of intervals into columns."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seeds import span


def columns_of(intervals: list[tuple[int, int]], space: int) -> list[int]:
    """For intervals [start, end] in order of start: the first column that is free `space` before each."""
    free: list[tuple[int, int]] = []  # end, column
    idle: list[int] = []
    out, n = [], 0
    for start, end in intervals:
        while free and free[0][0] + space <= start:
            heapq.heappush(idle, heapq.heappop(free)[1])
        if not idle:
            heapq.heappush(idle, n)
            n += 1
        c = heapq.heappop(idle)
        out.append(c)
        heapq.heappush(free, (end, c))
    return out


def pack_columns(seeds: DataFrame, space: int = 10) -> DataFrame:
    """(read_id, contig_id, lo, hi, column): a read's seeds side by side, so that those of one column do not overlap."""
    rows = span(seeds).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("contig_id", "lo", "hi"))).alias("s"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for read, found in zip(part["read_id"], part["s"], strict=True):
                by: dict[int, list[tuple[int, int]]] = {}
                for s in found:
                    by.setdefault(s["contig_id"], []).append((s["lo"], s["hi"]))
                for contig, spans in by.items():
                    out += [(read, contig, lo, hi, c) for (lo, hi), c in zip(spans, columns_of(spans, space), strict=True)]
            yield pd.DataFrame(out, columns=["read_id", "contig_id", "lo", "hi", "column"])

    return rows.mapInPandas(run, "read_id long, contig_id long, lo long, hi long, column int")
