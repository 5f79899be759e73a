"""Open reading frames: both strands, three frames, start codon to the next stop codon in frame.

A sequence's codons are found inside its Arrow batch (``codes``), so frames and spans need no exchange of symbols.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import codes
from .codes import STOPS

__all__ = ["STOPS", "complete", "densest_window", "metrics", "open_span"]


def complete(df: DataFrame, keep: list[str], least: int = 60, seq: str = "seq") -> DataFrame:
    """(keep, strand, frame, start, end, length): every start with its next stop in frame, nested ones included."""

    def work(c: np.ndarray, _: dict) -> list[np.ndarray]:
        strand, frame, start, end = codes.frames(c, least)
        return [strand, frame, start, end, end - start]

    return codes.each(df, keep, seq, work, "strand int, frame int, start long, `end` long, length long")


def metrics(df: DataFrame, key: str = "doc_id", least: int = 60, seq: str = "seq") -> DataFrame:
    """(key, n_orfs, longest_orf_bp, coding_bp, coding_frac), sequences without a frame included."""

    def work(c: np.ndarray, _: dict) -> list[np.ndarray]:
        start, end = codes.frames(c, least)[2:]
        size = end - start
        found = [len(size), int(size.max(initial=0)), int(size.sum())]
        return [*[np.array([x], np.int64) for x in found], np.array([found[2] / len(c) if len(c) else 0.0])]

    return codes.each(df, [key], seq, work, "n_orfs long, longest_orf_bp long, coding_bp long, coding_frac double")


def open_span(df: DataFrame, keep: list[str], seq: str = "seq") -> DataFrame:
    """(keep, span): the longest distance from a stop to a later codon in frame without a stop between.

    The walk starts one codon before its frame; rows with equal ``keep`` are one result.
    """
    rows = codes.each(df, keep, seq, lambda c, _: [np.array([codes.open_span(c)], np.int64)], "span long")
    return rows.groupBy(*keep).agg(F.max("span").alias("span"))


def densest_window(df: DataFrame, group: str, key: str, window: int = 2048, stride: int = 256, top: int = 3, seq: str = "seq") -> DataFrame:
    """(group, span, contig, start): the window with the longest open span among a group's longest sequences.

    Ties go to the earlier contig, then the earlier start; contigs are ordered by length, then key.  Stops are found once a
    contig, so time doesn't follow the windows' overlap.
    """
    order = Window.partitionBy(group).orderBy(F.desc("len"), key)
    long = df.select(group, key, F.col(seq).alias("seq"), F.char_length(seq).alias("len")).withColumn("contig", F.row_number().over(order) - 1)
    long = long.where((F.col("contig") < top) & (F.col("len") >= window))

    def work(c: np.ndarray, _: dict) -> list[np.ndarray]:
        start = np.arange(0, len(c) - window + 1, stride)
        span = codes.spans(c, start, window)
        best = int(span.argmax())
        return [span[best : best + 1], start[best : best + 1].astype(np.int32)]

    spans = codes.each(long, [group, "contig"], "seq", work, "span long, start int")
    best = spans.groupBy(group).agg(F.max(F.struct("span", -F.col("contig"), -F.col("start"))).alias("b"))
    return best.select(group, F.col("b.span").alias("span"), (-F.col("b.col2")).alias("contig"), (-F.col("b.col3")).cast("int").alias("start"))
