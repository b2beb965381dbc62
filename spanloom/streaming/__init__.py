"""Streaming forms: a stream of loci against static ones, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import slop
from spanloom.operators.overlap import LEVELS, met, overlap_pairs, sides


def slop_stream(loci: DataFrame, n: int) -> DataFrame:
    start, end = slop(n)
    return loci.withColumns({"start": start, "end": end})


def intersect_stream(loci: DataFrame, other: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Stream rows that overlap a static row: stateless stream-static semi joins on the interval bins.

    Without state a row can't be told from its copies in other bins, so a row that overlaps several
    static rows may come once for each bin in which it does; a batch sink drops those by ord.
    """
    one, two = (x.join(y, met(), "left_semi").select(*[F.col(f"a_{c}").alias(c) for c in loci.columns]) for x, y in sides(loci, other.select("chrom", "start", "end").distinct(), levels))
    return one.unionByName(two)


def pairs_stream(loci: DataFrame, other: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Overlapping pairs of a stream with static loci, each once."""
    return overlap_pairs(loci, other, levels)


def counts_stream(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and key; state of windows older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
