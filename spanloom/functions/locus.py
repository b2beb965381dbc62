"""Expressions over the columns chrom, start, end, strand of a locus (half-open coordinates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(name: str, prefix: str) -> Column:
    return F.col(f"{prefix}{name}")


def uid(prefix: str = "") -> Column:
    """chrom:start-end(strand), the identity of a locus."""
    return F.concat(_c("chrom", prefix), F.lit(":"), _c("start", prefix), F.lit("-"), _c("end", prefix), F.lit("("), _c("strand", prefix), F.lit(")"))


def length(prefix: str = "") -> Column:
    return _c("end", prefix) - _c("start", prefix)


def center(prefix: str = "") -> Column:
    """Floor of the midpoint, for negative sums too."""
    return F.shiftright(_c("start", prefix) + _c("end", prefix), 1)


def distance(a: str = "a_", b: str = "b_") -> Column:
    """Distance of the centers on one chromosome; null across chromosomes."""
    return F.when(_c("chrom", a) == _c("chrom", b), F.abs(center(a) - center(b)))


def overlaps(a: str = "a_", b: str = "b_") -> Column:
    """Bookended loci do not overlap; strand plays no part."""
    return (_c("chrom", a) == _c("chrom", b)) & (_c("start", a) < _c("end", b)) & (_c("start", b) < _c("end", a))


def _place(prefix: str) -> Column:
    return F.struct(_c("chrom", prefix).alias("chrom"), _c("start", prefix).alias("start"))


def precedes(a: str = "a_", b: str = "b_") -> Column:
    """Order by chromosome name, then start."""
    return _place(a) < _place(b)


def follows(a: str = "a_", b: str = "b_") -> Column:
    return _place(a) > _place(b)


def slop(n: int) -> tuple[Column, Column]:
    """Padded start and end; the start stops at 0."""
    return F.greatest(F.lit(0).cast("long"), F.col("start") - n), F.col("end") + n


def tss_start() -> Column:
    """The first base of a gene: its start on +, its end on every other strand."""
    return F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))


def tss_end() -> Column:
    """start + 1 on +, end - 1 on every other strand, where the locus is inverted."""
    return F.when(F.col("strand") == "+", F.col("start") + 1).otherwise(F.col("end") - 1)


def sliced(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end], both ends clamped to the sequence."""
    lo = F.greatest(F.lit(0), start)
    return F.substring(seq, (lo + 1).cast("int"), F.greatest(F.lit(0), end - lo).cast("int"))
