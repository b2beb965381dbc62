"""Interval joins without a nested loop.

An interval's own level is the finest whose bins are at least as wide as it is, so it
meets two bins of that level, or of any coarser one, at most. A pair meets on the
coarser of its two levels: either side's intervals on their own level join the other
side's on all levels from their own on (the second time: above their own), of those that
occur on the first side. That is an equi-join on (chrom, level, bin), whatever the mix of
widths; narrow intervals never meet on a coarse level unless one of them is wide. Of the bins that a pair shares, the
one of the larger first base emits it, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (8, 12, 16, 20, 24, 28)
LOCUS = ("chrom", "start", "end", "strand", "ord")
_TOP = 63


def located(df: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """df with its first and last base and own level. An empty or inverted interval spans the bases between its ends."""
    last = F.col("end") - 1
    lo, hi = F.least("start", last), F.greatest("start", last)
    own = F.lit(_TOP)
    for level in reversed(levels):
        own = F.when(hi - lo < (1 << level), F.lit(level)).otherwise(own)
    return df.where("chrom is not null and start is not null and end is not null").withColumns({"__lo": lo, "__hi": hi, "__own": own})


def levels_of(df: DataFrame, levels: tuple[int, ...] = LEVELS) -> Column:
    """The own levels that occur in df, ascending: a subquery, run once and before the join. All levels for a stream."""
    if df.isStreaming:
        return F.array(*[F.lit(x) for x in (*levels, _TOP)])
    return located(df, levels).agg(F.array_sort(F.collect_set("__own"))).scalar()


def binned(df: DataFrame, which: str, prefix: str, levels: tuple[int, ...], there: Column) -> DataFrame:
    """All columns, prefixed, with <prefix>_lo and the keys <prefix>_chrom, _level and _bin.

    there: the other side's own levels. which levels: `own`, `all` of the other side's from its own
    on, or those of them `above` its own; on its own level an interval meets those of `there` up to
    it, so others are left out.
    """
    out = located(df, levels).withColumn("__there", there)
    if which in ("own", "wider"):
        least = F.array_min("__there")
        met = F.col("__own") >= least if which == "own" else F.col("__own") > least
        out = out.where(met).withColumn("__level", F.col("__own"))
    else:
        keep = (lambda x: x >= F.col("__own")) if which == "all" else (lambda x: x > F.col("__own"))
        out = out.withColumn("__level", F.explode(F.filter("__there", keep)))
    out = out.withColumn("__bin", F.explode(F.sequence(_bin("__lo", "__level"), _bin("__hi", "__level"))))
    kept = [F.col(c).alias(f"{prefix}{c}") for c in df.columns]
    return out.select(*kept, F.col("__lo").alias(f"{prefix}_lo"), F.col("chrom").alias(f"{prefix}_chrom"), F.col("__level").alias(f"{prefix}_level"), F.col("__bin").alias(f"{prefix}_bin"))


def _bin(base: str, level: str) -> Column:
    return F.when(F.col(level) == _TOP, F.lit(0).cast("long")).otherwise(F.expr(f"shiftright({base}, {level})"))


def met() -> Column:
    """Equal keys, the overlap, and the pair's one bin, of rows prefixed a_ and b_."""
    keys = (F.col("a__chrom") == F.col("b__chrom")) & (F.col("a__level") == F.col("b__level")) & (F.col("a__bin") == F.col("b__bin"))
    first = F.when(F.col("a__level") == _TOP, F.lit(0).cast("long")).otherwise(F.expr("shiftright(greatest(a__lo, b__lo), a__level)"))
    return keys & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("a__bin") == first)


def sides(a: DataFrame, b: DataFrame, levels: tuple[int, ...] = LEVELS) -> list[tuple[DataFrame, DataFrame]]:
    """The two joins that together have every pair once: the wider one is of `a` (or none is), or of `b`."""
    in_a, in_b = levels_of(a, levels), levels_of(b, levels)
    return [(binned(a, x, "a_", levels, in_b), binned(b, y, "b_", levels, in_a)) for x, y in (("own", "all"), ("above", "wider"))]


def overlap_pairs(a: DataFrame, b: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """All overlapping pairs, once each, with all columns prefixed a_ and b_."""
    columns = [*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns]]
    one, two = (x.join(y, met()).select(*columns) for x, y in sides(a, b, levels))
    return one.unionByName(two)


def hits(a: DataFrame, b: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The distinct coordinates (chrom, start, end) of `a` that overlap a row of `b`.

    Rows of equal coordinates are judged once, and the first hit of a bin ends its search.
    """
    coords = ["chrom", "start", "end"]
    out = [F.col(f"a_{c}").alias(c) for c in coords]
    one, two = (x.join(y, met(), "left_semi").select(*out) for x, y in sides(a.select(*coords).distinct(), b.select(*coords).distinct(), levels))
    return one.unionByName(two).distinct()


def intersect(a: DataFrame, b: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Rows of `a` that overlap a row of `b`; coordinates, order and duplicates as in `a`."""
    return a.join(hits(a, b, levels), ["chrom", "start", "end"], "left_semi").select(*a.columns)


def difference(a: DataFrame, b: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Rows of `a` that overlap no row of `b`."""
    return a.join(hits(a, b, levels), ["chrom", "start", "end"], "left_anti").select(*a.columns)


def region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows that overlap one region: a plain filter, which reaches the scan."""
    return df.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
