"""Binned signal of loci over tracks.

A locus becomes bins, the bins meet the track's intervals in the interval join, and a
bin's statistic is an aggregate weighted by covered bases. Results are dense: every
(locus, track, bin) has a row, 0 where there is no data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import center, uid
from spanloom.operators.loci import Loci
from spanloom.operators.order import numbered, part_of_range
from spanloom.operators.overlap import overlap_pairs

#: The bin statistics.
STATISTICS = ("mean", "max", "min", "sum", "coverage", "std")


def listed(value, n: int, name: str) -> list:
    """A scalar for each of n, or a list of n."""
    if isinstance(value, (list, tuple)):
        if len(value) != n:
            raise ValueError(f"{name} has {len(value)} values, not {n}")
        return list(value)
    return [value] * n


def bins(loci: DataFrame, sizes: DataFrame, n_bins: int = 200, flank: int = 3000, span: bool = False, edge_mode: str = "compat") -> DataFrame:
    """(ord, uid, chrom, bin, start, end) of the bins with bases; other bins of a locus have no row.

    span: the locus cut to its chromosome, in n_bins bins. Else its center with flank bases on
    both sides, where bases beyond the chromosome take away bins: one each in `compat` mode
    (none are left if there are fewer), in proportion in `proportional` mode.
    """
    if edge_mode not in ("compat", "proportional"):
        raise ValueError(f"unknown edge mode {edge_mode}")
    n = max(1, n_bins)
    rows = loci.withColumn("uid", uid()).join(sizes.select("chrom", F.col("length").alias("chromlen")), "chrom")
    if span:
        first, last = F.greatest(F.lit(0).cast("long"), F.col("start")), F.least("chromlen", "end")
        rows = rows.select("ord", "uid", "chrom", first.alias("lo"), last.alias("hi"), F.lit(0).cast("long").alias("pre"), F.lit(n).cast("long").alias("core"))
    else:
        left, right = center() - flank, center() + flank
        rows = rows.withColumn("lo", F.greatest(F.lit(0).cast("long"), left)).withColumn("hi", F.least("chromlen", right))
        before, after = F.greatest(F.lit(0).cast("long"), -left), F.greatest(F.lit(0).cast("long"), right - F.col("chromlen"))
        if edge_mode == "proportional":
            before, after = (F.floor(x * n / max(1, 2 * flank)) for x in (before, after))
        rows = rows.select("ord", "uid", "chrom", "lo", "hi", before.cast("long").alias("pre"), (F.lit(n) - before - after).cast("long").alias("core"))
    rows = rows.where("core > 0 and hi > lo").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("core") - 1)))
    exact = lambda k: F.expr(f"lo + ((hi - lo) * ({k})) div core")
    out = rows.select("ord", "uid", "chrom", (F.col("pre") + F.col("k")).cast("int").alias("bin"), exact("k").alias("start"), exact("k + 1").alias("end"))
    # a bin narrower than a base reads the base at its start
    return out.withColumn("end", F.greatest("end", F.col("start") + 1))


def statistic(agg: str) -> Column:
    """Over the intervals' values `v` with `o` covered bases; std and mean weigh by bases."""
    v, o, n = F.col("v"), F.col("o"), F.sum("o")
    mean = F.sum(v * o) / n
    spread = F.sum(v * v * o) - n * mean * mean
    found = {"mean": mean, "max": F.max("v"), "min": F.min("v"), "sum": F.sum(v * o), "coverage": n / F.first("width"), "std": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), spread) / (n - 1))).otherwise(0.0)}
    if agg not in found:
        raise ValueError(f"unknown statistic {agg}; there are {', '.join(STATISTICS)}")
    return found[agg]


def signal(loci: Loci, tracks: DataFrame, sizes: DataFrame, *, n_bins: int = 200, flank: int = 3000, agg: str = "mean", span: bool = False, edge_mode: str = "compat") -> DataFrame:
    """(ord, uid, track, bin, value float). tracks: track, chrom, start, end, value. sizes: chrom, length."""
    if loci.df.isEmpty():
        raise ValueError("there are no loci")
    return binned_signal(loci, tracks, sizes, n_bins=n_bins, flank=flank, agg=agg, span=span, edge_mode=edge_mode)


def binned_signal(loci: Loci, tracks: DataFrame, sizes: DataFrame, *, n_bins: int = 200, flank: int = 3000, agg: str = "mean", span: bool = False, edge_mode: str = "compat") -> DataFrame:
    """As signal(), without the look at whether there are loci."""
    own = bins(loci.df, sizes, n_bins, flank, span, edge_mode)
    data = tracks.where("value is not null and not isnan(value)").select("track", "chrom", "start", "end", F.col("value").cast("double").alias("value"))
    met = overlap_pairs(own.select("ord", "chrom", "bin", "start", "end"), data)
    covered = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    met = met.select(F.col("a_ord").alias("ord"), F.col("a_bin").alias("bin"), F.col("b_track").alias("track"), F.col("b_value").alias("v"), covered.alias("o"), (F.col("a_end") - F.col("a_start")).alias("width"))
    value = met.groupBy("ord", "track", "bin").agg(statistic(agg).alias("value"))
    names = tracks.agg(F.array_sort(F.collect_set("track")))
    each = loci.df.select("ord", uid().alias("uid"), F.explode(F.sequence(F.lit(0), F.lit(max(1, n_bins) - 1))).alias("bin"))
    dense = each.select("ord", "uid", "bin", F.explode(names.scalar()).alias("track"))
    out = dense.join(value, ["ord", "track", "bin"], "left")
    return out.select("ord", "uid", "track", "bin", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).cast("float").alias("value"))


def cube(values: DataFrame) -> np.ndarray:
    """The dense (loci, tracks, bins) array on the driver, loci by ord, tracks by name."""
    rows = values.groupBy("ord", "track").agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("v")).orderBy("ord", "track").select("ord", "track", F.transform("v", lambda x: x["value"]).alias("v")).toPandas()
    if rows.empty:
        return np.zeros((0, 0, 0), np.float32)
    n = rows["ord"].nunique()
    return np.array(rows["v"].tolist(), np.float32).reshape(n, len(rows) // n, -1)


def profile_frame(values: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, track, bin, mean): what a profile plot draws. sets: ord, set."""
    return values.join(sets, "ord").groupBy("set", "track", "bin").agg(F.avg("value").alias("mean"))


def profile_limit(profile: DataFrame, q: float = 0.99) -> DataFrame:
    """One row with the exact, interpolated percentile of the profile's means."""
    return profile.agg(F.percentile("mean", F.lit(q)).alias("limit"))


def heatmap_order(values: DataFrame, no_sort: bool = False) -> DataFrame:
    """(ord, mean, place) of the heatmap's rows: by falling mean over tracks and bins, later rows first on ties;
    places are 0, 1, 2 ... (numbered within equal parts of the means' range)."""
    means = values.groupBy("ord").agg(F.avg("value").alias("mean"))
    keys = [F.col("ord").asc()] if no_sort else [F.col("mean").desc(), F.col("ord").desc()]
    value = F.col("ord") if no_sort else -F.col("mean")
    low, high = means.agg(F.min(value), F.max(value)).first()
    if low is None:
        return means.withColumn("place", F.lit(0).cast("long"))
    return numbered(means, {"__part": part_of_range(value, low, high)}, keys, "place")


def heatmap_frame(values: DataFrame, sets: DataFrame, no_sort: bool = False, limit=None) -> DataFrame:
    """(set, track, ord, place, bin, value): what a heatmap draws. limit: the colour scale's end, at which values
    are cut off: one for all tracks, or a list with one for each track by name."""
    out = values.join(sets, "ord").join(heatmap_order(values, no_sort).select("ord", "place"), "ord").select("set", "track", "ord", "place", "bin", "value")
    if limit is None:
        return out
    tracks = [r[0] for r in values.select("track").distinct().orderBy("track").collect()]  # as many as there are files
    ends = F.create_map(*[F.lit(x) for pair in zip(tracks, map(float, listed(limit, len(tracks), "limit"))) for x in pair])
    return out.withColumn("value", F.least("value", F.element_at(ends, F.col("track"))))


def set_labels(sets: DataFrame) -> DataFrame:
    return sets.select("set").distinct().orderBy("set")
