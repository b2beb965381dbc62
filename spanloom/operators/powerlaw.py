"""Fit of w ~ C * d^-alpha and observed-over-expected, as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable() -> Column:
    """Positive, finite points, of which the fit is made."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    return good("d") & good("w")


def ols(points: DataFrame) -> DataFrame:
    """One row (intercept, slope) of log10 w on log10 d over the usable points."""
    x, y = F.log10("d"), F.log10("w")
    return points.where(usable()).agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def fit(points: DataFrame, grid: int = 41, rounds: int = 7, reach: float = 1.0) -> tuple[float, float] | None:
    """(C, alpha) of least squares in w, or None where it isn't defined (fewer than two distances).

    For a given alpha the best C is linear, so one exponent is searched, from the log-log
    estimate outward. A round is one aggregate that judges a whole grid of exponents over
    per-distance sums; no point reaches the driver.
    """
    points = points.where(usable()).select("d", "w").persist()
    sums = points.groupBy("d").agg(F.count("*").alias("m"), F.sum("w").alias("s")).persist()
    try:
        return _search(points, sums, grid, rounds, reach)
    finally:
        points.unpersist()
        sums.unpersist()


def _search(points: DataFrame, sums: DataFrame, grid: int, rounds: int, reach: float) -> tuple[float, float] | None:
    first = ols(points).first()
    if first is None or first["slope"] is None or math.isnan(first["slope"]):
        return None
    scale = sums.agg((F.sum(F.col("m") * F.log("d")) / F.sum("m")).alias("l"), F.count("*").alias("k")).first()
    if scale["k"] < 2:
        return None
    log_d = F.log("d") - F.lit(scale["l"])
    alpha, step = -first["slope"], 2 * reach / (grid - 1)
    value: dict[float, tuple[float, float]] = {}
    for _ in range(rounds):
        tried = [alpha + step * (i - grid // 2) for i in range(grid)]
        aggs = [x for a in tried for x in (F.sum(F.col("s") * F.exp(-a * log_d)), F.sum(F.col("m") * F.exp(-2 * a * log_d)))]
        row = sums.agg(*aggs).first()
        value = {a: (row[2 * i], row[2 * i + 1]) for i, a in enumerate(tried)}
        gain = [value[a][0] ** 2 / value[a][1] if value[a][1] else -math.inf for a in tried]
        at = grid // 2
        while True:  # the nearest maximum
            near = max((at - 1, at, at + 1), key=lambda i: gain[i] if 0 <= i < grid else -math.inf)
            if near == at:
                break
            at = near
        alpha = tried[at]
        if 0 < at < grid - 1:
            step *= 4 / (grid - 1)
    top, bottom = value[alpha]
    return (top / bottom) * math.exp(alpha * scale["l"]), alpha


def observed_over_expected(d: Column, w: Column, model: tuple[float, float] | None) -> Column:
    """w / max(C * d^-alpha, 1e-12); null without a distance, NaN without a model, 0 at distance 0."""
    if model is None:
        return F.when(d.isNotNull(), F.lit(float("nan")))
    c, alpha = model
    expected = F.lit(c) * F.pow(d.cast("double"), F.lit(-alpha))
    return F.when(d.isNotNull(), w / F.greatest(expected, F.lit(1e-12)))
