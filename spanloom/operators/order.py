"""Positions without a global sort: rows are numbered within buckets, buckets by their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 4096
#: Positions that lie close together, as the numbers of a text's lines do, are numbered in blocks of 2^BLOCK.
BLOCK, MOST_BLOCKS = 18, 65_536


def numbered(df: DataFrame, buckets: dict[str, Column], order: list[Column], name: str) -> DataFrame:
    """df with `name`: the row's place, from 0, in order of the buckets and, within one, of `order`.

    buckets: ascending columns that are few by nature (tiles of a genome, parts of a range): their
    sizes, one row a bucket, are summed in one task, while the rows are dealt out by bucket.
    """
    rows = df.withColumns(buckets)
    keys = list(buckets)
    before = F.sum("__n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy(*keys).agg(F.count("*").alias("__n")).select(*[F.col(k).alias(f"{k}_of") for k in keys], F.coalesce(before, F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    met = same[0]
    for x in same[1:]:
        met = met & x
    placed = rows.withColumn("__inside", inside).join(first, met)
    return placed.select(*[c for c in df.columns if c != name], (F.col("__first") + F.col("__inside")).cast("long").alias(name))


def part_of_range(value: Column, low, high, parts: int = BUCKETS) -> Column:
    """Equal parts of [low, high], ascending with the value."""
    width = (high - low) / parts or 1
    return F.floor((value - F.lit(low)) / F.lit(width)).cast("long")


def placed(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with `name`: the row's place, from 0, in order of the long column `by`; as it is where `by` has these places.

    Looks at the least and the largest of `by`, their number and the number of blocks that they fill.
    """
    low, high, n, blocks = df.agg(F.min(by), F.max(by), F.count("*"), F.approx_count_distinct(F.shiftright(by, BLOCK))).first()
    others = [c for c in df.columns if c != name]
    if not n or high - low == n - 1:
        return df.select(*others, (F.col(by) - F.lit(low or 0)).alias(name))
    part = F.shiftright(by, BLOCK) if blocks <= MOST_BLOCKS else part_of_range(F.col(by), low, high)
    return numbered(df, {"__part": part}, [F.col(by)], name)
