"""Merging of overlapping and bookended loci, tiled so that a chromosome is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE = 22


def merge(df: DataFrame, tile: int = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """Islands (chrom, start, end, strand, ord): the end is the largest end, strand and ord the first member's.

    A row opens an island when it starts after all ends before it. That running maximum
    is taken within tiles of 2^tile bases; each tile also gets the maximum of all tiles
    before it, so only one row a tile is ordered per chromosome. Rows that differ in
    the columns `by`, which lead the result, are merged apart.
    """
    keys = [*by, "chrom"]
    rows = df.select(*keys, "start", "end", "strand", "ord", F.shiftright("start", tile).alias("tile"))
    inside = Window.partitionBy(*keys, "tile").orderBy("start", "ord", "end", "strand")
    before = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "tile").agg(F.max("end").alias("m")).select(*keys, "tile", F.max("m").over(before).alias("carried"))
    prev = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    opened = rows.join(carried, [*keys, "tile"]).withColumn("opens", F.when(prev.isNull() | (F.col("start") > prev), 1).otherwise(0))
    # an island is known by its tile and number there; a tile's rows before its first opening belong to the
    # last opening before the tile
    counted = opened.withColumn("k", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = counted.groupBy(*keys, "tile", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "ord", "end", "strand")).alias("head"), F.max("opens").alias("opens"))
    order = Window.partitionBy(*keys).orderBy("tile", "k").rowsBetween(Window.unboundedPreceding, 0)
    whole = parts.where("k > 0").select(*keys, "tile", "k", "start", "end", "head")
    rest = parts.where("k = 0")
    # only tiles that continue an island, one row each, look for it
    marks = rest.select(*keys, "tile", "k", "end", F.lit(None).cast("struct<tile:bigint,k:bigint>").alias("at"))
    opens = whole.groupBy(*keys, "tile").agg(F.max("k").alias("n")).select(*keys, "tile", F.col("n").alias("k"), F.lit(None).cast("long").alias("end"), F.struct(F.col("tile").alias("tile"), F.col("n").alias("k")).alias("at"))
    found = marks.unionByName(opens).withColumn("at", F.max("at").over(order)).where("end is not null").groupBy(*keys, "at").agg(F.max("end").alias("more"))
    found = found.select(*keys, F.col("at.tile").alias("tile"), F.col("at.k").alias("k"), "more")
    out = whole.join(found, [*keys, "tile", "k"], "left")
    return out.select(*keys, "start", F.greatest("end", "more").alias("end"), F.col("head.strand").alias("strand"), F.col("head.ord").alias("ord"))
