"""Nearest interval join: overlaps, and the neighbours before and after in one sweep.

Distance is 0 for an overlap, else the gap plus one (1 for bookended loci). Ties go to
the smallest (distance, start, end, ord) of the other side. Queries on chromosomes that
the other side lacks disappear. Ends of both sides are one table of events, dealt out and
sorted once by tile: in that order the last end before a query and the first start after
it are its neighbours, and one carried row a tile has those of other tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.overlap import LEVELS, overlap_pairs

TILE = 16


_BEFORE, _AFTER = "struct<e:bigint,s:bigint,ord:bigint,strand:string>", "struct<s:bigint,e:bigint,ord:bigint,strand:string>"


def _events(coords: DataFrame, other: DataFrame, tile: int) -> DataFrame:
    """(tile, chrom, at, kind, far, before, after): each interval's two ends, `far` a query's end that isn't `at`.

    Kind 0 is an end of the other side, 1 a query's start, 2 its end, 3 a start of the other side: sorted by (at, kind,
    before, after), the nearest comes last before a query's start and first after its end. before.s is inverted for that.
    """

    def event(at: str, kind: int, far: Column, before: Column | None = None, after: Column | None = None) -> Column:
        none = F.lit(None)
        held = [(none if x is None else x).cast(t).alias(name) for x, t, name in ((before, _BEFORE, "before"), (after, _AFTER, "after"))]
        return F.struct(F.shiftright(at, tile).alias("tile"), F.col(at).alias("at"), F.lit(kind).alias("kind"), far.cast("bigint").alias("far"), *held)

    first = F.struct(F.col("end").alias("e"), F.bitwise_not("start").alias("s"), "ord", "strand")
    last = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), "ord", "strand")
    there = other.select("chrom", F.explode(F.array(event("end", 0, F.lit(None), before=first), event("start", 3, F.lit(None), after=last))).alias("x"))
    asked = coords.select("chrom", F.explode(F.array(event("start", 1, F.col("end")), event("end", 2, F.col("start")))).alias("x"))
    return there.unionByName(asked).select("x.tile", "chrom", "x.at", "x.kind", "x.far", "x.before", "x.after")


def _beside(coords: DataFrame, other: DataFrame, tile: int) -> DataFrame:
    """(chrom, start, end, c): the nearest of the other side before each query, and after it."""
    rows = _events(coords, other, tile)
    tiles = Window.partitionBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    # only rows at a tile's outermost bases are compared as structs, since those are sorted; each tile has one at `least`
    edges = rows.groupBy("tile", "chrom").agg(F.max("before.e").alias("e"), F.min("after.s").alias("s"), F.min("at").alias("least"))
    held = rows.join(F.broadcast(edges), ["tile", "chrom"]).where("before.e = e or after.s = s or at = least")
    carried = held.groupBy("tile", "chrom").agg(F.max("before").alias("b"), F.min("after").alias("a"))
    carried = carried.select("tile", "chrom", F.max("b").over(tiles.orderBy("tile")).alias("from_before"), F.min("a").over(tiles.orderBy(F.desc("tile"))).alias("from_after"))
    swept = "ignore nulls over (partition by tile, chrom order by at, kind, before, after)"
    best = rows.select("tile", "chrom", "at", "kind", "far", F.expr(f"lag(before) {swept}").alias("b"), F.expr(f"lead(after) {swept}").alias("a"))
    best = best.where("kind in (1, 2)").join(carried, ["tile", "chrom"])
    # what the tile itself has is nearer than what others have
    b, a = F.coalesce("b", "from_before"), F.coalesce("a", "from_after")
    left = F.struct((F.col("at") - F.col("b.e") + 1).alias("distance"), F.bitwise_not("b.s").alias("start"), F.col("b.e").alias("end"), F.col("b.ord").alias("ord"), F.col("b.strand").alias("strand"))
    right = F.struct((F.col("a.s") - F.col("at") + 1).alias("distance"), F.col("a.s").alias("start"), F.col("a.e").alias("end"), F.col("a.ord").alias("ord"), F.col("a.strand").alias("strand"))
    asks = F.col("kind") == 1
    best = best.select("chrom", "at", "far", "kind", F.when(asks, b).alias("b"), F.when(~asks, a).alias("a")).where("a is not null or b is not null")
    start, end = F.when(asks, F.col("at")).otherwise(F.col("far")), F.when(asks, F.col("far")).otherwise(F.col("at"))
    return best.select("chrom", start.alias("start"), end.alias("end"), F.when(asks, left).otherwise(right).alias("c"))


def nearest(a: DataFrame, b: DataFrame, levels: tuple[int, ...] = LEVELS, tile: int = TILE) -> DataFrame:
    """One row a query: chrom, start, end, strand, ord, then b_start, b_end, b_strand, b_ord, distance."""
    valid = "chrom is not null and start is not null and end is not null"
    coords = a.where(valid).select("chrom", "start", "end").distinct()
    other = b.where(valid).groupBy("chrom", "start", "end").agg(F.min(F.struct("ord", "strand")).alias("o")).select("chrom", "start", "end", "o.ord", "o.strand")
    hit = F.struct(F.lit(0).cast("long").alias("distance"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("b_ord").alias("ord"), F.col("b_strand").alias("strand"))
    found = overlap_pairs(coords, other, levels).select(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), hit.alias("c"))
    best = found.unionByName(_beside(coords, other, tile)).groupBy("chrom", "start", "end").agg(F.min("c").alias("c"))
    best = best.select("chrom", "start", "end", F.col("c.start").alias("b_start"), F.col("c.end").alias("b_end"), F.col("c.strand").alias("b_strand"), F.col("c.ord").alias("b_ord"), F.col("c.distance").alias("distance"))
    return a.join(best, ["chrom", "start", "end"]).select(*a.columns, "b_start", "b_end", "b_strand", "b_ord", "distance")
