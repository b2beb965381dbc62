"""Loci: an ordered collection of loci over a DataFrame (chrom, start, end, strand, ord)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import center, length, slop, uid
from spanloom.operators import merge as _merge
from spanloom.operators import nearest as _nearest
from spanloom.operators import overlap
from spanloom.operators.order import numbered, placed
from spanloom.operators.rounds import Rounds
from spanloom.sources import text

def _tiles() -> dict[str, Column]:
    """The buckets of a sort: tiles of 65,536 bases."""
    return {"__chrom": F.col("chrom"), "__tile": F.shiftright("start", 16)}


SCHEMA = "chrom string, start long, end long, strand string, ord long"


class Loci:
    """Immutable and lazy; `ord` is the position, kept through every operator. Strand is part of identity only."""

    def __init__(self, df: DataFrame, filename: str | None = None):
        if "strand" not in df.columns:
            df = df.withColumn("strand", F.lit("."))
        if "ord" not in df.columns:
            df = df.withColumn("ord", F.monotonically_increasing_id())
        self.df = df.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", F.col("ord").cast("long").alias("ord"))
        self.filename = filename
        self._source: DataFrame | None = None  # of sorted loci: the rows before
        self._tiles: DataFrame | None = None

    @classmethod
    def make(cls, spark: SparkSession, filename: str, filetype: str | None = None) -> "Loci":
        return cls(text.read_loci(spark, filename, filetype), filename)

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[tuple]) -> "Loci":
        """From (chrom, start, end[, strand]) tuples in memory."""
        full = [(*r, ".")[:4] + (i,) for i, r in enumerate(rows)]
        return cls(spark.createDataFrame(full, SCHEMA))

    def __repr__(self) -> str:
        return f"Loci(filename={self.filename})"

    def __eq__(self, other: object) -> bool:
        return self is other

    __hash__ = object.__hash__

    def _with(self, df: DataFrame) -> "Loci":
        return Loci(df, self.filename)

    # columns
    def frame(self, *columns: str) -> DataFrame:
        """The rows with uid, length and center."""
        out = self.df.withColumn("uid", uid()).withColumn("length", length()).withColumn("center", center())
        return out.select(*columns) if columns else out

    def slop(self, n: int) -> "Loci":
        start, end = slop(n)
        return self._with(self.df.select("chrom", start.alias("start"), end.alias("end"), "strand", "ord"))

    def copy(self) -> "Loci":
        return self._with(self.df)

    # order
    def sort(self) -> "Loci":
        """By (chrom, start), ties in their order; positions are renumbered from 0, without gaps.

        Tiles of 65,536 bases are the buckets of the numbering, so nothing is sorted as a whole.
        """
        out = self._with(numbered(self.df, _tiles(), [F.col("start"), F.col("ord")], "ord"))
        out._source = self.df
        return out

    def _places(self, low: int, high: int | None) -> DataFrame:
        """Of sorted loci, the rows at the positions from low to before high: only tiles that hold some are sorted.

        The sizes of the tiles are written once.
        """
        if self._tiles is None:
            before = F.sum("n").over(Window.orderBy("c", "t").rowsBetween(Window.unboundedPreceding, -1))
            sizes = self._source.withColumns(_tiles()).groupBy(F.col("__chrom").alias("c"), F.col("__tile").alias("t")).agg(F.count("*").alias("n"))
            self._tiles = Rounds(self.df.sparkSession).table(sizes.withColumn("first", F.coalesce(before, F.lit(0))))
        held = self._tiles.where(F.col("first") + F.col("n") > low)
        if high is not None:
            held = held.where(F.col("first") < high)
        rows = self._source.withColumns(_tiles()).join(held, F.col("__chrom").eqNullSafe(F.col("c")) & F.col("__tile").eqNullSafe(F.col("t")))
        place = F.col("first") + F.row_number().over(Window.partitionBy("__chrom", "__tile").orderBy("start", "ord")) - 1
        rows = rows.withColumn("ord", place.cast("long")).select(*self.df.columns).where(F.col("ord") >= low)
        return rows if high is None else rows.where(F.col("ord") < high)

    def merge(self) -> "Loci":
        return self._with(_merge.merge(self.df))

    # lookups
    def renumbered(self) -> "Loci":
        """The same order with positions from 0, without gaps. Looks at the least, the largest and the number of positions."""
        if self._source is not None:
            return self
        return self._with(placed(self.df, "ord", "ord"))

    def at(self, index: int) -> DataFrame:
        """The row at a position of the list, from its end if negative; IndexError beyond it."""
        if self._source is not None:
            at = index if index >= 0 else self._source.count() + index
            found = self._places(at, at + 1)
            if at < 0 or found.isEmpty():
                raise IndexError(index)
            return found
        rows = self.renumbered()
        found = rows.df.where(F.col("ord") == (index if index >= 0 else rows.count() + index))
        if found.isEmpty():
            raise IndexError(index)
        return found

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> "Loci":
        """As a list's slice with a positive step; positions are those in the list."""
        if step < 1:
            raise ValueError("the step must be positive")
        rows = self.renumbered()
        if min(start or 0, stop or 0) < 0:
            start, stop, _ = slice(start, stop).indices((rows.df if self._source is None else self._source).count())
        if self._source is not None and stop is not None:  # a part of the list, which is written once
            return self._with(Rounds(self.df.sparkSession).table(self._places(start or 0, stop).where((F.col("ord") - (start or 0)) % step == 0)))
        kept = F.col("ord") >= (start or 0)
        if stop is not None:
            kept = kept & (F.col("ord") < stop)
        return self._with(rows.df.where(kept & ((F.col("ord") - (start or 0)) % step == 0)))

    def __getitem__(self, key: "int | str | slice") -> "DataFrame | Loci":
        """Position, uid (the last row of it) or slice."""
        if isinstance(key, slice):
            return self.slice(key.start, key.stop, key.step or 1)
        return self.at(key) if isinstance(key, int) else self.get(key)

    def __len__(self) -> int:
        return self.count()

    def __bool__(self) -> bool:
        return not self.df.isEmpty()

    def __iter__(self) -> Iterator[Row]:
        """Rows in order, a partition at a time."""
        return iter(self.df.orderBy("ord").toLocalIterator())

    def __contains__(self, key: str) -> bool:
        return self.contains(key)

    def index(self, key: str) -> int:
        """The position of the first row of a uid; ValueError if there is none."""
        first = self.renumbered().df.where(uid() == key).agg(F.min("ord").alias("ord")).first()["ord"]
        if first is None:
            raise ValueError(f"{key} is not there")
        return first

    def uids(self) -> DataFrame:
        """(uid, ord): a repeated uid has its last position."""
        return self.df.groupBy(uid().alias("uid")).agg(F.max("ord").alias("ord"))

    def get(self, key: str) -> DataFrame:
        """The last row of a uid; KeyError if there is none."""
        if not isinstance(key, str):
            raise TypeError("a locus is looked up by its uid")
        found = self.df.where(uid() == key).orderBy(F.desc("ord")).limit(1)
        if found.isEmpty():
            raise KeyError(key)
        return found

    def subloci(self, uids: DataFrame | Iterable[str]) -> "Loci":
        """The loci of the uids in the order asked for, with repeats; KeyError on an unknown one.

        uids: (uid, pos) rows, or strings in memory.
        """
        if not isinstance(uids, DataFrame):
            uids = self.df.sparkSession.createDataFrame([(u, i) for i, u in enumerate(uids)], "uid string, pos long")
        last = self.df.groupBy(uid().alias("uid")).agg(F.max_by(F.struct("chrom", "start", "end", "strand"), "ord").alias("l"))
        missing = uids.join(last, "uid", "left_anti").select("uid").first()
        if missing:
            raise KeyError(missing[0])
        return self._with(uids.join(last, "uid").select("l.*", F.col("pos").alias("ord")))

    def overlaps(self, chrom: str, start: int, end: int) -> "Loci":
        return self._with(overlap.region(self.df, chrom, start, end).orderBy("start", "ord"))

    def filter(self, condition: Column | str) -> "Loci":
        return self._with(self.df.where(condition))

    def contains(self, key: str) -> bool:
        return not self.df.where(uid() == key).isEmpty()

    def count(self, key: str | None = None) -> int:
        """Of all rows, or of a uid's."""
        return (self.df if key is None else self.df.where(uid() == key)).count()

    # list-like operations that return new loci
    def extend(self, other: "Loci") -> "Loci":
        return self + other

    def append(self, chrom: str, start: int, end: int, strand: str = ".") -> "Loci":
        return self + Loci.of(self.df.sparkSession, [(chrom, start, end, strand)])

    def insert(self, index: int, chrom: str, start: int, end: int, strand: str = ".") -> "Loci":
        """Before the position `index`, as a list does; those from there on move by one."""
        rows = self.renumbered()
        n = rows.count()
        at = max(0, n + index) if index < 0 else min(index, n)
        moved = rows.df.withColumn("ord", F.when(F.col("ord") >= at, F.col("ord") + 1).otherwise(F.col("ord")))
        return self._with(moved.unionByName(Loci.of(self.df.sparkSession, [(chrom, start, end, strand)]).df.withColumn("ord", F.lit(at).cast("long"))))

    def pop(self, index: int = -1) -> tuple[Row, "Loci"]:
        """The row at a position, and the loci without it."""
        row = self.at(index).first()
        rows = self.renumbered()
        return row, self._with(rows.df.where(F.col("ord") != row["ord"]))

    def remove(self, key: str) -> "Loci":
        """Without the first row of a uid."""
        first = self.df.where(uid() == key).agg(F.min("ord").alias("ord")).first()["ord"]
        if first is None:
            raise ValueError(f"{key} is not there")
        return self._with(self.df.where(F.col("ord") != first))

    def reverse(self) -> "Loci":
        return self._with(self.df.withColumn("ord", -F.col("ord")))

    # joins and sets
    def intersect(self, other: "Loci") -> "Loci":
        return self._with(overlap.intersect(self.df, other.df))

    def difference(self, other: "Loci") -> "Loci":
        return self._with(overlap.difference(self.df, other.df))

    def pairs(self, other: "Loci") -> DataFrame:
        return overlap.overlap_pairs(self.df, other.df)

    def nearest(self, other: "Loci", s_names: Column | None = None, o_names: Column | None = None) -> DataFrame:
        """Chr, Start, End, Strand, Name, Start_b, End_b, Strand_b, Name_b, Distance; names are uids unless given
        as expressions over chrom, start, end, strand, ord."""
        out = _nearest.nearest(self.df, other.df)
        own = (s_names if s_names is not None else uid()).alias("Name")
        there = other.df.select(F.col("ord").alias("b_ord"), "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), (o_names if o_names is not None else uid()).alias("Name_b"))
        there = there.groupBy("chrom", "b_start", "b_end", "b_ord").agg(F.min("Name_b").alias("Name_b"))
        out = out.withColumn("Name", own).join(there, ["chrom", "b_start", "b_end", "b_ord"])
        return out.select(F.col("chrom").alias("Chr"), F.col("start").alias("Start"), F.col("end").alias("End"), F.col("strand").alias("Strand"), "Name", F.col("b_start").alias("Start_b"), F.col("b_end").alias("End_b"), F.col("b_strand").alias("Strand_b"), "Name_b", F.col("distance").alias("Distance"))

    def concat(self, other: "Loci") -> "Loci":
        """self, then other, whose positions follow the largest of self. Duplicates stay."""
        shift = self.df.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        return self._with(self.df.unionByName(other.df.withColumn("ord", F.col("ord") + F.lit(shift))))

    def xor(self, other: "Loci") -> "Loci":
        return (self - other) + (other - self)

    __and__ = intersect
    __sub__ = __truediv__ = difference
    __add__ = __or__ = concat
    __xor__ = xor

    # tags
    def map(self, mapping: dict, mode: str = "uid"):
        from spanloom.operators.tags import Tags

        return Tags.make(self).add(mapping, mode=mode)

    def tag(self, other, tag: str, mode: str = "uid"):
        return self.map({tag: other}, mode)

    # signal
    def signal(self, tracks: "DataFrame | list[str]", sizes: DataFrame | None = None, *, n_bins: int = 200, flank: int = 3000, agg: str = "mean", span: bool = False, edge_mode: str = "compat") -> DataFrame:
        """(ord, uid, track, bin, value): bigWig paths, whose chromosome sizes are their own, or a frame of
        (track, chrom, start, end, value) with (chrom, length) sizes. ValueError without loci."""
        from spanloom.operators import signal
        from spanloom.sources import bigwig

        if not isinstance(tracks, DataFrame):
            spark = self.df.sparkSession
            tracks, sizes = bigwig.read_bigwig(spark, list(tracks)), bigwig.chrom_sizes(spark, list(tracks)) if sizes is None else sizes
        if sizes is None:
            raise ValueError("a frame of tracks needs the chromosomes' sizes")
        return signal.signal(self, tracks, sizes, n_bins=n_bins, flank=flank, agg=agg, span=span, edge_mode=edge_mode)

    def heatmap_frame(self, values: DataFrame, sets: DataFrame, no_sort: bool = False, limit=None) -> DataFrame:
        """What a heatmap of signal() values draws. sets: (ord, set)."""
        from spanloom.operators import signal

        return signal.heatmap_frame(values, sets, no_sort, limit)

    def profile_frame(self, values: DataFrame, sets: DataFrame) -> DataFrame:
        """What a profile plot of signal() values draws. sets: (ord, set)."""
        from spanloom.operators import signal

        return signal.profile_frame(values, sets)

    # sinks
    def to_bed(self, path: str | None = None) -> DataFrame:
        """BED6 lines in order; written as one text file's folder if a path is given."""
        lines = text.bed_lines(self.df)
        if path is not None:
            text.write_lines(lines, path)
        return lines.orderBy("ord").select("value")

    def to_frame(self, names: Column | None = None) -> DataFrame:
        name = (names if names is not None else uid()).alias("Name")
        return self.df.orderBy("ord").select(F.col("chrom").alias("Chr"), F.col("start").alias("Start"), F.col("end").alias("End"), F.col("strand").alias("Strand"), name)

    def to_ranges(self, names: Column | None = None) -> DataFrame:
        return self.to_frame(names).withColumnRenamed("Chr", "Chromosome")

    def to_pandas(self, names: Column | None = None) -> pd.DataFrame:
        return self.to_frame(names).toPandas()
