"""Contact graphs of loci: an undirected multigraph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import center, uid
from spanloom.operators import powerlaw
from spanloom.operators.loci import Loci
from spanloom.operators.nearest import nearest
from spanloom.operators.overlap import overlap_pairs
from spanloom.operators.rounds import Rounds
from spanloom.sources import text

KEY = ["loop_id", "ord1", "ord2"]
EMPTY = "loop_id long, ord1 long, ord2 long, uid1 string, uid2 string, w double, n double, d double"


def midpoints(loops: DataFrame, dmax: float) -> DataFrame:
    """Loops with integer anchors (mid1, mid2) no further apart than dmax, whatever their chromosomes."""
    ok = loops.where("start1 is not null").select("loop_id", "chrom1", "chrom2", F.shiftright(F.col("start1") + F.col("end1"), 1).alias("mid1"), F.shiftright(F.col("start2") + F.col("end2"), 1).alias("mid2"))
    return ok.where(F.abs(F.col("mid1") - F.col("mid2")) <= dmax)


def anchored(loops: DataFrame, loci: DataFrame, side: int, r: int) -> DataFrame:
    """(loop_id, ord, uid) of the loci that the anchor's midpoint, padded by r, overlaps."""
    mid = F.col(f"mid{side}")
    windows = loops.select("loop_id", F.col(f"chrom{side}").alias("chrom"), (mid - r).alias("start"), (mid + r).alias("end"))
    met = overlap_pairs(windows, loci.select("chrom", "start", "end", "strand", "ord"))
    return met.select(F.col("a_loop_id").alias("loop_id"), F.col("b_ord").alias(f"ord{side}"), uid("b_").alias(f"uid{side}"))


class Architecture:
    """edges: loop_id, ord1, ord2 (the edge's identity and order), uid1, uid2, and properties w, n, d and any other."""

    def __init__(self, edges: DataFrame, name: str = "Architecture", loops: DataFrame | None = None, mapped: DataFrame | None = None):
        self.edges, self.name, self.loops, self.mapped = edges, name, loops, mapped
        self._written: DataFrame | None = None

    def _table(self) -> DataFrame:
        """The edges, written once: what follows reads them several times, and the joins that make them are the dear part."""
        if self._written is None:
            self._written = Rounds(self.edges.sparkSession).table(self.edges)
        return self._written

    @classmethod
    def empty(cls, spark: SparkSession, name: str = "Architecture") -> "Architecture":
        return cls(spark.createDataFrame([], EMPTY), name)

    @classmethod
    def make(cls, spark: SparkSession, loci: Loci, bedpe: str, *, name: str = "Skeleton", r: int = 2500, dmax: float = 1e9) -> "Architecture":
        return cls.of(loci, text.read_bedpe(spark, bedpe), name=name, r=r, dmax=dmax)

    @classmethod
    def of(cls, loci: Loci, loops: DataFrame, *, name: str = "Skeleton", r: int = 2500, dmax: float = 1e9) -> "Architecture":
        """One edge for each loop and pair of different loci at its two anchors; parallel edges stay."""
        near = midpoints(loops, dmax)
        pairs = anchored(near, loci.df, 1, r).join(anchored(near, loci.df, 2, r), "loop_id")
        nil = F.lit(None).cast("double")
        edges = pairs.where("uid1 <> uid2").select(*KEY, "uid1", "uid2", F.lit(0.0).alias("w"), nil.alias("n"), nil.alias("d"))
        return cls(edges, name, loops, pairs.select("loop_id").distinct())

    def __repr__(self) -> str:
        return f"Architecture(name={self.name}, properties={[c for c in self.edges.columns if c not in (*KEY, 'uid1', 'uid2')]})"

    def report(self) -> DataFrame:
        """One row: total lines, mapped loops (both anchors on loci), percentage, loci and links."""
        n = F.count("*")
        counts = {"total": self.loops.agg(n), "mapped": self.mapped.agg(n), "loci": self.vertices().agg(n), "links": self.edges.agg(n)}
        out = self.edges.sparkSession.range(1).select(*[df.scalar().alias(k) for k, df in counts.items()])
        share = F.when(F.col("total") > 0, F.col("mapped") * 100 / F.col("total")).otherwise(0.0)
        return out.select("total", "mapped", share.alias("pct"), "loci", "links")

    def vertices(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("uid1", "uid2")).alias("uid")).distinct()

    def n_loci(self) -> int:
        return self.vertices().count()

    def n_links(self) -> int:
        return self.edges.count()

    def contains(self, key: str) -> bool:
        return not self.edges.where((F.col("uid1") == key) | (F.col("uid2") == key)).isEmpty()

    def _require(self, *keys: str) -> None:
        for key in keys:
            if not isinstance(key, str):
                raise TypeError("a vertex is named by its uid")
            if not self.contains(key):
                raise KeyError(key)

    def neighbors(self, key: str, prop: str = "w") -> DataFrame:
        """(uid, prop) of the neighbours; of parallel edges the first one's."""
        self._require(key)
        return self.adjacency(prop).where(F.col("uid") == key).select(F.col("neighbor").alias("uid"), prop)

    def adjacency(self, prop: str = "w") -> DataFrame:
        """(uid, neighbor, prop) in both directions."""
        forth = self.edges.select(F.col("uid1").alias("uid"), F.col("uid2").alias("neighbor"), *KEY, prop)
        back = self.edges.select(F.col("uid2").alias("uid"), F.col("uid1").alias("neighbor"), *KEY, prop)
        return forth.unionByName(back).groupBy("uid", "neighbor").agg(F.min_by(prop, F.struct(*KEY)).alias(prop))

    def edge(self, u: str, v: str) -> dict | None:
        """All properties of the first edge between two vertices; None if there is none."""
        self._require(u, v)
        row = self.lookup(self.edges.sparkSession.createDataFrame([(u, v)], "u string, v string")).first()
        return None if row is None else {k: x for k, x in row.asDict().items() if k not in ("u", "v")}

    def lookup(self, pairs: DataFrame) -> DataFrame:
        """(u, v, properties) of the first edge, in either direction, of each (u, v) row that has one."""
        props = [c for c in self.edges.columns if c not in (*KEY, "uid1", "uid2")]
        ends = self.edges.select(F.least("uid1", "uid2").alias("lo"), F.greatest("uid1", "uid2").alias("hi"), *KEY, *props)
        first = ends.groupBy("lo", "hi").agg(F.min_by(F.struct(*props), F.struct(*KEY)).alias("p"))
        asked = pairs.withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v"))
        return asked.join(first, ["lo", "hi"]).select("u", "v", "p.*")

    def degree(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("uid1", "uid2")).alias("uid")).groupBy("uid").agg(F.count("*").alias("degree"))

    def copy(self) -> "Architecture":
        return Architecture(self.edges, self.name, self.loops, self.mapped)

    def dedupe(self) -> "Architecture":
        """Of parallel edges (in either direction) the first."""
        own = Window.partitionBy(F.least("uid1", "uid2"), F.greatest("uid1", "uid2")).orderBy(*KEY)
        return Architecture(self.edges.withColumn("k", F.row_number().over(own)).where("k = 1").drop("k"), self.name, self.loops, self.mapped)

    # algorithms: loops of joins, each round of which is a written table
    def within(self, sources: DataFrame, hops: int) -> DataFrame:
        """(source, uid, hops) of the vertices that each `uid` of sources reaches in at most `hops` edges, by fewest edges."""
        rounds = Rounds(self.edges.sparkSession)
        ways = rounds.table(self.adjacency().select("uid", "neighbor"))
        front = rounds.table(self.vertices().join(sources.select("uid").distinct(), "uid").select(F.col("uid").alias("source"), "uid", F.lit(0).alias("hops")))
        near = front
        for k in range(1, hops + 1):
            step = front.join(ways, "uid").select("source", F.col("neighbor").alias("uid")).distinct()
            front = rounds.table(step.join(near.select("source", "uid"), ["source", "uid"], "left_anti").withColumn("hops", F.lit(k)))
            if front.isEmpty():
                break
            near = near.unionByName(front)
        return near

    def components(self) -> DataFrame:
        """(uid, component): the smallest uid of the vertex's connected component.

        Each round takes the least label of the neighbours, then that label's own label, so the rounds
        grow with the logarithm of a component's width.
        """
        rounds = Rounds(self.edges.sparkSession)
        ways = rounds.table(self.adjacency().select("uid", "neighbor"))
        labels = rounds.table(self.vertices().select("uid", F.col("uid").alias("component")))
        while True:
            around = ways.join(labels.select(F.col("uid").alias("neighbor"), "component"), "neighbor").groupBy("uid").agg(F.min("component").alias("near"))
            hooked = labels.join(around, "uid").select("uid", F.col("component").alias("old"), F.least("component", "near").alias("hook"))
            jump = labels.select(F.col("uid").alias("hook"), F.col("component").alias("further"))
            new = rounds.table(hooked.join(jump, "hook").select("uid", "old", F.least("hook", "further").alias("component")))
            labels = new.select("uid", "component")
            if new.where("old <> component").isEmpty():
                rounds.drop(kept=1)
                return labels

    # weights
    def add_matrix(self, loci: Loci, bins: DataFrame, pixels: DataFrame, *, name: str = "w") -> "Architecture":
        """Weights from a contact matrix: an edge's bin pair's count, shared equally by the edges of that pair.

        bins: bin_id, chrom, start, end. pixels: bin1_id, bin2_id, count. A locus takes its nearest bin
        (the lowest of equally near ones); a pair without a pixel, or a count of 0 or less, weighs 0.
        """
        place = nearest(loci.df, bins.select("chrom", "start", "end", F.lit(".").alias("strand"), F.col("bin_id").alias("ord")))
        of = place.groupBy(uid().alias("uid")).agg(F.max_by("b_ord", "ord").alias("bin"))
        edges = self._table().join(of.select(F.col("uid").alias("uid1"), F.col("bin").alias("b1")), "uid1", "left").join(of.select(F.col("uid").alias("uid2"), F.col("bin").alias("b2")), "uid2", "left")
        edges = edges.withColumn("lo", F.least("b1", "b2")).withColumn("hi", F.greatest("b1", "b2"))
        shares = edges.groupBy("lo", "hi").agg(F.count("*").alias("sharing"))
        cells = pixels.groupBy(F.least("bin1_id", "bin2_id").alias("lo"), F.greatest("bin1_id", "bin2_id").alias("hi")).agg(F.max("count").alias("cell"))
        weight = F.when((F.col("cell") > 0) & F.col("b1").isNotNull() & F.col("b2").isNotNull(), F.col("cell") / F.col("sharing")).otherwise(0.0)
        cells = shares.join(cells, ["lo", "hi"])
        out = edges.join(cells, ["lo", "hi"], "left").withColumn(name, weight)
        columns = [c for c in self.edges.columns if c != name] + [name]
        return Architecture(out.select(*columns), self.name, self.loops, self.mapped)

    def with_distance(self, loci: Loci) -> "Architecture":
        """d: distance of the two centers, null across chromosomes. KeyError on a uid that loci lack."""
        at = loci.df.groupBy(uid().alias("uid")).agg(F.max_by(F.struct("chrom", center().alias("c")), "ord").alias("p"))
        one = at.select(F.col("uid").alias("uid1"), F.col("p").alias("p1"))
        two = at.select(F.col("uid").alias("uid2"), F.col("p").alias("p2"))
        edges = self._table()
        missing = edges.select(F.explode(F.array("uid1", "uid2")).alias("uid")).join(at, "uid", "left_anti").first()
        if missing:
            raise KeyError(missing[0])
        d = F.when(F.col("p1.chrom") == F.col("p2.chrom"), F.abs(F.col("p1.c") - F.col("p2.c")).cast("double"))
        out = edges.drop("d").join(one, "uid1").join(two, "uid2").withColumn("d", d).drop("p1", "p2")
        return Architecture(out, self.name, self.loops, self.mapped)

    def normalize(self, loci: Loci, *, source: str = "w", name: str = "n") -> "Architecture":
        """d, and source over its power-law expectation at d as `name`."""
        if source not in self.edges.columns:
            raise ValueError(f"no property {source}")
        out = self.with_distance(loci)._table()
        model = powerlaw.fit(out.select("d", F.col(source).alias("w")))
        kept = out.drop(name) if name != source else out
        return Architecture(kept.withColumn(name, powerlaw.observed_over_expected(F.col("d"), F.col(source), model)), self.name, self.loops, self.mapped)
