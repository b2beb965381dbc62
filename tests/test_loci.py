"""Interval algebra on hand-worked fixtures and against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom import Loci
from spanloom.functions import uid
from spanloom.operators.overlap import overlap_pairs
from spanloom.sources import text

BED = "# cre\nchr1\t100\t200\ta\t0\t+\nchr1\t150\t250\tb\t0\t-\nchr1\t250\t300\tc\t0\t.\nchr1\t400\t500\n\nchr2\t50\t60\td\t0\t+\nchr10\t5\t15\te\t0\t+\n"


@pytest.fixture(scope="module")
def cre(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bed") / "cre.bed"
    path.write_text(BED)
    return Loci.make(spark, str(path))


@pytest.fixture(scope="module")
def other(spark):
    return Loci.of(spark, [("chr1", 299, 350), ("chr2", 60, 70)])


def rows(loci, *columns):
    return [tuple(r) for r in loci.df.orderBy("ord").select(*(columns or ("chrom", "start", "end", "strand"))).collect()]


def test_read(cre):
    got = rows(cre)
    assert len(got) == 6 and got[3] == ("chr1", 400, 500, ".") and got[0] == ("chr1", 100, 200, "+")


def test_file_types(spark):
    with pytest.raises(NotImplementedError):
        Loci.make(spark, "x.gtf")
    with pytest.raises(ValueError):
        Loci.make(spark, "x.bed", "Other")


def test_sort_merge_slop(cre):
    assert [r[:2] for r in rows(cre.sort())] == [("chr1", 100), ("chr1", 150), ("chr1", 250), ("chr1", 400), ("chr10", 5), ("chr2", 50)]
    assert sorted(rows(cre.merge())) == [("chr1", 100, 300, "+"), ("chr1", 400, 500, "."), ("chr10", 5, 15, "+"), ("chr2", 50, 60, "+")]
    slopped = rows(cre.slop(10))
    assert slopped[-1][:3] == ("chr10", 0, 25) and slopped[0][:3] == ("chr1", 90, 210)


def test_sets(cre, other):
    assert [r[1] for r in rows(cre & other)] == [250]
    assert len(rows(cre - other)) == 5 and len(rows(cre / other)) == 5
    assert len(rows(cre ^ other)) == 6
    assert len(rows(cre + other)) == 8 and [r[1] for r in rows(cre | other)][-2:] == [299, 60]


def test_nearest(cre, other):
    got = {r["Start"]: r["Distance"] for r in cre.nearest(other).collect()}
    assert got == {100: 100, 150: 50, 250: 0, 400: 51, 50: 1}


def test_bed_lines(cre, tmp_path):
    assert cre.to_bed().first()[0] == "chr1\t100\t200\tchr1:100-200(+)\t0\t+"
    cre.to_bed(str(tmp_path / "out"))
    assert len([x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]) == 6


def test_lookups(cre, spark):
    assert cre.get("chr1:150-250(-)").first()["start"] == 150
    with pytest.raises(KeyError):
        cre.get("chrX:1-2(.)")
    with pytest.raises(TypeError):
        cre.get(1.5)
    got = cre.subloci(["chr2:50-60(+)", "chr1:100-200(+)", "chr2:50-60(+)"])
    assert [r[1] for r in rows(got)] == [50, 100, 50]
    with pytest.raises(KeyError):
        cre.subloci(["nope"])
    assert [r[1] for r in rows(cre.overlaps("chr1", 240, 260))] == [150, 250]


def test_merge_across_tiles_and_empty(spark):
    x = Loci.of(spark, [("c", 0, 10), ("c", 5, 1 << 24), ("c", 1 << 23, (1 << 23) + 5), ("c", (1 << 24) + 1, (1 << 24) + 2)])
    assert [r[1:3] for r in sorted(rows(x.merge()))] == [(0, 1 << 24), ((1 << 24) + 1, (1 << 24) + 2)]
    none = Loci(x.df.limit(0))
    assert none.merge().count() == (none & x).count() == (none - x).count() == 0 and (x - none).count() == 4


def model(rng, n):
    return [(rng.choice(["a", "b"]), s := rng.randrange(0, 3000), s + rng.choice([1, 3, 20, 300, 2500]), rng.choice("+-.")) for _ in range(n)]


def test_random_against_model(spark):
    rng = random.Random(3)
    p, q = model(rng, 60), model(rng, 50)
    x, y = Loci.of(spark, p), Loci.of(spark, q)
    meet = lambda u, v: u[0] == v[0] and u[1] < v[2] and v[1] < u[2]
    pairs = sorted((r["a_ord"], r["b_ord"]) for r in overlap_pairs(x.df, y.df).collect())
    assert pairs == sorted((i, j) for i, u in enumerate(p) for j, v in enumerate(q) if meet(u, v))
    assert [r[0] for r in rows(x & y, "ord")] == [i for i, u in enumerate(p) if any(meet(u, v) for v in q)]
    assert [r[0] for r in rows(x - y, "ord")] == [i for i, u in enumerate(p) if not any(meet(u, v) for v in q)]
    gap = lambda u, v: 0 if meet(u, v) else (u[1] - v[2] + 1 if v[2] <= u[1] else v[1] - u[2] + 1)
    got = {r["ord"]: (r["distance"], r["b_start"], r["b_end"], r["b_ord"]) for r in __import__("spanloom.operators.nearest", fromlist=["x"]).nearest(x.df, y.df).collect()}
    for i, u in enumerate(p):
        assert got[i] == min((gap(u, v), v[1], v[2], j) for j, v in enumerate(q) if v[0] == u[0])


def test_no_nested_loops(spark, cre, other):
    for df in ((cre & other).df, (cre - other).df, cre.pairs(other), cre.nearest(other)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_region_filter_reaches_the_scan(spark, tmp_path):
    Loci.of(spark, [("c", 1, 5), ("d", 1, 5)]).df.write.parquet(str(tmp_path / "l"))
    plan = Loci(spark.read.parquet(str(tmp_path / "l"))).overlaps("c", 0, 9).df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(chrom)" in plan and "EqualTo(chrom,c)" in plan


def test_uid_and_frames(cre):
    assert cre.frame("length", "center").first() == (100, 150)
    assert cre.to_frame().columns == ["Chr", "Start", "End", "Strand", "Name"]
    assert cre.uids().count() == 6 and cre.contains("chr10:5-15(+)")
    assert cre.remove("chr10:5-15(+)").count() == 5 and rows(cre.reverse())[0][0] == "chr10"
    assert cre.df.select(uid()).first()[0] == "chr1:100-200(+)"


def test_lines_keep_order(spark, tmp_path):
    (tmp_path / "x.bed").write_text("".join(f"c\t{i}\t{i + 1}\n" for i in range(1000)))
    got = text.read_bed(spark, str(tmp_path / "x.bed")).orderBy("ord").select("start").collect()
    assert [r[0] for r in got] == list(range(1000))


def test_column_functions(spark):
    df = spark.createDataFrame([("c", -4, 1)], "chrom string, start long, end long")
    assert Loci(df).frame("center").first()[0] == -2
    assert Loci(df.withColumn("x", F.lit(1))).df.columns == ["chrom", "start", "end", "strand", "ord"]


def test_nearest_sorts_events_once_in_small_tiles(spark):
    """Dense loci of one 2^22 are dealt to many tiles, sorted once; ends and copies that meet, and empty tiles, change no result."""
    from spanloom.operators import nearest

    rng = random.Random(11)
    p = [("c", s := rng.randrange(-40, 200) * 8, s + rng.choice([0, 8, 16])) for _ in range(150)] + [("d", 5, 6), ("c", 1 << 30, (1 << 30) + 1)]
    q = [("c", s := rng.randrange(-40, 200) * 8, s + rng.choice([1, 8, 8, 40])) for _ in range(25)] * 2 + [("e", 5, 6)]
    x, y = Loci.of(spark, p).df, Loci.of(spark, q).df
    gap = lambda u, v: 0 if u[1] < v[2] and v[1] < u[2] else (u[1] - v[2] + 1 if v[2] <= u[1] else v[1] - u[2] + 1)
    model = {i: min((gap(u, v), v[1], v[2], j) for j, v in enumerate(q) if v[0] == "c") for i, u in enumerate(p) if u[0] == "c"}
    for tile in (3, nearest.TILE):
        out = nearest.nearest(x, y, tile=tile)
        assert {r["ord"]: (r["distance"], r["b_start"], r["b_end"], r["b_ord"]) for r in out.collect()} == model
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Window [" in line and " at#" in line]) == 1
    dense = spark.range(20_000).selectExpr("'c' as chrom", "id * 200 as start", "id * 200 + 50 as end", "'+' as strand", "id as ord")
    events = nearest._events(dense.select("chrom", "start", "end"), dense, nearest.TILE)
    assert events.groupBy("tile", "chrom").count().agg({"count": "max"}).first()[0] < 2000 and events.count() == 80_000
