"""Contact graphs, weights and the power law."""

import math

import numpy as np
import pytest

from spanloom import Architecture, Loci
from spanloom.operators import powerlaw
from spanloom.sources import matrix

BEDPE = "#x\nchr1 140 160 chr1 1040 1060\nchr1 170 190 chr1 150 170\nchr1\t140\t160\tchr5\t0\t10\nchr1 x 1 chr1 2 3\n"
A, B, C = "chr1:100-200(+)", "chr1:150-250(-)", "chr1:1000-1100(.)"


@pytest.fixture(scope="module")
def abc(spark):
    return Loci.of(spark, [("chr1", 100, 200, "+"), ("chr1", 150, 250, "-"), ("chr1", 1000, 1100)])


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("b") / "l.bedpe"
    p.write_text(BEDPE)
    return str(p)


def weighed(spark, abc, path):
    bins = spark.createDataFrame([(0, "chr1", 0, 500), (1, "chr1", 500, 1000), (2, "chr1", 1000, 1500)], matrix.BINS)
    pixels = spark.createDataFrame([(0, 0, 6.0), (0, 2, 10.0)], matrix.PIXELS)
    return Architecture.make(spark, abc, path, r=50).add_matrix(abc, bins, pixels)


def test_edges_and_report(spark, abc, path):
    g = Architecture.make(spark, abc, path, r=50)
    assert sorted((r["uid1"], r["uid2"]) for r in g.edges.collect()) == sorted([(A, C), (B, C), (A, B), (B, A)])
    assert tuple(g.report().first()) == (4, 2, 50.0, 3, 4)
    near = Architecture.make(spark, abc, path, r=50, dmax=500)
    assert tuple(near.report().first())[:2] == (4, 1) and near.n_links() == 2
    assert g.n_loci() == 3 and g.contains(A) and not g.contains("x")
    assert g.dedupe().n_links() == 3


def test_weights_and_lookups(spark, abc, path):
    g = weighed(spark, abc, path)
    w = {(r["uid1"], r["uid2"]): r["w"] for r in g.edges.collect()}
    assert w == {(A, C): 5.0, (B, C): 5.0, (A, B): 3.0, (B, A): 3.0}
    assert {r["uid"]: r["w"] for r in g.neighbors(A).collect()} == {B: 3.0, C: 5.0}
    assert g.edge(C, A)["w"] == 5.0
    for bad in ("nope", "chr1:1-2(.)"):
        with pytest.raises(KeyError):
            g.edge(A, bad)
    with pytest.raises(TypeError):
        g.neighbors(3)
    d = {(r["uid1"], r["uid2"]): r["d"] for r in g.with_distance(abc).edges.collect()}
    assert d[(A, C)] == 900 and d[(B, C)] == 850 and d[(A, B)] == 50
    with pytest.raises(ValueError):
        g.normalize(abc, source="none")
    assert g.copy().edges is g.edges and Architecture.empty(spark).n_links() == 0


def test_power_law(spark):
    pts = spark.createDataFrame([(float(d), 1000 * d**-0.8) for d in range(1, 200)], "d double, w double")
    c, alpha = powerlaw.fit(pts)
    assert abs(alpha - 0.8) < 1e-5 and abs(c - 1000) < 0.1
    assert powerlaw.fit(pts.limit(0)) is None and powerlaw.fit(pts.limit(1)) is None


def test_power_law_is_least_squares(spark):
    rng = np.random.default_rng(1)
    d = rng.integers(1, 50, 300).astype(float)
    w = 30 * d**-0.5 * rng.uniform(0.5, 1.5, 300)
    c, alpha = powerlaw.fit(spark.createDataFrame(list(zip(d.tolist(), w.tolist())), "d double, w double"))
    loss = lambda c, a: ((w - c * d**-a) ** 2).sum()
    assert all(loss(c, alpha) <= loss(c * (1 + i), alpha + j) + 1e-9 for i in (-1e-3, 0, 1e-3) for j in (-1e-3, 0, 1e-3))


def test_normalize_guards(spark, abc, path):
    from pyspark.sql import functions as F

    flat = Architecture.make(spark, abc, path, r=50).normalize(abc)
    assert all(math.isnan(r["n"]) for r in flat.edges.collect())
    one = spark.createDataFrame([(0.0, 2.0), (2.0, 3.0)], "d double, w double").withColumn("t", F.lit(None).cast("double"))
    got = one.select(powerlaw.observed_over_expected(F.col("d"), F.col("w"), (4.0, 1.0)), powerlaw.observed_over_expected(F.col("t"), F.col("w"), (4.0, 1.0))).collect()
    assert [tuple(r) for r in got] == [(0.0, None), (1.5, None)]


def test_matrix_sources(spark, tmp_path):
    (tmp_path / "resolutions/5").mkdir(parents=True)
    (tmp_path / "resolutions/5/bins.tsv").write_text("bin_id\tchrom\tstart\tend\n0\tc\t0\t5\n")
    (tmp_path / "resolutions/5/pixels.tsv").write_text("bin1_id\tbin2_id\tcount\n0\t0\t2\n")
    bins, pixels = matrix.read_matrix(spark, f"{tmp_path}::resolutions/5")
    assert bins.first()["end"] == 5 and pixels.first()["count"] == 2.0
    assert matrix.read_matrix(spark, str(tmp_path), 5)[0].count() == 1


def test_edges_are_written_once(spark):
    """Weights and distances read a table of the edges, not the joins that make them."""
    from spanloom import Architecture, Loci

    own = Loci.of(spark, [("c", 0, 10), ("c", 100, 110)])
    loops = spark.createDataFrame([(1, "c", 0, 10, "c", 100, 110)], "loop_id long, chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long")
    g = Architecture.of(own, loops, r=20).with_distance(own)
    assert [(r["uid1"], r["uid2"], r["d"]) for r in g.edges.collect()] == [("c:0-10(.)", "c:100-110(.)", 100.0)]
    assert "loop_id" in g.edges.columns and "start1" not in g.edges._jdf.queryExecution().optimizedPlan().toString()
