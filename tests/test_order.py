"""List access, dense positions, graph algorithms and signal frames."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom import Architecture, Loci
from spanloom.operators import signal
from spanloom.operators.overlap import overlap_pairs
from spanloom.operators.tags import Tags


@pytest.fixture(scope="module")
def many(spark):
    """100 loci whose positions have gaps, as those of a table of several splits have."""
    rng = random.Random(7)
    rows = [(f"c{rng.randint(0, 3)}", rng.randrange(1 << 20), i) for i in range(100)]
    df = spark.createDataFrame([(c, s, s + 10, "+", (i // 30 << 33) + i % 30) for c, s, i in rows], "chrom string, start long, end long, strand string, ord long")
    return Loci(df.repartition(7)), rows


def starts(loci):
    return [(r["chrom"], r["start"], r["ord"]) for r in loci]


def test_positions_are_dense(many):
    loci, rows = many
    assert starts(loci.renumbered()) == [(c, s, i) for i, (c, s, _) in enumerate(rows)]
    ranked = [(c, s) for c, s, _ in sorted(rows)]
    assert starts(loci.sort()) == [(c, s, i) for i, (c, s) in enumerate(ranked)]
    assert loci.sort().at(50).first()["start"] == ranked[50][1] and loci.at(-1).first()["start"] == rows[-1][1]
    assert [x[:2] for x in starts(loci.sort().slice(0, 100))] == ranked
    assert [x[:2] for x in starts(loci[10:90:7])] == [r[:2] for r in rows[10:90:7]]
    assert [x[:2] for x in starts(loci[-5:])] == [r[:2] for r in rows[-5:]]
    for wrong in (100, -101):
        with pytest.raises(IndexError):
            loci.at(wrong)
    with pytest.raises(ValueError):
        loci.slice(step=-1)


def test_list_operations(spark):
    x = Loci.of(spark, [("a", 1, 2), ("b", 3, 4), ("a", 1, 2)])
    assert len(x) == 3 and bool(x) and not Loci(x.df.limit(0)) and "b:3-4(.)" in x and x.count("a:1-2(.)") == 2
    assert x.index("b:3-4(.)") == 1 and x["a:1-2(.)"].first()["ord"] == 2 and x[1].first()["chrom"] == "b"
    with pytest.raises(ValueError):
        x.index("z:1-2(.)")
    y = x.insert(1, "n", 7, 8).append("z", 9, 10, "-")
    assert [r["chrom"] for r in y] == ["a", "n", "b", "a", "z"]
    row, rest = y.pop(1)
    assert row["chrom"] == "n" and [r["chrom"] for r in rest] == ["a", "b", "a", "z"]
    assert [r["chrom"] for r in x.insert(-9, "n", 7, 8)] == ["n", "a", "b", "a"] and [r["chrom"] for r in x.insert(9, "n", 7, 8)][-1] == "n"
    assert Loci(x.df.limit(0)).sort().count() == 0 and Loci(x.df.limit(0)).renumbered().count() == 0


def test_joins_of_mixed_levels(spark):
    rng = random.Random(5)
    wide = [1, 300, 5000, 1 << 15, 1 << 18]
    rows = lambda n, widths: [("c", s := rng.randrange(1 << 19), s + rng.choice(widths)) for _ in range(n)]
    for own, other in ((wide[:1], wide[:1]), (wide[:1], wide[3:]), (wide[3:], wide[:2]), (wide, wide)):
        p, q = rows(80, own), rows(80, other)
        pairs = sorted((r["a_ord"], r["b_ord"]) for r in overlap_pairs(Loci.of(spark, p).df, Loci.of(spark, q).df).collect())
        assert pairs == sorted((i, j) for i, u in enumerate(p) for j, v in enumerate(q) if u[1] < v[2] and v[1] < u[2])


def test_graph_algorithms(spark):
    chain = [(f"c:{i}-{i + 1}(.)", f"c:{i + 1}-{i + 2}(.)") for i in range(0, 6)] + [("d:1-2(.)", "d:3-4(.)")]
    edges = spark.createDataFrame([(k, 0, 0, u, v, 1.0, None, None) for k, (u, v) in enumerate(chain)], "loop_id long, ord1 long, ord2 long, uid1 string, uid2 string, w double, n double, d double")
    g = Architecture(edges)
    found = {r["uid"]: r["component"] for r in g.components().collect()}
    assert set(found.values()) == {"c:0-1(.)", "d:1-2(.)"} and found["c:6-7(.)"] == "c:0-1(.)" and len(found) == 9
    near = {r["uid"]: r["hops"] for r in g.within(spark.createDataFrame([("c:2-3(.)",), ("no",)], "uid string"), 3).collect()}
    assert near == {"c:0-1(.)": 2, "c:1-2(.)": 1, "c:2-3(.)": 0, "c:3-4(.)": 1, "c:4-5(.)": 2, "c:5-6(.)": 3}
    assert Architecture.empty(spark).components().count() == 0


def test_signal_methods(spark):
    own = Loci.of(spark, [("c", 0, 100), ("c", 100, 200), ("c", 0, 100)])
    tracks = spark.createDataFrame([("t", "c", 0, 100, 1.0), ("u", "c", 100, 200, 3.0)], "track string, chrom string, start long, end long, value double")
    sizes = spark.createDataFrame([("c", 200)], "chrom string, length long")
    values = own.signal(tracks, sizes, n_bins=2, span=True)
    sets = own.df.select("ord", F.lit("s").alias("set"))
    assert own.profile_frame(values, sets).count() == 4
    order = {r["ord"]: r["place"] for r in signal.heatmap_order(values).collect()}
    assert order == {1: 0, 2: 1, 0: 2} and {r["place"] for r in signal.heatmap_order(values, no_sort=True).collect()} == {0, 1, 2}
    assert own.heatmap_frame(values, sets, limit=[0.5, 2]).agg(F.max("value")).first()[0] == 2
    with pytest.raises(ValueError):
        own.heatmap_frame(values, sets, limit=[1])
    with pytest.raises(ValueError):
        own.signal(tracks)
    assert signal.heatmap_order(values.limit(0)).count() == 0


def test_first_tag_of_a_name_in_any_case_wins(spark):
    loci = Loci.of(spark, [("c", 0, 1), ("c", 1, 2)])
    t = Tags.make(loci).add({"Peak": ["c:0-1(.)"], "PEAK": ["c:1-2(.)"]})
    assert t.resolve("peak") == "Peak" and t.resolve("PEAK") == "PEAK"


def test_close_positions_are_numbered_in_blocks(spark):
    """Ids of a text's splits, two clumps 2^33 apart, fill more than one bucket a clump."""
    from spanloom.operators.order import placed

    ids = spark.range(600_000).selectExpr("(id div 300000 << 33) + id % 300000 as ord", "id")
    out = placed(ids, "ord", "pos")
    assert "shiftright" in out._jdf.queryExecution().optimizedPlan().toString().lower() or ">> 18" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("pos <> id").isEmpty() and out.count() == 600_000


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    """No task sorts or holds the whole; the order is that of the lines."""
    from spanloom.sources import text

    lines = spark.range(20_000).selectExpr("cast(id as string) as value", "id as ord").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.sparkContext.setJobGroup("one-file", "")
    try:
        text.write_lines(lines, str(tmp_path / "own.txt"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    last = max(s for j in tracker.getJobIdsForGroup("one-file") for s in tracker.getJobInfo(j).stageIds)
    assert tracker.getStageInfo(last).numTasks == 4
    files = [p for p in (tmp_path / "own.txt").iterdir() if p.name.startswith("part-")]
    assert len(files) == 1 and files[0].read_text().split() == [str(i) for i in range(20_000)]
    assert [p.name for p in tmp_path.iterdir()] == ["own.txt"]


def test_a_position_sorts_only_its_tile(many):
    """at() of sorted loci never numbers all rows."""
    loci, rows = many
    ranked = [(c, s) for c, s, _ in sorted(rows)]
    x = loci.sort()
    assert [(r["chrom"], r["start"]) for i in (0, 57, -1, -100) for r in x.at(i).collect()] == [ranked[i] for i in (0, 57, -1, -100)]
    assert [r[:2] for r in starts(x[40:60])] == ranked[40:60] and x._tiles is not None
    assert x.at(3)._jdf.queryExecution().optimizedPlan().toString().count("Window") <= 2
    for wrong in (100, -101):
        with pytest.raises(IndexError):
            x.at(wrong)
