"""The tag store and its predicates."""

import pytest

from spanloom import Loci
from spanloom.operators.tags import Tags, aliases

A, B, C = "chr1:100-200(+)", "chr1:150-250(-)", "chr1:1000-1100(.)"


@pytest.fixture(scope="module")
def tags(spark):
    loci = Loci.of(spark, [("chr1", 100, 200, "+"), ("chr1", 150, 250, "-"), ("chr1", 1000, 1100)])
    return Tags.make(loci).add({"H3K27ac-SE": [A, B], "atac": {A: 1.5, B: "2.0", C: "low"}})


def picked(tags, fn):
    return [r["start"] for r in tags.query(fn).df.orderBy("ord").collect()]


def test_queries(tags):
    assert picked(tags, lambda x: x.se) == picked(tags, lambda x: x["h3k27ac-se"]) == [100, 150]
    assert picked(tags, lambda x: x.atac > 1.6) == [150]
    assert picked(tags, lambda x: x.atac != 1.5) == [150, 1000]
    assert picked(tags, lambda x: x.atac == "low") == [1000]
    assert picked(tags, lambda x: x.se & x.atac > 1.6) == [150]
    assert picked(tags, lambda x: (x.atac < 1.6) | (x.atac >= 2)) == [100, 150]
    assert picked(tags, lambda x: x.se - [A]) == [150]
    assert picked(tags, lambda x: x.se ^ [A, C]) == [150, 1000]
    assert picked(tags, lambda x: [A, C] - x.se) == [1000]
    assert picked(tags, lambda x: [A, C]) == [100, 1000]


def test_errors(tags):
    with pytest.raises(TypeError):
        tags.query(lambda x: x.atac > 1.6 & x.se)
    for fn in (lambda x: x.atac, lambda x: x.se & x.atac):
        with pytest.raises(ValueError):
            tags.query(fn)
    for fn in (lambda x: x.atac & x.atac, lambda x: x.se | x.atac, lambda x: x.se - x.atac, lambda x: 3):
        with pytest.raises(TypeError):
            tags.query(fn)
    with pytest.raises(AttributeError):
        tags.query(lambda x: x.nothing)
    with pytest.raises(KeyError):
        tags.loci.map({"t": ["no"]})
    with pytest.raises(TypeError):
        tags.loci.map({"t": 3})
    with pytest.raises(TypeError):
        Tags.make(tags.loci).add([1])


def test_reads(tags):
    assert aliases("H3K27ac-SE") == {"h3k27ac-se", "h3k27ac", "se", "h3k27ac_se", "h3k27acse"}
    assert [tuple(r) for r in tags.table().collect()] == [("H3K27ac-SE", "set", 2), ("atac", "mapping", 3)]
    assert "se" in tags and "zz" not in tags and tags.keys() == ["H3K27ac-SE", "atac"]
    seen = {}
    tags.query(lambda x: seen.update(se=x.se, atac=x.atac) or x.se)
    assert len(seen["se"]) == 2 and A in seen["se"] and sorted(seen["se"]) == [A, B]
    assert seen["atac"][B] == 2.0 and seen["atac"][C] == "low"
    with pytest.raises(KeyError):
        seen["atac"]["no"]


def test_exact_name_wins_and_overlap_mode(tags, spark):
    own = Tags.make(tags.loci).add({"H3K27ac-SE": [A], "se": [C]})
    assert picked(own, lambda x: x.se) == [1000]
    wide = tags.loci.tag(Loci.of(spark, [("chr1", 190, 1001)]), "hit", mode="overlap")
    assert picked(wide, lambda x: x.hit) == [100, 150, 1000]


def test_uids_of_sets_are_one_aggregate(spark):
    """Selections of sets alone take no join a set; an unknown uid of any tag is found by one check."""
    import pytest

    from spanloom import Loci
    from spanloom.operators.tags import Tags

    x = Loci.of(spark, [("a", 1, 2), ("b", 3, 4), ("a", 1, 2), ("c", 5, 6)])
    t = Tags.make(x).add({"one": ["a:1-2(.)", "b:3-4(.)"], "two": ["b:3-4(.)", "c:5-6(.)"]})
    seen = []
    t.query(lambda q: seen.extend([q.one & q.two, q.one - q.two, q.one ^ q.two]) or q.one)
    assert [sorted(r[0] for r in s.uids().collect()) for s in seen] == [["b:3-4(.)"], ["a:1-2(.)"], ["a:1-2(.)", "c:5-6(.)"]]
    assert "Join" not in seen[0].uids()._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(KeyError):
        t.add({"fine": ["a:1-2(.)"], "odd": ["z:1-2(.)"]})
