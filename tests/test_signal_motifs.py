"""Signal, sequences, motifs, bigWig and streams."""

import struct
import zlib

import numpy as np
import pytest

from spanloom import Loci, scan_motifs
from spanloom.operators import motifs, signal
from spanloom.sources import bigwig, text
from spanloom.streaming import counts_stream, intersect_stream, pairs_stream, slop_stream


@pytest.fixture(scope="module")
def data(spark):
    tracks = spark.createDataFrame([("t", "c", 0, 100, 1.0), ("t", "c", 100, 200, 3.0)], bigwig.SCHEMA)
    return tracks, spark.createDataFrame([("c", 1000)], "chrom string, length long")


def values(spark, data, rows, **options):
    out = signal.signal(Loci.of(spark, rows), *data, **options)
    return signal.cube(out).tolist()


def test_span(spark, data):
    row = [("c", 50, 150)]
    assert values(spark, data, row, n_bins=2, span=True) == [[[1, 3]]]
    for agg, v in (("mean", 2), ("max", 3), ("min", 1), ("sum", 200), ("coverage", 1)):
        assert values(spark, data, row, n_bins=1, span=True, agg=agg) == [[[v]]]
    assert values(spark, data, [("c", 150, 250)], n_bins=2, span=True) == [[[3, 0]]]


def test_centered(spark, data):
    row = [("c", 0, 20)]
    assert values(spark, data, row, n_bins=30, flank=15) == [[[0] * 5 + [1] * 25]]
    assert values(spark, data, row, n_bins=4, flank=15) == [[[0] * 4]]
    assert values(spark, data, row, n_bins=30, flank=15, edge_mode="proportional") == [[[0] * 5 + [1] * 25]]
    assert values(spark, data, [("none", 0, 20)], n_bins=3) == [[[0, 0, 0]]]
    with pytest.raises(ValueError):
        values(spark, data, [("c", 0, 1)], agg="mode")
    with pytest.raises(ValueError):
        signal.signal(Loci(Loci.of(spark, row).df.limit(0)), *data)
    assert signal.listed(1, 2, "x") == [1, 1]
    with pytest.raises(ValueError):
        signal.listed([1], 2, "x")


def test_fasta_and_sequences(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text(">chr1 desc\nACGT\nacgt\n>empty\n>chr2\nNNAC\n")
    genome = text.read_fasta(spark, str(path))
    assert {r["name"]: r["seq"] for r in genome.collect()} == {"chr1": "ACGTacgt", "chr2": "NNAC"}
    lines = text.read_lines(spark, str(path))
    assert {r["name"]: r["seq"] for r in text.parse_fasta(lines).collect()} == {"chr1": "ACGTacgt", "chr2": "NNAC"}
    own = Loci.of(spark, [("chr1", 2, 6)])
    assert motifs.sequences(own, genome).first()["sequence"] == "GTac"
    assert motifs.sequences(own, genome, 2).first()["sequence"] == "GTac"
    assert motifs.sequences(Loci.of(spark, [("chr1", 1, 40)]), genome, 3).first()["sequence"] == ""
    parts = motifs.tiles(genome, 3)
    assert motifs.cut_sequences(own, parts, None, 3).first()["sequence"] == "GTac"
    with pytest.raises(KeyError):
        motifs.sequences(Loci.of(spark, [("chrX", 1, 2)]), genome)


def test_motifs(spark, tmp_path):
    path = tmp_path / "m.jaspar"
    path.write_text(">M1 acg\nA [ 9 0 0 ]\nC [ 0 9 0 ]\nG [ 0 0 9 ]\nT [ 0 0 0 ]\n>M2 none\nA 9 9\nC 0 0\nG 0 0\nT 0 0\n")
    own = Loci.of(spark, [("chr1", 0, 8)])
    genome = spark.createDataFrame([("chr1", "ACGTacgt")], "name string, seq string")
    top = motifs.pssm([[9, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0]]).max(1).sum()
    got = {r["motif"]: r["score"] for r in scan_motifs(own, genome, str(path), r=None, threshold=top - 0.01).collect()}
    assert got["acg"] == pytest.approx(2 / 3) and got["none"] == 0
    got = {r["motif"]: r["score"] for r in scan_motifs(own, genome, str(path), r=None, threshold=top - 0.01, norm=False).collect()}
    assert got["acg"] == 2
    with pytest.raises(ValueError):
        text.read_motifs(spark, str(path), "other")
    assert len(motifs.hits(b"NNN", motifs.pssm([[1, 1, 1, 1]] * 3), 0)) == 0


def written(path, rows, sizes):
    """A small bigWig: one bedGraph block a chromosome, both trees of one leaf."""
    names = sorted(sizes)
    width = max(map(len, names))
    tree = struct.pack("<IIIIQQ", bigwig.CHROM_MAGIC, 1, width, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(n.encode().ljust(width, b"\0") + struct.pack("<II", i, sizes[n]) for i, n in enumerate(names))
    data_at = 64 + len(tree)
    blocks, body = [], b""
    for i, n in enumerate(names):
        own = [r for r in rows if r[0] == n]
        raw = struct.pack("<IIIIIBBH", i, own[0][1], own[-1][2], 0, 0, 1, 0, len(own)) + b"".join(struct.pack("<IIf", *r[1:]) for r in own)
        packed = zlib.compress(raw)
        blocks.append((i, own[0][1], i, own[-1][2], data_at + 8 + len(body), len(packed)))
        body += packed
    index_at = data_at + 8 + len(body)
    index = struct.pack("<IIQIIIIQII", bigwig.TREE_MAGIC, 256, len(blocks), 0, 0, 0, 0, index_at, 1, 0) + struct.pack("<BBH", 1, 0, len(blocks)) + b"".join(struct.pack("<IIIIQQ", *b) for b in blocks)
    head = struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, data_at, index_at, 0, 0, 0, 0, 1 << 15, 0)
    path.write_bytes(head + tree + struct.pack("<Q", len(blocks)) + body + index)


def test_bigwig(spark, tmp_path):
    path = tmp_path / "own.bw"
    rows = [("c1", 0, 10, 1.0), ("c1", 10, 30, 2.5), ("c22", 5, 6, -1.0)]
    written(path, rows, {"c1": 100, "c22": 50})
    got = bigwig.read_bigwig(spark, str(path)).orderBy("chrom", "start").collect()
    assert [tuple(r) for r in got] == [("own", *r) for r in rows]
    assert {tuple(r) for r in bigwig.chrom_sizes(spark, str(path)).collect()} == {("c1", 100), ("c22", 50)}
    with pytest.raises(ValueError):
        (tmp_path / "bad.bw").write_bytes(b"\0" * 64)
        bigwig.File(str(tmp_path / "bad.bw"))


def test_plot_frames(spark, data):
    own = Loci.of(spark, [("c", 0, 100), ("c", 100, 200)])
    v = signal.signal(own, *data, n_bins=2, span=True)
    sets = own.df.selectExpr("ord", "'s' as set")
    assert [r["mean"] for r in signal.profile_frame(v, sets).orderBy("bin").collect()] == [2, 2]
    order = signal.heatmap_order(v).orderBy("place").collect()
    assert [r["ord"] for r in order] == [1, 0]
    assert signal.heatmap_frame(v, sets).count() == 4 and signal.set_labels(sets).count() == 1
    assert signal.profile_limit(signal.profile_frame(v, sets)).first()[0] == 2
    assert np.array_equal(signal.cube(v), [[[1, 1]], [[3, 3]]])


def test_streams(spark, tmp_path):
    static = Loci.of(spark, [("c", 0, 10), ("c", 5, 20)])
    Loci.of(spark, [("c", 8, 9), ("c", 30, 40)]).df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.df.schema).parquet(str(tmp_path / "in"))

    def result(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert [r["start"] for r in result(slop_stream(stream, 5), "s1")].count(3) == 1
    assert {r["start"] for r in result(intersect_stream(stream, static.df), "s2")} == {8}
    assert sorted(r["b_start"] for r in result(pairs_stream(stream, static.df), "s3")) == [0, 5]
    spark.sql("select timestamp '2024-01-01 00:00:00' as ts, 'k' as key, 1.0D as value union all select timestamp '2024-01-01 05:00:00', 'k', 2.0D").write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("ts timestamp, key string, value double").parquet(str(tmp_path / "ev"))
    assert {r["total"] for r in result(counts_stream(events, "ts", "key"), "s4", "complete")} == {1.0, 2.0}
