"""Whole texts in the queries of FASTA and motif operators."""

import os

import pytest

from spanloom import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
TEXT = "x" * 5000 + "\ntatat > aaaaaaaaa " + "y" * 70_000 + " tat"


@pytest.fixture
def sf_dir(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([(1, TEXT, "en", "s", len(TEXT)), (2, " Tat ", "en", "s", 5), (3, " \n", "en", "s", 2), (4, None, "en", "s", 0)], docs).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("lineitem", "part", "orders", "events"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_sequences_are_whole_texts(spark, sf_dir):
    whole = TEXT.replace("\n", " ").replace(">", "N")
    assert {r["name"]: r["seq"] for r in plans.queries()["fasta_parse"](spark, sf_dir).collect()} == {"chr1": whole, "chr2": "Tat"}
    assert {r["ord"]: r["sequence"] for r in plans.queries()["locus_sequence"](spark, sf_dir).collect()} == {1: whole, 2: "Tat"}


def test_motifs_are_sought_in_whole_texts(spark, sf_dir):
    got = {r["motif"]: r["score"] for r in plans.queries()["motif_scan"](spark, sf_dir).collect()}
    assert got == pytest.approx({"TATA": 4 / 3, "none": 1 / 9})
