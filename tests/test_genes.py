"""Gene models on the hand-worked fixture."""

import pytest

from spanloom import Genes, Loci

ROWS = """gene 1000 5000 + gene_id "G1"; gene_name "A"; gene_type "protein_coding";
transcript 1000 5000 + gene_id "G1"; transcript_id "T1";
exon 1000 1500 + gene_id "G1"; transcript_id "T1"; exon_number 1;
CDS 1200 1500 + gene_id "G1"; transcript_id "T1"; exon_number 1;
exon 4000 5000 + gene_id "G1"; transcript_id "T1"; exon_number 2;
CDS 4000 4500 + gene_id "G1"; transcript_id "T1"; exon_number 2;
UTR 1000 1199 + gene_id "G1"; transcript_id "T1";
UTR 4501 5000 + gene_id "G1"; transcript_id "T1";
gene 8000 9000 - gene_id "G2"; gene_name "{name}"; gene_type "lncRNA";
transcript 8000 9000 - gene_id "G2"; transcript_id "T2";
exon 8000 9000 - gene_id "G2"; transcript_id "T2"; exon_number 1;
odd 1 2 + gene_id "G2";"""
EXPECTED = {1050: "Promoter-TSS", 1150: "5UTR", 1300: "Exonic", 2000: "Intronic", 4600: "3UTR", 8500: "Exonic", 8995: "Promoter-TSS", 9150: "Intergenic"}


def made(spark, folder, name="B", **options):
    lines = ["#c"]
    for row in ROWS.format(name=name).splitlines():
        f, s, e, strand, attributes = row.split(" ", 4)
        lines.append("\t".join(["chr1", "x", f, s, e, ".", strand, ".", attributes]))
    path = folder / f"{name}.gtf"
    path.write_text("\n".join(lines) + "\nshort\tline\n")
    return Genes.make(spark, str(path), promoter_r=100, **options)


def test_model(spark, tmp_path):
    g = made(spark, tmp_path)
    assert {r[0]: r[1] for r in g.table().collect()} == {"Transcripts": 2, "Exons": 3, "CDS": 2, "UTR": 2}
    assert {(r["start"], r["utr_type"]) for r in g.features.where("feature = 'UTR'").collect()} == {(1000, "5'"), (4501, "3'")}
    assert {r["name"]: (r["start"], r["end"]) for r in g.tss().collect()} == {"A": (1000, 1001), "B": (9000, 8999)}
    assert {(r["start"], r["end"]) for r in g.tss_windows().df.collect()} == {(900, 1101), (8900, 9099)}
    assert [r["name"] for r in g.tss("lncRNA").collect()] == ["B"]
    assert [r[0] for r in g.unmapped.collect()] == ["odd"]


def test_annotation(spark, tmp_path):
    loci = Loci.of(spark, [("chr1", s, s + 10) for s in EXPECTED] + [("chr3", 1, 2)])
    got = {r["uid"]: r["annotation"] for r in made(spark, tmp_path).annotations(loci).collect()}
    assert got == {f"chr1:{s}-{s + 10}(.)": a for s, a in EXPECTED.items()} | {"chr3:1-2(.)": "Intergenic"}


def test_same_names_collapse(spark, tmp_path):
    g = made(spark, tmp_path, "A")
    loci = Loci.of(spark, [("chr1", 1050, 1060)])
    assert g.annotations(loci).first()["annotation"] == "5UTR"
    assert g.annotations(loci, key="gene_id").first()["annotation"] == "Promoter-TSS"


def test_nearest_gene_and_options(spark, tmp_path):
    g = made(spark, tmp_path, chr_map={"chr1": "1"}, zero_based=True)
    row = g.nearest_genes(Loci.of(spark, [("1", 1200, 1210)])).first()
    assert row["Name_b"] == "A" and row["Distance"] == 1200 - 1100 + 1


def test_stub_gene(spark):
    from spanloom.sources.text import parse_gtf

    lines = spark.createDataFrame([('c\tx\ttranscript\t5\t9\t.\t+\t.\tgene_id "S"; transcript_id "T";', 1)], "value string, ord long")
    row = Genes.of(parse_gtf(lines)).genes.first()
    assert (row["gene_id"], row["gene_name"], row["start"]) == ("S", "", 5)


def test_missing_tss_type(spark, tmp_path):
    assert made(spark, tmp_path).tss(["none"]).isEmpty()
    with pytest.raises(NotImplementedError):
        Loci.make(spark, "a.gff3")


def test_additions_and_annotation_tags(spark, tmp_path):
    g = made(spark, tmp_path)
    assert g.add_features(g.features.limit(2)).features.count() == 9
    more = g.add_transcripts(g.transcripts.where("transcript_id = 'T1'").unionByName(g.transcripts.where("transcript_id = 'T2'").selectExpr("'T3' as transcript_id", "gene_id", "chrom", "start", "end", "strand", "ord")))
    assert sorted(r[0] for r in more.transcripts.select("transcript_id").collect()) == ["T1", "T2", "T3"]
    tags = Loci.of(spark, [("chr1", 1050, 1060), ("chr1", 2000, 2010)]).map({}).add_annotations(g)
    assert [r["start"] for r in tags.query(lambda x: x.exonic & x["promoter-tss"]).df.collect()] == [1050]


def test_a_model_is_parsed_once(spark):
    """No plan of the annotation sets, or of the genes, parses lines again; the parse runs on all cores."""
    from spanloom.plans.queries import genes, gtf_lines
    from spanloom.plans.views import load

    load(spark, "/root/testdata/sf0.001")
    assert gtf_lines(spark).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    g = genes(spark)
    for df in (g.genes, g.annotation_sets()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract" not in plan and "InMemoryRelation" not in plan
    g.release()
