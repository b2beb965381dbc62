"""Gene models: genes, transcripts and features as tables, and annotation of loci by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import tss_end, tss_start, uid
from spanloom.operators.loci import Loci
from spanloom.operators.merge import merge
from spanloom.operators.overlap import overlap_pairs
from spanloom.operators.rounds import Rounds
from spanloom.sources import text

#: Annotation classes in order of priority.
CLASSES = ("Promoter-TSS", "5UTR", "3UTR", "Exonic", "Intronic")
OTHER = "Intergenic"


class Genes:
    """genes: gene_id, gene_name, gene_type, chrom, start, end, strand, ord. transcripts: transcript_id, gene_id, locus, ord.
    features: gene_id, transcript_id, feature (exon, CDS, UTR), exon_number, utr_type, locus, ord."""

    def __init__(self, genes: DataFrame, transcripts: DataFrame, features: DataFrame, promoter_r: int = 1000, filename: str | None = None, unmapped: DataFrame | None = None):
        self.genes, self.transcripts, self.features = genes, transcripts, features
        self.promoter_r, self.filename, self.unmapped = promoter_r, filename, unmapped
        self._tables: Rounds | None = None
        self._sets: dict[str, DataFrame] = {}

    @classmethod
    def make(cls, spark: SparkSession, filename: str, gene_name_key: str = "gene_name", gene_type_key: str = "gene_type", chr_map: dict[str, str] | None = None, promoter_r: int = 1000, zero_based: bool = False) -> "Genes":
        rows = text.read_gtf(spark, filename, gene_name_key=gene_name_key, gene_type_key=gene_type_key, chr_map=chr_map, zero_based=zero_based)
        return cls.of(rows, promoter_r, filename)

    @classmethod
    def of(cls, rows: DataFrame, promoter_r: int = 1000, filename: str | None = None) -> "Genes":
        """From parsed feature rows (see sources.text.parse_gtf).

        A repeated gene row replaces the one before it; a transcript of an unseen gene makes a
        gene of its own coordinates without name and type. UTRs without a side are placed by the
        transcript's first CDS in file order. The parsed rows, genes and features feed many small sets, so
        each is written once as a table; release() deletes them.
        """
        tables = Rounds(rows.sparkSession)
        rows = tables.table(rows)
        locus = ["chrom", "start", "end", "strand"]
        last = rows.where("feature = 'gene'").groupBy("gene_id").agg(F.max_by(F.struct(F.coalesce("gene_name", "gene_id").alias("gene_name"), "gene_type", *locus, "ord"), "ord").alias("g"))
        named = last.select("gene_id", "g.*")
        transcripts = rows.where("feature = 'transcript'").groupBy("transcript_id", "gene_id").agg(F.max_by(F.struct(*locus, "ord"), "ord").alias("t")).select("transcript_id", "gene_id", "t.*")
        stub = rows.where("feature = 'transcript'").join(last, "gene_id", "left_anti").groupBy("gene_id").agg(F.min_by(F.struct(*locus, "ord"), "ord").alias("t"))
        stub = stub.select("gene_id", F.lit("").alias("gene_name"), F.lit("").alias("gene_type"), "t.*")
        genes = tables.table(named.unionByName(stub))
        parts = rows.where("feature in ('exon', 'CDS', 'UTR', 'five_prime_UTR', 'three_prime_UTR')")
        cds = rows.where("feature = 'CDS'").groupBy("gene_id", "transcript_id").agg(F.min_by("start", "ord").alias("cds_start"))
        features = parts.join(cds, ["gene_id", "transcript_id"], "left").select(
            "gene_id", "transcript_id", F.when(F.col("feature").endswith("UTR"), "UTR").otherwise(F.col("feature")).alias("feature"), "exon_number", utr_type().alias("utr_type"), *locus, "ord"
        )
        known = ["gene", "transcript", "exon", "CDS", "UTR", "five_prime_UTR", "three_prime_UTR"]
        out = cls(genes, transcripts, features, promoter_r, filename, rows.where(~F.col("feature").isin(known)).select("feature").distinct())
        out._tables = tables
        return out

    def release(self) -> None:
        """Deletes what is kept of the model: its parsed rows, genes and annotation sets. No use of it may follow."""
        if self._tables is not None:
            self._tables.drop(kept=0)
        self._sets.clear()

    def __repr__(self) -> str:
        return f"Genes(filename={self.filename})"

    def add_features(self, rows: DataFrame) -> "Genes":
        """With more exon, CDS or UTR rows (columns of `features`)."""
        return Genes(self.genes, self.transcripts, self.features.unionByName(rows), self.promoter_r, self.filename, self.unmapped)

    def add_transcripts(self, rows: DataFrame) -> "Genes":
        """With more transcripts (columns of `transcripts`); one of a known id replaces it."""
        kept = self.transcripts.join(rows.select("transcript_id"), "transcript_id", "left_anti").select(*self.transcripts.columns)
        return Genes(self.genes, kept.unionByName(rows), self.features, self.promoter_r, self.filename, self.unmapped)

    def table(self) -> DataFrame:
        """(feature, n) of Transcripts, Exons, CDS and UTR."""
        kinds = self.features.groupBy("feature").agg(F.count("*").alias("n"))
        all_kinds = self.transcripts.agg(F.count("*").alias("n")).select(F.lit("Transcripts").alias("feature"), "n")
        shown = F.when(F.col("feature") == "exon", "Exons").otherwise(F.col("feature"))
        return all_kinds.unionByName(kinds.select(shown.alias("feature"), "n"))

    def tss(self, gene_type: str | list[str] | None = None, key: str = "gene_name") -> DataFrame:
        """(key, chrom, start, end, strand, ord): genes of one name collapse to the last, at the first one's place."""
        rows = self.genes
        if gene_type is not None:
            rows = rows.where(F.col("gene_type").isin([gene_type] if isinstance(gene_type, str) else list(gene_type)))
        point = F.struct("chrom", tss_start().alias("start"), tss_end().alias("end"))
        out = rows.groupBy(F.col(key).alias("name")).agg(F.max_by(point, "ord").alias("t"), F.min("ord").alias("ord"))
        return out.select("name", "t.chrom", "t.start", "t.end", F.lit(".").alias("strand"), "ord")

    def tss_windows(self, key: str = "gene_name") -> Loci:
        return Loci(self.tss(key=key).drop("name")).slop(self.promoter_r)

    def annotation_sets(self, key: str = "gene_name") -> DataFrame:
        """(class, priority, chrom, start, end): bodies as they are, the other four sets merged. Written once, as a join reads them several times."""
        if key not in self._sets:
            self._tables = self._tables or Rounds(self.genes.sparkSession)
            self._sets[key] = self._tables.table(self._annotation_sets(key))
        return self._sets[key]

    def _annotation_sets(self, key: str) -> DataFrame:
        locus = ["chrom", "start", "end", "strand", "ord"]
        kind = F.when(F.col("feature") == "exon", 3).when(F.col("utr_type") == "5'", 1).when(F.col("utr_type") == "3'", 2)
        parts = self.features.select(kind.alias("priority"), *locus).where("priority is not null")
        # a merge reads its rows several times
        parts = self._tables.table(parts.unionByName(self.tss_windows(key).df.select(F.lit(0).alias("priority"), *locus)))
        merged = merge(parts, by=("priority",))
        rows = merged.select("priority", "chrom", "start", "end").unionByName(self.genes.select(F.lit(4).alias("priority"), "chrom", "start", "end"))
        return rows.select(F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col("priority")).alias("class"), "priority", "chrom", "start", "end")

    def annotations(self, loci: Loci, key: str = "gene_name") -> DataFrame:
        """(ord, uid, annotation) of every locus: the class of least priority that it overlaps, else Intergenic.

        One overlap join against all sets, and a minimum: no class is probed apart.
        """
        coords = loci.df.select("chrom", "start", "end").distinct()
        best = overlap_pairs(coords, self.annotation_sets(key).select("chrom", "start", "end", "priority"))
        best = best.groupBy(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end")).agg(F.min("b_priority").alias("p"))
        names = F.array(*[F.lit(c) for c in CLASSES])
        out = loci.df.join(best, ["chrom", "start", "end"], "left")
        return out.select("ord", uid().alias("uid"), F.coalesce(F.get(names, F.col("p")), F.lit(OTHER)).alias("annotation"))

    def nearest_genes(self, loci: Loci, key: str = "gene_name") -> DataFrame:
        """The nearest promoter window of each locus, named by its gene."""
        named = self.tss(key=key)
        out = loci.nearest(Loci(named.drop("name")).slop(self.promoter_r), o_names=F.col("ord").cast("string"))
        names = named.select(F.col("ord").cast("string").alias("Name_b"), F.col("name").alias("gene"))
        columns = [F.col("gene").alias("Name_b") if c == "Name_b" else F.col(c) for c in out.columns]
        return out.join(names, "Name_b").select(*columns)


def utr_type() -> Column:
    """5' or 3', null where strand or CDS leave it open."""
    before = F.col("end") <= F.col("cds_start")
    placed = F.when(F.col("strand") == "+", F.when(before, "5'").when(~before, "3'")).when(F.col("strand") == "-", F.when(before, "3'").when(~before, "5'"))
    return F.when(F.col("feature") == "five_prime_UTR", "5'").when(F.col("feature") == "three_prime_UTR", "3'").when(F.col("feature") == "UTR", placed)
