"""Readers and writers of text formats: BED, GTF, BEDPE, FASTA, motif counts.

Lines keep their order by (file, offset of the split, number in the split), all of which
Spark gives without a pass over the data. Every parser also takes a DataFrame of lines
(`value`, `ord`), so that a stream or another source can feed it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord); gzip by suffix."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))


def file_type(path: str) -> str:
    return "Features" if re.search(r"\.(gtf|gff|gff3)(\.gz)?$", path) else "Loci"


def read_loci(spark: SparkSession, path: str, filetype: str | None = None) -> DataFrame:
    kind = filetype or file_type(path)
    if kind == "Features":
        raise NotImplementedError("a feature file is read by Genes.make")
    if kind != "Loci":
        raise ValueError(f"unknown file type {kind}")
    return read_bed(spark, path)


def content(lines: DataFrame) -> DataFrame:
    """Without comments and blank lines."""
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(read_lines(spark, path))


def parse_bed(lines: DataFrame) -> DataFrame:
    """chrom, start, end, strand, ord from fields 1-3 and 6 (`.` if there are no six)."""
    f = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t")
    rows = content(lines).select(f.alias("f"), "ord")
    strand = F.when(F.size("f") > 5, F.get("f", F.lit(5))).otherwise(".")
    return rows.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("start"), F.get("f", F.lit(2)).cast("long").alias("end"), strand.alias("strand"), "ord")


def bed_lines(df: DataFrame) -> DataFrame:
    from spanloom.functions import uid

    return df.select(F.concat_ws("\t", "chrom", "start", "end", uid(), F.lit("0"), "strand").alias("value"), "ord")


def write_lines(lines: DataFrame, path: str) -> None:
    """One file, in order: for exports that a genome browser opens.

    Parts of the order are sorted and written side by side, then their bytes are appended to the one file in
    the order of the parts, so that no task holds more than its part.
    """
    spark = lines.sparkSession
    parts = f"{path.rstrip('/')}-parts-{uuid.uuid4().hex}"
    lines.orderBy("ord").select("value").write.option("compression", "none").text(parts)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    fs.delete(target, True)
    names = sorted(x.getPath().getName() for x in fs.listStatus(source) if x.getPath().getName().startswith("part-"))
    out = fs.create(hadoop.fs.Path(target, "part-00000.txt"), True)
    for name in names:
        piece = fs.open(hadoop.fs.Path(source, name))
        hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
        piece.close()
    out.close()
    fs.create(hadoop.fs.Path(target, "_SUCCESS"), True).close()
    fs.delete(source, True)


def attribute(text: Column, key: str) -> Column:
    """The value of the last `key value` entry of a GTF attribute field, without quotes; null if absent."""
    # one greedy search a key, so that the expression stays in generated code
    own = F.regexp_extract(text, f"^(?s:(?:.*;)?) *({re.escape(key)}(?: [^;]*)?)(?:;|$)", 1)
    value = F.trim(F.replace(F.substring(own, len(key) + 2, 1 << 30), F.lit('"'), F.lit("")))
    # most rows lack some keys, and a failing search is the dearest
    return F.when(F.contains(text, F.lit(key)) & (own != ""), value)


def read_gtf(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_gtf(read_lines(spark, path), **options)


def parse_gtf(lines: DataFrame, gene_name_key: str = "gene_name", gene_type_key: str = "gene_type", chr_map: dict[str, str] | None = None, zero_based: bool = False) -> DataFrame:
    """Rows of 9 fields (or 8, without phase): ord, chrom, feature, start, end, strand, gene_id, transcript_id,
    exon_number, gene_name, gene_type. Starts are kept as they stand unless zero_based. Other rows are dropped.
    """
    f = F.split(F.col("value"), "\t")
    rows = content(lines).select(f.alias("f"), "ord").where(F.size("f").isin(8, 9))
    attributes = F.element_at("f", -1)
    start = F.get("f", F.lit(3)).try_cast("long") - (1 if zero_based else 0)
    chrom = F.get("f", F.lit(0))
    if chr_map:
        pairs = F.create_map(*[F.lit(x) for kv in chr_map.items() for x in kv])
        chrom = F.coalesce(F.try_element_at(pairs, chrom), chrom)
    return rows.select(
        "ord", chrom.alias("chrom"), F.get("f", F.lit(2)).alias("feature"), start.alias("start"), F.get("f", F.lit(4)).try_cast("long").alias("end"), F.get("f", F.lit(6)).alias("strand"),
        attribute(attributes, "gene_id").alias("gene_id"), attribute(attributes, "transcript_id").alias("transcript_id"), F.coalesce(attribute(attributes, "exon_number").try_cast("int"), F.lit(0)).alias("exon_number"),
        attribute(attributes, gene_name_key).alias("gene_name"), attribute(attributes, gene_type_key).alias("gene_type"),
    )


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    return parse_bedpe(read_lines(spark, path))


def parse_bedpe(lines: DataFrame) -> DataFrame:
    """All content lines as loop_id, chrom1, start1, end1, chrom2, start2, end2; null coordinates where a line
    is too short or not integer, so that a report can count it."""
    f = F.split(F.trim("value"), r"\s+")
    rows = content(lines).select(f.alias("f"), F.col("ord").alias("loop_id"))
    n = lambda i: F.get("f", F.lit(i)).try_cast("long")
    ok = (F.size("f") >= 6) & n(1).isNotNull() & n(2).isNotNull() & n(4).isNotNull() & n(5).isNotNull()
    cols = [F.when(ok, c) for c in (F.get("f", F.lit(0)), n(1), n(2), F.get("f", F.lit(3)), n(4), n(5))]
    return rows.select("loop_id", *[c.alias(a) for c, a in zip(cols, ("chrom1", "start1", "end1", "chrom2", "start2", "end2"))])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, ord) of the records, name to the first space; empty records vanish, of equal names the last stays.

    Spark splits the text at record heads, so a record is one row wherever its lines fall.
    """
    raw = spark.read.option("lineSep", ">").text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    return parse_records(raw)


def parse_records(raw: DataFrame) -> DataFrame:
    """From rows of text between two `>`."""
    lines = F.split("value", r"\r?\n")
    seq = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), "")
    rows = raw.select(F.substring_index(F.element_at(lines, 1), " ", 1).alias("name"), seq.alias("seq"), "ord").where("seq <> ''")
    return rows.groupBy("name").agg(F.max(F.struct("ord", "seq")).alias("r")).select("name", "r.seq", "r.ord")


def parse_fasta(lines: DataFrame) -> DataFrame:
    """From (value, ord) lines: record numbers are a running count of heads, within blocks of 65,536 positions,
    after those of the blocks before (one row a block)."""
    head = F.col("value").startswith(">")
    rows = lines.withColumn("block", F.shiftright("ord", 16)).withColumn("head", head.cast("int"))
    before = F.sum("heads").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("block").agg(F.sum("head").alias("heads")).select("block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("head").over(Window.partitionBy("block").orderBy("ord"))
    rows = rows.withColumn("inside", inside).join(blocks, "block").withColumn("record", F.col("before") + F.col("inside"))
    name = F.max(F.when(head, F.substring_index(F.substring("value", 2, 1 << 30), " ", 1)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("ord", F.trim("value").alias("v"))))), lambda x: x["v"]), "")
    records = rows.groupBy("record").agg(name.alias("name"), body.alias("seq")).where("name is not null and seq <> ''")
    return records.groupBy("name").agg(F.max(F.struct("record", "seq")).alias("r")).select("name", "r.seq", F.col("r.record").cast("long").alias("ord"))


def read_motifs(spark: SparkSession, path: str, format: str = "jaspar") -> list[tuple[str, list[list[float]]]]:
    """(name, counts by position in the order A C G T) of a motif file; a motif file is metadata and is read whole."""
    if format != "jaspar":
        raise ValueError(f"unknown motif format {format}")
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return parse_jaspar(text)


def parse_jaspar(text: str) -> list[tuple[str, list[list[float]]]]:
    out = []
    for record in re.split(r"(?m)^>", text)[1:]:
        head, *rows = [x.strip() for x in record.strip().splitlines() if x.strip()]
        counts = {}
        for k, row in enumerate(rows[:4]):
            base = row[0].upper() if row[0].isalpha() else "ACGT"[k]
            counts[base] = [float(x) for x in re.findall(r"[-+0-9.eE]+", row[1:] if row[0].isalpha() else row)]
        names = head.split()
        out.append((names[1] if len(names) > 1 else names[0], [list(col) for col in zip(*(counts[b] for b in "ACGT"))]))
    return out
