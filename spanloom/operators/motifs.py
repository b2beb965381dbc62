"""Motif scans of loci's sequences.

Scores are additive over positions, so a window's score is a sum of table lookups: a
numpy kernel over Arrow batches, with the motifs (metadata of a motif file) in its closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import center, sliced
from spanloom.operators.loci import Loci
from spanloom.sources import text

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _i
TILE = 1 << 16


def pssm(counts: list[list[float]], pseudocount: float = 0.1) -> np.ndarray:
    """(width, 5) log2 odds against a uniform background; an unknown base never fits."""
    c = np.asarray(counts, float) + pseudocount
    return np.hstack([np.log2(c / c.sum(1, keepdims=True) / 0.25), np.full((len(c), 1), -np.inf)])


def hits(seq: bytes, matrix: np.ndarray, threshold: float) -> np.ndarray:
    """Offsets of the windows that score the threshold or more, forward strand."""
    code, w = _CODE[np.frombuffer(seq, np.uint8)], len(matrix)
    if len(code) < w:
        return np.zeros(0, np.int64)
    n = len(code) - w + 1
    score = np.zeros(n)
    for k in range(w):
        score += matrix[k][code[k : k + n]]
    return np.flatnonzero(score >= threshold)


def tiles(genome: DataFrame, size: int = TILE) -> DataFrame:
    """(name, tile, part): sequences cut so that no task or row holds a whole chromosome."""
    n = F.ceil(F.length("seq") / size).cast("int")
    each = genome.where("length(seq) > 0").select("name", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("tile"))
    return each.select("name", "tile", F.substring("seq", F.col("tile") * size + 1, F.lit(size)).alias("part"))


def sequences(loci: Loci, genome: DataFrame, r: int | None = None, tiled: bool = False, size: int = TILE) -> DataFrame:
    """(ord, chrom, start, end, strand, sequence): the locus' bases, or r on both sides of its center, clamped.

    genome: (name, seq), or (name, tile, part) rows if tiled. KeyError on an unknown chromosome.
    """
    parts = genome if tiled else tiles(genome, size)
    missing = loci.df.select("chrom").distinct().join(parts.select(F.col("name").alias("chrom")).distinct(), "chrom", "left_anti").first()
    if missing:
        raise KeyError(missing[0])
    return cut_sequences(loci, parts, r, size)


def cut_sequences(loci: Loci, parts: DataFrame, r: int | None, size: int = TILE) -> DataFrame:
    start, end = (F.col("start"), F.col("end")) if r is None else (center() - r, center() + r)
    own = loci.df.withColumn("lo", F.greatest(F.lit(0).cast("long"), start)).withColumn("hi", F.greatest(F.lit(0).cast("long"), end))
    last = F.when(F.col("hi") > F.col("lo"), F.expr(f"(hi - 1) div {size}")).otherwise(F.expr(f"lo div {size}"))
    asked = own.withColumn("tile", F.explode(F.sequence(F.expr(f"lo div {size}"), last)))
    met = asked.join(parts.select(F.col("name").alias("chrom"), F.col("tile").cast("long").alias("tile"), "part"), ["chrom", "tile"], "left")
    piece = sliced(F.coalesce("part", F.lit("")), F.col("lo") - F.col("tile") * size, F.col("hi") - F.col("tile") * size)
    found = met.select("ord", "chrom", "start", "end", "strand", "tile", piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "piece"))), lambda x: x["piece"]), "")
    return found.groupBy("ord", "chrom", "start", "end", "strand").agg(joined.alias("sequence"))


def scan(seqs: DataFrame, motifs: list[tuple[str, list[list[float]]]], threshold: float = 13.0) -> DataFrame:
    """(ord, motif, n): hits of each motif in each `ord, sequence` row; rows without hits of a motif are left out."""
    matrices = {name: pssm(counts) for name, counts in motifs}  # of equal names the last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for ord_, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (seq or "").upper().encode()
                for name, matrix in matrices.items():
                    n = len(hits(raw, matrix, threshold))
                    if n:
                        for c, v in zip(out, (ord_, name, n)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["ord", "motif", "n"])

    return seqs.select("ord", "sequence").mapInArrow(run, "ord long, motif string, n long")


def scan_motifs(loci: Loci, genome: DataFrame | str, motif_path: str | list, motif_format: str = "jaspar", r: int | None = 250, threshold: float = 13.0, norm: bool = True) -> DataFrame:
    """(motif, score): hits over all loci, over the motif's width if norm; motifs without hits score 0."""
    spark = loci.df.sparkSession
    genome = text.read_fasta(spark, genome) if isinstance(genome, str) else genome
    motifs = text.read_motifs(spark, motif_path, motif_format) if isinstance(motif_path, str) else motif_path
    counts = scan(sequences(loci, genome, r), motifs, threshold).groupBy("motif").agg(F.sum("n").alias("n"))
    widths = spark.createDataFrame(list({name: (name, len(c)) for name, c in motifs}.values()), "motif string, width int")
    score = F.coalesce("n", F.lit(0)).cast("double")
    return widths.join(counts, "motif", "left").select("motif", (score / F.col("width") if norm else score).alias("score"))
