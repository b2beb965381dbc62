"""Genomic intervals, gene models, contact graphs, tags, signal and motifs as lazy Spark plans."""

from spanloom.operators import Architecture, Genes, Loci, Tags, scan_motifs

__all__ = ["Architecture", "Genes", "Loci", "Tags", "scan_motifs"]
__version__ = "0.1.0"
