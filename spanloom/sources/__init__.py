from spanloom.sources.text import read_bed, read_bedpe, read_fasta, read_gtf, read_loci, read_motifs

__all__ = ["read_bed", "read_bedpe", "read_fasta", "read_gtf", "read_loci", "read_motifs"]
