"""Column functions over loci: all JVM-side expressions."""

from spanloom.functions.locus import center, distance, follows, length, overlaps, precedes, sliced, slop, tss_end, tss_start, uid

__all__ = ["center", "distance", "follows", "length", "overlaps", "precedes", "sliced", "slop", "tss_end", "tss_start", "uid"]
