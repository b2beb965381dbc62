from spanloom.operators.genes import Genes
from spanloom.operators.graph import Architecture
from spanloom.operators.loci import Loci
from spanloom.operators.motifs import scan_motifs
from spanloom.operators.tags import Tags

__all__ = ["Architecture", "Genes", "Loci", "Tags", "scan_motifs"]
