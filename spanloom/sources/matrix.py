"""Contact matrices: bins and pixels from Parquet or TSV, and from HDF5 where a reader is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = "bin_id long, chrom string, start long, end long"
PIXELS = "bin1_id long, bin2_id long, count double"


def read_matrix(spark: SparkSession, path: str, resolution: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(bins, pixels). A path `file::resolutions/N`, or a resolution, picks one matrix of several.

    Folders hold bins.parquet and pixels.parquet, or bins.tsv and pixels.tsv with a header, in a
    subfolder resolutions/N if there are several.
    """
    base, _, inner = path.partition("::")
    if resolution is not None and not inner:
        inner = f"resolutions/{resolution}"
    if base.endswith((".cool", ".mcool")):
        return _hdf5(spark, base, inner)
    folder = f"{base.rstrip('/')}/{inner}".rstrip("/")
    try:
        bins, pixels = spark.read.parquet(f"{folder}/bins.parquet"), spark.read.parquet(f"{folder}/pixels.parquet")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        read = spark.read.option("sep", "\t").option("header", True)
        bins, pixels = read.schema(BINS).csv(f"{folder}/bins.tsv"), read.schema(PIXELS).csv(f"{folder}/pixels.tsv")
    pick = lambda df, schema: df.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in schema.split(", ")])
    return pick(bins, BINS), pick(pixels, PIXELS)


def _hdf5(spark: SparkSession, path: str, inner: str) -> tuple[DataFrame, DataFrame]:
    try:
        import h5py
    except ImportError as error:
        raise NotImplementedError("HDF5 matrices need h5py; convert them to Parquet bins and pixels") from error
    import pandas as pd

    with h5py.File(path) as f:
        g = f[inner] if inner else f
        names = [x.decode() for x in g["chroms/name"][:]]
        bins = pd.DataFrame({"chrom": [names[i] for i in g["bins/chrom"][:]], "start": g["bins/start"][:], "end": g["bins/end"][:]})
        pixels = pd.DataFrame({k: g[f"pixels/{k}"][:] for k in ("bin1_id", "bin2_id", "count")})
    bins.insert(0, "bin_id", range(len(bins)))
    return spark.createDataFrame(bins, BINS), spark.createDataFrame(pixels.astype({"count": float}), PIXELS)
