"""Tables and fixed-size sketches that all executors can reach."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Written intermediate tables: they cut lineage, and survive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/spanloom-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._spanloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._spanloom_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs."""
        for _ in range(2):  # the first round lets go of what the second one finds unused
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)


SLICE = 4096


def merged_array(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], size: int, dtype: str, how: str = "sum") -> np.ndarray:
    """An array of fixed `size`, filled by each task from its batches and merged slice by slice.

    Only non-empty slices are shuffled, and what reaches the driver has `size` elements whatever the input.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros(size, dtype)
        fill(batches, part)
        ids, parts = [], []
        for i in range(0, size, SLICE):
            if part[i : i + SLICE].any():
                ids.append(i // SLICE)
                parts.append(part[i : i + SLICE].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, dtype)
                if i not in done:
                    done[i] = x.copy()
                elif how == "sum":
                    done[i] += x
                else:
                    done[i] |= x
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array([x.tobytes() for x in done.values()], pa.binary())], ["slice", "part"])

    schema = "slice int, part binary"
    rows = df.mapInArrow(local, schema).repartition(8, "slice").mapInArrow(merge, schema).collect()
    out = np.zeros(size, dtype)
    for i, raw in rows:
        out[i * SLICE : (i + 1) * SLICE] = np.frombuffer(raw, dtype)
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out() -> "F.Column":
    """True for the fold from which no label is learned: crc32 of the id's text, modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0
